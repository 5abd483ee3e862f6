"""BPE encoding by per-prefix dynamic programming, and decoding.

For each prefix of a piece of text (a pre-token) there is exactly one last token that the merges can leave there. An
automaton lists the vocabulary entries that are suffixes of the prefix; the last token is the entry t that may stand
behind the last token of the prefix before it. Whether two tokens may stand side by side depends on these two alone:
no merge may join the right edge of the first with the left edge of the second before both have grown whole. The
back-pointers, followed from the end, give exactly the ids of the merge procedure, in time linear in the text.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches, texts

#: Pre-tokens of byte-level BPE; white space as Unicode has it.
_WS = r"\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A space between white space and more of it (or the end): there, cutting at spaces would part a pre-token.
_SPACES = regex.compile(rf"[{_WS}] (?=[{_WS}]|\Z)")
#: Entries kept in a worker's cache of encoded chunks; beyond it the cache starts anew, which changes no result.
CACHE_ENTRIES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stays, the other bytes follow from U+0100 on."""
    stays = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(stays)]
    return {chr(b): b for b in stays} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder of one vocabulary file, without a normaliser, in the byte alphabet."""

    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        if spec.get("normalizer") or spec["model"].get("ignore_merges") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level vocabulary without a normaliser is needed")
        alphabet = byte_alphabet()
        raw = {t: bytes(alphabet[c] for c in t) for t in spec["model"]["vocab"] if all(c in alphabet for c in t)}
        ids = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            self.made.setdefault(whole, (rank, ids[left], ids[right]))
        # Only tokens that the merges can make are ever a last token; bytes are there from the start.
        self.bytes_of = {ids[t]: b for t, b in raw.items() if t not in self.special}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in self.made:
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.decoded = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for i, b in self.bytes_of.items():
            self.decoded[i] = b
        for t, i in self.special.items():
            self.decoded[i] = t.encode()
        self._edges: tuple[dict[int, list[tuple[int, int]]], dict[int, list[tuple[int, int]]]] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along the right (side 1) or left (0) edge of a token's own merges, each with the rank at which it is merged away."""
        known = self._edges[side].get(token)
        if known is None:
            known, at, until = [], token, len(self.rank) + 1
            while True:
                known.append((at, until))
                if at not in self.made:
                    break
                until, left, right = self.made[at]
                at = right if side else left
            self._edges[side][token] = known
        return known

    def compatible(self, first: int, second: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side."""
        ok = self.pairs.get(first << 20 | second)
        if ok is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            ok = True
            for a, a_until in self._edge(first, 1):
                for b, b_until in self._edge(second, 0):
                    rank = self.rank.get((a, b))
                    # Equal merges are done from the left: inside the first token before, inside the second after.
                    if rank is not None and rank < a_until and rank <= b_until:
                        ok = False
            self.pairs[first << 20 | second] = ok
        return ok

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        text = piece.encode("utf-8").decode("latin-1")
        last, back = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - n
                if not start or last[start] >= 0 and self.compatible(last[start], token):
                    last[end], back[end] = token, start
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in _PIECES.findall(chunk):
            known = self.pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece)
                if len(piece) < 64:
                    if len(self.pieces) >= CACHE_ENTRIES:
                        self.pieces.clear()
                    self.pieces[piece] = known
            ids += known
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _SPACES.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        words = [first, *[" " + w for w in rest]]
        known = self.chunks
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._chunk(w)
                if len(w) < 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special and any(t in text for t in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.split_special.split(text) if x)
        return self._plain(text) if text else b""

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.decoded.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def bpe_round_trip(docs: DataFrame, vocabulary: str, *, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (binary, little-endian unsigned 32 bits).

    One row per input row; a null text is an empty one, which has no tokens. Repeated rows give repeated rows, other
    columns of docs play no part, an empty table gives an empty one. vocabulary: path of the tokenizer's JSON file on
    every executor.
    """

    def make():
        bpe = loaded(vocabulary)

        def run(batch: pa.RecordBatch) -> dict:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode("utf-8")).hexdigest() for x in ids]}
            return out | ({"ids": ids} if keep_ids else {})

        return run

    return map_batches(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
