"""Token ids in files: canonical length-limited Huffman codes, in blocks that are decoded independently.

File format (version 1): a folder of Parquet files with one row per frame. A frame holds consecutive documents in
ascending doc_id order:

    part long, frame long       place of the frame: parts follow each other, frames within a part too
    start long                  ids of the part's documents before the frame
    n_tokens long
    doc_ids, doc_tokens binary  little-endian int64 and uint32, an entry per document (null doc_id: -2^63)
    checkpoints binary          little-endian uint32, an entry per block of BLOCK ids: bit at which the block starts
    payload binary              the codes, most significant bit first, in big-endian 32-bit words

beside it `codebook`, one row: vocabulary size and code lengths (uint8 per id, 0: unused). Codes are canonical, so the
lengths are all that a reader needs; with a checkpoint any block can be decoded alone, and the decoder takes all
blocks of a frame in step, one table look-up per id.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import forget, map_batches, scratch, small_batches, texts

#: Ids in a block, least ids in a frame before it is closed, longest code.
BLOCK, FRAME, MAX_BITS = 1024, 1 << 20, 18
_WORD = re.compile(r"[a-zß-öø-ÿ]+")
#: Texts that are encoded as they are: other letters than ASCII's and Latin-1's, marks beside commas or stops, special tokens.
_ODD = r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]|[^A-Za-z0-9À-ÖØ-öø-ÿ \n][.,]|[.,][^A-Za-z0-9À-ÖØ-öø-ÿ \n]|<\|"
#: Documents in a batch that is passed on, and bytes of text encoded at a time.
SLICE, TOGETHER = 1000, 12 << 20
#: Bytes above ASCII in the byte alphabet of vocabularies: printable Latin-1 is itself, the rest follows U+0143.
_BYTES = {b: 256 + 33 + i for i, b in enumerate(range(127, 161))} | {173: 256 + 67}
NULL_ID = -(2**63)
#: Entries of a worker's cache of encoded words; beyond it the cache starts anew, which changes no result.
CACHE_ENTRIES = 900_000


class WordEncoder:
    """The tokenizers library's encoding of whole texts, by distinct piece.

    Texts are cut at spaces and line feeds, which this vocabulary drops before the merges and across which no piece
    reaches. A batch's pieces are made and numbered by Arrow; each distinct one goes through the library once and is
    remembered. Texts of ASCII and Latin-1 letters alone, in which commas and stops stand by themselves, are first set
    in lower case and cut before these marks too, which changes no id and leaves fewer distinct pieces.
    """

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        split = next((x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"), None)
        #: Whether white space is dropped between pieces, as cutting at it needs.
        self.cuts = bool(split and split["behavior"] == "Removed" and split["invert"] and spec["post_processor"] is None and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" \n") for x in spec["added_tokens"]))
        self.lowers = self.cuts and "Lowercase" in json.dumps(spec["normalizer"]) and all(x["content"].startswith("<|") for x in spec["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.array = "H" if self.size <= 1 << 16 else "I"
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.pieces: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Words go to the library's merges alone: in lower case, one pre-token, in the byte alphabet; all else through the whole of it."""
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for w in new:
            if self.lowers and _WORD.fullmatch(w):
                letters = w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
                self.pieces[w] = array(self.array, [t.id for t in tokenize(letters)]).tobytes()
            else:
                rest.append(w)
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            self.pieces[c] = array(self.array, e.ids).tobytes()

    def _encode(self, texts: pa.StringArray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        if self.cuts:
            if plain:
                texts = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), ",", " ,"), ".", " .")
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            lists = pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        ids = list(map(self.pieces.get, words))
        if new := [i for i, x in enumerate(ids) if x is None]:
            self.learn([words[i] for i in new])
            for i in new:
                ids[i] = self.pieces[words[i]]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // int(self.kind[-1])
        flat = np.frombuffer(b"".join(ids), self.kind)
        at = coded.indices.to_numpy()
        size = sizes[at]
        ends = np.cumsum(size)
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return out, edges

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids begin and end."""
        if not self.lowers:
            return self._encode(texts, False)
        odd = pc.match_substring_regex(texts, _ODD)
        if not pc.any(odd).as_py():
            return self._encode(texts, True)
        odd = odd.to_numpy(zero_copy_only=False)
        parts = [self._encode(texts.filter(pa.array(mask)), plain) for mask, plain in ((~odd, True), (odd, False))]
        sizes = np.zeros(len(texts), np.int64)
        for (_, edges), mask in zip(parts, (~odd, odd), strict=True):
            sizes[mask] = np.diff(edges)
        edges = np.append(0, np.cumsum(sizes))
        out = np.empty(edges[-1], self.kind)
        at = np.repeat(odd, sizes)
        out[~at], out[at] = parts[0][0], parts[1][0]
        return out, edges


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `most` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols need codes of more than {most} bits")
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    packages, merged = np.empty(0), []
    for _ in range(most):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        merged.append(at < len(leaves))
        weights = both[at]
        even = len(weights) // 2 * 2
        packages = weights[0:even:2] + weights[1:even:2]
    take, times = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(merged):
        n = int(is_leaf[:take].sum())
        times[:n] += 1
        take = 2 * (take - n)
    lengths[order] = times
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = order[lengths[order] == n]
        code <<= n - last
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, last = code + len(own), n
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths, self.codes = lengths.astype(np.uint64), canonical(lengths)
        self.bits = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        starts = self.codes[used] << (np.uint64(self.bits) - self.lengths[used])
        order = np.argsort(starts)
        spans = (1 << (self.bits - lengths[used].astype(np.int64)))[order]
        self.symbols = np.zeros(1 << self.bits, np.uint32)
        self.widths = np.ones(1 << self.bits, np.uint8)
        self.symbols[: spans.sum()] = np.repeat(used[order], spans)
        self.widths[: spans.sum()] = np.repeat(lengths[used][order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints."""
        width = self.lengths[ids]
        ends = np.cumsum(width)
        at = ends - width
        word, bit = (at >> np.uint64(5)).astype(np.int64), at & np.uint64(31)
        value = self.codes[ids] << (np.uint64(64) - width - bit)
        out = np.zeros((int(ends[-1]) + 31) // 32 + 1 if len(ids) else 0, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), at[::BLOCK].astype("<u4").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        """All ids of a frame: the blocks advance together, one id a step."""
        at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out, shift = np.zeros((min(BLOCK, n), len(at)), np.uint32), np.uint64(64 - self.bits)
        left = n - (len(at) - 1) * BLOCK if len(at) else 0
        for i in range(len(out)):
            if i == left and len(at) > 1:  # the last block may be shorter
                at = at[:-1]
            entry = (pairs[at >> 5] << (at & 31).astype(np.uint64)) >> shift
            out[i, : len(at)] = self.symbols[entry]
            at += self.widths[entry]
        return out.T.reshape(-1)[:n] if left == BLOCK or n <= BLOCK else np.concatenate([out[:, :-1].T.reshape(-1), out[:left, -1]])


def gathered(batches):
    """Batches put together, up to TOGETHER bytes of text: more text at a time has fewer distinct pieces a byte."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            held.append(batch.slice(lo, SLICE))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size >= TOGETHER:
                yield from _joined(held)
                held, size = [], 0
    if held:
        yield from _joined(held)


def _joined(held: list[pa.RecordBatch]):
    whole = pa.Table.from_batches(held).combine_chunks()
    if whole.num_rows:
        yield whole.column("doc_id").chunk(0), whole.column("text").chunk(0).cast(pa.string())


def encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary, in the encoder's kind) of every whole text, the end mark included; and a row per task with its counts of ids in ids, marked by counts."""

    def run(batches):
        enc = encoder(vocabulary)
        total = np.zeros(max(enc.size, end_id + 1), np.int64)
        width = int(enc.kind[-1])
        for doc_ids, own in gathered(batches):
            ids, edges = enc.encode(own)
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
            total += np.bincount(ids, minlength=len(total))
            for lo in range(0, len(own), SLICE):
                cut = edges[lo : lo + SLICE + 1]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(((cut - cut[0]) * width).astype(np.int32)), pa.py_buffer(ids[cut[0] : cut[-1]].copy())])
                yield pa.RecordBatch.from_arrays([doc_ids[lo : lo + SLICE], binary, pa.array([False] * (len(cut) - 1))], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary()), pa.array([True])], ["doc_id", "ids", "counts"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id long, ids binary, counts boolean")


def count_ids(coded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs over all documents. The driver gets an entry per id of the vocabulary."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            both = np.concatenate([np.frombuffer(x, "<i8").reshape(2, -1) for x in batch.column("ids").to_pylist()], 1)
            return {"id": both[0], "n": both[1]}

        return run

    got = map_batches(coded.where("counts").select("ids"), make, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[got["id"]] = got["n"]
    return counts


def write_tokens(docs: DataFrame, vocabulary: str, path: str, *, end_id: int) -> None:
    """Encode every whole text, append end_id to each document, and write the file format above, in ascending doc_id order.

    A null text is empty and so gives the end mark alone; documents with a null doc_id come first; rows with one
    doc_id all stay, next to each other. Other columns of docs play no part. An empty table gives no frame.

    The texts are encoded once, into a scratch table of plain ids that is deleted when the files are written: the code
    can't be chosen before all ids are counted.
    """
    spark = docs.sparkSession
    enc = encoder(vocabulary)
    kind = enc.kind
    plain = scratch(spark, "ids")
    encoded(docs, vocabulary, end_id).write.option("compression", "zstd").parquet(plain)
    coded = spark.read.schema("doc_id long, ids binary, counts boolean").parquet(plain)
    lengths = code_lengths(count_ids(coded, max(enc.size, end_id + 1)))
    spark.createDataFrame([(1, len(lengths), bytearray(lengths.tobytes()))], "version int, size long, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(lengths)  # a byte per id of the vocabulary

    def run(batches):
        codec, part = Codec(shared.value), TaskContext.get().partitionId()
        ids, sizes, parts, n, start, frame = [], [], [], 0, 0, 0

        def close():
            payload, checkpoints = codec.encode(np.frombuffer(b"".join(parts), kind))
            return pa.RecordBatch.from_pydict({"part": [part], "frame": [frame], "start": [start], "n_tokens": [n], "doc_ids": [np.array(ids, "<i8").tobytes()], "doc_tokens": [np.array(sizes, "<u4").tobytes()], "checkpoints": [checkpoints], "payload": [payload]})

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(NULL_ID if doc_id is None else doc_id)
                sizes.append(len(own) // int(kind[-1]))
                parts.append(own)
                n += sizes[-1]
                if n >= FRAME:
                    yield close()
                    start, frame = start + n, frame + 1
                    ids, sizes, parts, n = [], [], [], 0
        if ids:
            yield close()

    order = F.col("doc_id").asc_nulls_first()
    frames = coded.where("not counts").select("doc_id", "ids").repartitionByRange(order).sortWithinPartitions(order, "ids").mapInArrow(run, "part long, frame long, start long, n_tokens long, doc_ids binary, doc_tokens binary, checkpoints binary, payload binary")
    frames.write.option("compression", "uncompressed").parquet(f"{path}/frames")
    forget(spark, plain)


def read_tokens(spark: SparkSession, path: str, *, keep_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with keep_ids also ids (binary, little-endian uint32)."""
    book = spark.read.parquet(f"{path}/codebook").first()
    frames = spark.read.parquet(f"{path}/frames")
    before, total = {}, 0
    for part, n in frames.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").toLocalIterator():  # a number per part
        before[part], total = total, total + n
    shared = spark.sparkContext.broadcast((np.frombuffer(book["lengths"], np.uint8), before))

    def make():
        lengths, firsts = shared.value
        codec = Codec(lengths)

        def run(batch: pa.RecordBatch) -> dict:
            out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ids = codec.decode(row["payload"], row["checkpoints"], row["n_tokens"]).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                out["doc_id"] += [None if x == NULL_ID else x for x in np.frombuffer(row["doc_ids"], "<i8").tolist()]
                out["start"] += (firsts[row["part"]] + row["start"] + ends - sizes).tolist()
                out["n_tokens"] += sizes.tolist()
                own = [ids[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                out["ids_crc32"] += [zlib.crc32(x) for x in own]
                if keep_ids:
                    out["ids"] += own
            return out

        return run

    # A few frames a batch: each is some megabytes.
    return map_batches(frames, make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def token_files(docs: DataFrame, vocabulary: str, *, end_id: int = 1) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, path, end_id=end_id)
    return read_tokens(docs.sparkSession, path)
