"""BPE against the tokenizers library; token files read back."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, token_store

from .helpers import ODD, SMALL, empty, odd

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = ["a", "b", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "é", "É", "ß", "é", "世", "Σ", "ΑΣ", "İ", "😀", "1", "23", "!", "...", ",", ".", "_", ".,", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x1c", "\x85", "　", "I'm", "The", "ing", "tion", "\r\n", "ا", "|"]


def random_texts(n):
    rnd = random.Random(1)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 3000, "", "ab" * 2000, "\n \n  x ", "x \n"]


def test_prefix_bpe_is_the_library_encoding():
    mine, library = bpe.PrefixBpe(BYTES), Tokenizer.from_file(BYTES)
    texts = random_texts(5000)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert mine.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_pairs_are_compatible_as_the_merges_leave_them():
    mine, library = bpe.PrefixBpe(BYTES), Tokenizer.from_file(BYTES)
    rnd, tokens = random.Random(2), [(i, b) for i, b in bpe.PrefixBpe(BYTES).bytes_of.items() if b.isalpha() and b.isascii()]
    for _ in range(3000):
        (i, a), (j, b) = rnd.choice(tokens), rnd.choice(tokens)
        assert mine.compatible(i, j) == (library.encode((a + b).decode(), add_special_tokens=False).ids == [i, j])


def test_bpe_round_trip(spark):
    library = Tokenizer.from_file(BYTES)
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(odd(spark), BYTES).collect())
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.bpe_round_trip(empty(spark), BYTES).count() == 0


def test_word_encoder_is_the_library_encoding():
    enc, library = token_store.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = random_texts(5000)
    ids, edges = enc.encode(pa.array(texts))
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[edges[k] : edges[k + 1]].tolist() == e.ids, texts[k]


@pytest.mark.parametrize(("n", "k"), [(5000, 300), (1, 3), (1024, 2), (1025, 7), (2048, 1), (2500, 40_000), (0, 5)])
def test_codec_round_trip(n, k):
    ids = (np.random.default_rng(n).zipf(1.3, n) % k).astype(np.uint32)
    lengths = token_store.code_lengths(np.bincount(ids, minlength=k))
    codec = token_store.Codec(lengths)
    payload, checkpoints = codec.encode(ids)
    assert (codec.decode(payload, checkpoints, n) == ids).all()
    assert len(checkpoints) // 4 == -(-n // token_store.BLOCK)
    if n:
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 0])
    heap = [(int(c), [i]) for i, c in enumerate(counts) if c]
    best = [0] * len(counts)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for i in x + y:
            best[i] += 1
        heapq.heappush(heap, (a + b, x + y))
    assert (token_store.code_lengths(counts, 30) * counts).sum() == (np.array(best) * counts).sum()
    limited = token_store.code_lengths(counts, 5)
    assert limited.max() == 5 and sum(2.0 ** -int(x) for x in limited if x) == 1


def check_files(spark, docs, rows):
    library = Tokenizer.from_file(WORDS)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.token_files(docs, WORDS).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_files(spark):
    check_files(spark, odd(spark), ODD)
    assert token_store.token_files(empty(spark), WORDS).count() == 0


def test_token_files_over_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_files(spark, docs.repartition(7), [(r.doc_id, r.text) for r in docs.collect()])
