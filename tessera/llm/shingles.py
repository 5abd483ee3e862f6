"""Words, weighted five-word shingles and document frequencies of batches of texts, in Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches

WIDTH = 5
#: Places of the hashed vocabulary over which document frequencies are counted, and rows that they travel in.
PLACES, SHARD = 1 << 18, 1 << 12
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(29))) * _MIX
    return z ^ (z >> np.uint64(32))


def numbered_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct word, the number of each word in turn, and where each text begins and ends among them.

    Words are runs of letters, digits and underscores in lower case.
    """
    split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string())), r"[^\pL\pN_]+", " "), " ")
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pandas().to_numpy(object)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.empty(0, np.uint64)
    at = coded.indices.to_numpy()
    edges = split.offsets.to_numpy() - split.offsets[0].as_py()
    empty = np.flatnonzero(words == "")
    if len(empty):
        there = at != empty[0]
        edges = np.append(0, np.cumsum(there))[edges]
        at = at[there]
    return hashes, at, edges.astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts a word of each place of the hashed vocabulary occurs, and the number of texts. PLACES numbers, whatever the input."""
    small_batches(docs.sparkSession)

    def run(batches):
        total, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            hashes, at, edges = numbered_words(batch.column("text"))
            n += batch.num_rows
            if len(at):
                row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(edges))
                seen = np.unique(row << 32 | (hashes % np.uint64(PLACES)).astype(np.int64)[at])
                total += np.bincount(seen & (1 << 32) - 1, minlength=PLACES)
        parts = total.reshape(-1, SHARD)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([*used.tolist(), -1], pa.int32()), "n": pa.array([*(parts[i].astype("<i8").tobytes() for i in used), np.array([n], "<i8").tobytes()], pa.binary())})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "n": [sum(np.frombuffer(x, "<i8") for x in part["n"]).astype("<i8").tobytes()]})

    got = docs.select("text").mapInArrow(run, "shard int, n binary").groupBy("shard").applyInPandas(add, "shard int, n binary").collect()
    total, n = np.zeros((PLACES // SHARD, SHARD), np.int64), 0
    for row in got:
        if row.shard < 0:
            n = int(np.frombuffer(row.n, "<i8")[0])
        else:
            total[row.shard] = np.frombuffer(row.n, "<i8")
    return total.reshape(-1), n


def levels(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency of each place, 1 + ln(1 + n / df) / ln(1 + n), in steps of 1/256 above 1 (0 to 255)."""
    idf = np.log1p(n / np.maximum(frequencies, 1)) / np.log1p(max(n, 1))
    return np.minimum(255, np.round(idf * 255)).astype(np.float32)


HASH_BITS = 46


def weighted(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: hash (46 bits), weight, begin and end of each text, words of each text.

    The weight is the number of occurrences times the mean of the words' inverse document frequencies. A text of fewer
    than five words is one shingle; one without words has none. At most 1024 texts at a time.
    """
    if len(texts) > 1024:
        raise ValueError("too many texts at a time")
    hashes, at, edges = numbered_words(texts)
    sizes = np.diff(edges)
    place = idf[(hashes % np.uint64(PLACES)).astype(np.int64)] if len(hashes) else np.empty(0, np.float32)
    h, w = hashes[at], place[at]
    n = np.maximum(sizes - WIDTH + 1, (sizes > 0).astype(np.int64))
    # Texts of fewer words are filled up to one shingle.
    short = np.flatnonzero((sizes > 0) & (sizes < WIDTH))
    if len(short):
        fill = WIDTH - sizes[short]
        h = np.insert(h, np.repeat(edges[short + 1], fill), np.uint64(1))
        w = np.insert(w, np.repeat(edges[short + 1], fill), np.repeat([w[a:b].mean() for a, b in zip(edges[short], edges[short + 1], strict=True)], fill))
        sizes = sizes.copy()
        sizes[short] = WIDTH
    begin = np.cumsum(sizes) - sizes
    count = int(n.sum())
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), n)
    start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(count)
    z, level = np.zeros(count, np.uint64), np.zeros(count, np.float32)
    for k in range(WIDTH):
        z = (z + h[start + k]) * _GOLD
        z ^= z >> np.uint64(31)
        level += w[start + k]
    level = np.minimum(255, level / WIDTH + 0.5).astype(np.uint64)
    key = np.sort(row << np.uint64(54) | (mix(z) >> np.uint64(64 - HASH_BITS)) << np.uint64(8) | level)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if count else np.empty(0, np.int64)
    times = np.diff(np.append(first, count))
    key = key[first]
    weight = (times * (1 + (key & np.uint64(255)).astype(np.float64) / 255)).astype(np.float32)
    bounds = np.searchsorted(key >> np.uint64(54), np.arange(len(texts) + 1, dtype=np.uint64))
    return key >> np.uint64(8) & np.uint64((1 << HASH_BITS) - 1), weight, bounds, np.diff(edges)
