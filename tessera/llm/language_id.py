"""Language identification by prediction by partial matching.

Per language a context tree over bytes, ORDER deep, with escape probabilities (q of the n + q chances go to the
shorter context, q being the number of distinct successors of a context seen n times). The statistics are frozen after
training, so the code length of a byte depends on the ORDER bytes before it alone, and exact code lengths can be put
in tables: an entry per gram that some language has seen, a column per language. A gram that none has seen costs the
escape from its context and the code length in the next shorter one. The language with the shortest code wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_batches, map_batches, possibly_in, small_batches, texts

ORDER = 3
#: Whole texts learned from per language: a bounded sample, by the hash of doc_id.
ROWS_PER_LANGUAGE = 500
#: Bytes whose evidence counts in full for the score; beyond them the mean counts.
SCORE_BYTES = 64
#: Bits a byte from which on a text is in none of the languages.
MOST_BITS = 10
_LETTER = regex.compile(r"\p{L}")
_START = b" " * ORDER


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no model may learn from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


@dataclass
class ContextTrees:
    """Code lengths in bits: order k < ORDER - 1 in dense tables over symbols, longer grams by node."""

    languages: list[str]
    symbol: np.ndarray  # byte to symbol; the last symbol stands for all bytes not seen
    nodes: np.ndarray  # three symbols to node, 0: none
    leaves: np.ndarray  # node, symbol to entry of long, 0: none
    long: np.ndarray  # code lengths of seen grams of ORDER + 1 bytes
    escape3: np.ndarray  # by node
    cost3: np.ndarray  # by node, taken as a gram
    escape2: np.ndarray  # two symbols
    cost2: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths: a row per text, a column per language."""
        out = np.zeros((len(texts), len(self.languages)))
        i = 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (j == i or n < 1 << 20):
                n += len(texts[j]) + ORDER
                j += 1
            out[i:j] = self._score(texts[i:j])
            i = j
        return out

    def _score(self, texts: list[bytes]) -> np.ndarray:
        base = int(self.symbol.max()) + 1
        s = self.symbol[np.frombuffer(b"".join(_START + t for t in texts), np.uint8)]
        sizes = np.array([len(t) for t in texts])
        three = self.nodes[(s[:-2] * base + s[1:-1]) * base + s[2:]]
        at = three[:-1]
        entry = self.leaves[at * base + s[3:]]
        bits = self.long[entry]
        if len(gone := np.flatnonzero(entry == 0)):
            cost = self.escape3[at[gone]]
            shorter = three[gone + 1]
            known = shorter > 0
            cost[known] += self.cost3[shorter[known]]
            far = gone[~known]
            cost[~known] += self.escape2[s[far + 1] * base + s[far + 2]] + self.cost2[s[far + 2] * base + s[far + 3]]
            bits[gone] = cost
        begin = np.cumsum(sizes + ORDER) - sizes - ORDER
        full = np.flatnonzero(sizes)
        out = np.zeros((len(texts), len(self.languages)))
        if len(full):
            # Positions between texts belong to no text: each text's run ends where its bytes end.
            edges = np.stack([begin[full], begin[full] + sizes[full]], 1).reshape(-1)
            bits = np.vstack([bits, np.zeros((1, bits.shape[1]), bits.dtype)])
            out[full] = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
        return out


def fit_trees(counts: dict[str, dict[int, int]]) -> ContextTrees | None:
    """counts: per language, of each gram of ORDER + 1 bytes (big-endian in an integer). None if there is nothing to learn from."""
    languages = sorted(x for x in counts if counts[x])
    if not languages:
        return None
    width = len(languages)
    keys = np.unique(np.concatenate([np.fromiter(counts[x], np.int64, len(counts[x])) for x in languages]))
    n4 = np.zeros((len(keys), width))
    for c, x in enumerate(languages):
        n4[np.searchsorted(keys, np.fromiter(counts[x], np.int64, len(counts[x]))), c] = np.fromiter(counts[x].values(), np.float64, len(counts[x]))
    seen = np.unique(np.stack([keys >> s & 255 for s in (24, 16, 8, 0)]))
    base = len(seen) + 1
    symbol = np.full(256, base - 1, np.int32)
    symbol[seen] = np.arange(base - 1)
    grams = {4: (keys, n4)}
    for k in (3, 2, 1):
        longer, n = grams[k + 1]
        own, at = np.unique(longer & (1 << 8 * k) - 1, return_inverse=True)
        total = np.zeros((len(own), width))
        np.add.at(total, at, n)
        grams[k] = own, total

    def contexts(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the grams of k bytes: their contexts, n and q of each."""
        own, n = grams[k]
        heads, at = np.unique(own >> 8, return_inverse=True)
        total, kinds = np.zeros((len(heads), width)), np.zeros((len(heads), width))
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        return heads, total, kinds

    def escape(k: int, heads: np.ndarray) -> np.ndarray:
        known, total, kinds = contexts(k)
        at = np.minimum(np.searchsorted(known, heads), len(known) - 1)
        hit = (known[at] == heads)[:, None] & (total[at] > 0)
        return np.where(hit, -np.log2(np.where(hit, kinds[at] / np.maximum(total[at] + kinds[at], 1), 1)), 0)

    def cost(k: int, wanted: np.ndarray) -> np.ndarray:
        """Code lengths of grams of k bytes, seen or not."""
        if not k:
            return np.full((len(wanted), width), 8.0)
        own, n = grams[k]
        heads, total, kinds = contexts(k)
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        found = np.where((own[at] == wanted)[:, None], n[at], 0)
        h = np.minimum(np.searchsorted(heads, wanted >> 8), len(heads) - 1)
        room = np.where((heads[h] == wanted >> 8)[:, None], total[h] + kinds[h], 1)
        shorter = cost(k - 1, wanted & (1 << 8 * (k - 1)) - 1)
        return np.where(found > 0, -np.log2(np.maximum(found, 1) / np.maximum(room, 1)), escape(k, wanted >> 8) + shorter)

    # An unseen byte stands for all of them: any one gives the same code lengths.
    unseen = np.setdiff1d(np.arange(256), seen)
    byte = np.append(seen, unseen[0] if len(unseen) else 0)
    pairs = (byte[:, None] << 8 | byte[None, :]).reshape(-1)
    node_keys = np.unique(np.concatenate([grams[3][0], keys >> 8]))
    parts = [symbol[node_keys >> s & 255] for s in (16, 8, 0)]
    nodes = np.zeros(base**3, np.int32)
    nodes[(parts[0] * base + parts[1]) * base + parts[2]] = np.arange(1, len(node_keys) + 1)
    leaves = np.zeros((len(node_keys) + 1) * base, np.int32)
    leaves[(np.searchsorted(node_keys, keys >> 8) + 1) * base + symbol[keys & 255]] = np.arange(1, len(keys) + 1)
    none = np.zeros((1, width))
    f32 = lambda x: np.ascontiguousarray(x, np.float32)
    return ContextTrees(languages, symbol, nodes, leaves, f32(np.vstack([none, cost(4, keys)])), f32(np.vstack([none, escape(4, node_keys)])), f32(np.vstack([none, cost(3, node_keys)])), f32(escape(3, pairs)), f32(cost(2, pairs)))


def train(docs: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE) -> ContextTrees | None:
    """Learn from about rows_per_language whole texts of each language at most, chosen by the hash of doc_id.

    Only rows with a text and a lang that held_out leaves are learned from. The driver gets the counts of the grams of
    this bounded sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # The choice is made on ids alone; a bitmap of the chosen ones then spares the texts a shuffle.
    ids = rows.select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.count("*").alias("rows")).select("lang", (F.lit(rows_per_language) / F.col("rows")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = ids.join(sizes, "lang").where(chance < F.col("share")).select("doc_id").distinct()  # all rows where there are fewer
    sample = possibly_in(rows, chosen).join(chosen, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            lang, n, gram = [], [], []
            by: dict[str, list[bytes]] = {}
            for x, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(x, []).append(_START + t.encode("utf-8", "replace"))
            for x, own in by.items():
                b = np.frombuffer(b"".join(own), np.uint8).astype(np.int64)
                key = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
                ends = np.cumsum([len(t) for t in own])
                inside = np.ones(len(key), bool)
                for d in (1, 2, 3):  # grams over the edge of two texts
                    inside[ends[:-1] - d] = False
                keys, times = np.unique(key[inside], return_counts=True)
                lang += [x] * len(keys)
                gram.append(keys)
                n.append(times)
            if lang:
                yield pa.RecordBatch.from_pydict({"lang": lang, "gram": np.concatenate(gram), "n": np.concatenate(n)})

    got = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return fit_trees({x: dict(zip(part["gram"].tolist(), part["n"].tolist(), strict=True)) for x, part in got.groupby("lang")})


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte, accepted of every whole text.

    One row per input row, copies too. lang_pred is `und` and score 0 for a null text, one without a letter, and if
    there was nothing to learn from. Ties go to the first language by name. accepted: a language was found and its
    code is shorter than MOST_BITS a byte, the plain 8 and a margin for new words; text in another script takes more.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # bounded by the sample that it is learned from

    def make():
        trees = shared.value

        def run(batch: pa.RecordBatch) -> dict:
            raw = batch.column("text").to_pylist()
            out: dict = {"doc_id": batch.column("doc_id"), "lang_pred": ["und"] * len(raw), "score": [0.0] * len(raw), "bits_per_byte": [None] * len(raw)}
            rows = [i for i, t in enumerate(raw) if t is not None and trees is not None and _LETTER.search(t)]
            data = [raw[i].encode("utf-8", "replace") for i in rows]
            if rows:
                bits = trees.score(data)
                best = bits.argmin(1)
                sizes = np.array([len(x) for x in data])
                gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1, SCORE_BYTES / sizes)[:, None]
                score = 1 / np.exp2(-gap).sum(1)
                per_byte = bits.min(1) / sizes
                for i, k, p, b in zip(rows, best.tolist(), score.tolist(), per_byte.tolist(), strict=True):
                    out["lang_pred"][i], out["score"][i], out["bits_per_byte"][i] = trees.languages[k], p, b
            return out

        return run

    found = map_batches(texts(docs, null=None), make, "doc_id long, lang_pred string, score double, bits_per_byte double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte", F.coalesce(F.col("bits_per_byte") < MOST_BITS, F.lit(False)).alias("accepted"))


def accepted(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """The rows that identify accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample that it is learned from

    def make():
        trees = shared.value

        def run(batch: pa.RecordBatch) -> list[bool]:
            raw = batch.column("text").to_pylist()
            out = [False] * len(raw)
            rows = [i for i, t in enumerate(raw) if t is not None and trees is not None and _LETTER.search(t)]
            data = [raw[i].encode("utf-8", "replace") for i in rows]
            if rows:
                bits = trees.score(data).min(1)
                for i, b, x in zip(rows, bits.tolist(), data, strict=True):
                    out[i] = b < MOST_BITS * len(x)
            return out

        return run

    return filter_batches(docs, make)
