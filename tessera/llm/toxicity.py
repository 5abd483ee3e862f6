"""Toxicity: a factorization machine over hashed terms.

A text is the set of its terms: words, and beginnings of words, as 32-bit hashes. Each term has a weight and a vector
of FACTORS numbers; a text's score is the logistic function of bias + sum of weights + sum over all pairs of terms of the
product of their vectors, which sums of vectors and of their squares give in one pass. So an insult and the mention of
a group may weigh more together than apart. Terms that say nothing about the label in the sample have no entry: they
are screened by the G test, on counts that Spark makes.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, possibly_in, texts, written

#: Labelled rows learned from: a bounded sample, by the hash of doc_id.
MOST_ROWS = 20_000
#: Length of the vectors; texts of the sample that a term is in at least; the G statistic that it must reach (chi-squared, one degree).
FACTORS, TEXTS, G = 4, 5, 12.0
#: Step, decay of weights and of vectors, passes over the sample at least, and steps at least.
STEP, DECAY, VECTOR_DECAY, PASSES, STEPS = 0.1, 1e-4, 1e-3, 4, 30_000
#: Lengths of beginnings of words that are terms too.
BEGINNINGS = (4, 5, 6)
#: Words whose terms a task remembers.
HELD = 200_000
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from; a null doc_id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def terms_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    return [zlib.crc32(x.encode("utf-8", "replace")) for x in (word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k))]


def terms(text: str) -> list[int]:
    return sorted({h for word in set(_WORD.findall(text.lower())) for h in terms_of(word)})


@dataclass
class Machine:
    """A bias, and by term, sorted, a weight and a vector."""

    bias: float
    term: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def value(self, slots: np.ndarray) -> float:
        """The log odds of a text with these terms, by their places."""
        v = self.vector[slots]
        s = v.sum(0)
        return float(self.bias + self.weight[slots].sum() + ((s * s).sum() - (v * v).sum()) / 2)

    def slots(self, found: np.ndarray) -> np.ndarray:
        """The places of those hashes that have an entry."""
        if not len(self.term):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.term, found), len(self.term) - 1)
        return at[self.term[at] == found]


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -40.0), 40.0)))


def learn(rows: list[np.ndarray], toxic: np.ndarray, kept: np.ndarray, *, factors: int = FACTORS, seed: int = 7) -> Machine:
    """Stochastic gradient descent with a step for each number. rows: the terms of each text; kept: the terms to learn, sorted.

    Without rows of both labels the bias alone tells the one label, or 0.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Machine(-40.0 if share == 0 else 40.0, kept[:0], np.zeros(0), np.zeros((0, factors)))
    rnd = np.random.default_rng(seed)
    m = Machine(math.log(share / (1 - share)), kept, np.zeros(len(kept)), rnd.normal(0, 0.05, (len(kept), factors)))
    at = [m.slots(x) for x in rows]
    bias_sum, weight_sum, vector_sum = 1.0, np.ones(len(kept)), np.ones((len(kept), factors))
    for _ in range(max(PASSES, math.ceil(STEPS / len(rows)))):
        for i in rnd.permutation(len(rows)):
            a = at[i]
            g = logistic(m.value(a)) - toxic[i]
            bias_sum += g * g
            m.bias -= STEP * g / math.sqrt(bias_sum)
            v = m.vector[a]
            d, dv = g + DECAY * m.weight[a], g * (v.sum(0) - v) + VECTOR_DECAY * v
            weight_sum[a] += d * d
            vector_sum[a] += dv * dv
            m.weight[a] -= STEP * d / np.sqrt(weight_sum[a])
            m.vector[a] -= STEP * dv / np.sqrt(vector_sum[a])
    return m


def _told(both: Column, with_term: Column, label: Column, rows: Column) -> Column:
    """G statistic of term and label: twice the sum of observed times log of observed over expected."""
    cell = lambda seen, a, b: F.when(seen > 0, seen * F.log(seen * rows / (a * b))).otherwise(0.0)
    rest, no = rows - with_term, rows - label
    return 2 * (cell(both, with_term, label) + cell(with_term - both, with_term, no) + cell(label - both, rest, label) + cell(rest - label + both, rest, no))


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, factors: int = FACTORS, least_texts: int = TEXTS, least_g: float = G) -> Machine:
    """Learn from at most about most_rows labelled rows that held_out leaves, chosen by the hash of doc_id.

    Rows with a null id or label teach nothing; of a doc_id that is labelled more than once the higher label counts,
    and each of its rows is learned from. The driver gets the screened terms of this bounded sample, not its texts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (most_rows / n)))
    sample = possibly_in(texts(docs), known.select("doc_id")).join(known, "doc_id")

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": [terms(t) for t in batch.column("text").to_pylist()]}

        return run

    rows = written(map_batches(sample, make, "doc_id long, toxic int, terms array<long>"), "terms")
    total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("both"))
    told = _told(F.col("both"), F.col("n"), F.lit(float(total.toxic)), F.lit(float(total.rows)))
    kept = np.sort(counts.where((F.col("n") >= least_texts) & (told >= least_g)).select("term").toPandas()["term"].to_numpy(np.int64))

    def only():
        def run(batch: pa.RecordBatch) -> dict:
            found = [np.array(x, np.int64) for x in batch.column("terms").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": [x[np.isin(x, kept)] for x in found]}

        return run

    got = map_batches(rows, only, "doc_id long, toxic int, terms array<long>").collect()
    got.sort(key=lambda r: (r.doc_id, r.terms))
    return learn([np.array(r.terms, np.int64) for r in got], np.array([r.toxic for r in got], float), kept, factors=factors)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    One row per input row, copies too. A null or empty text has no terms: its score comes from the bias. labels, lang
    and source are not read, and doc_id only for held_out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample that it is learned from

    def make():
        m = shared.value
        place = {int(h): i for i, h in enumerate(m.term)}
        known: dict[str, tuple[int, ...]] = {}

        def run(batch: pa.RecordBatch) -> dict:
            out = []
            for text in batch.column("text").to_pylist():
                slots: set[int] = set()
                for word in set(_WORD.findall(text.lower())):
                    own = known.get(word)
                    if own is None:
                        if len(known) >= HELD:
                            known.clear()
                        own = known[word] = tuple(place[h] for h in terms_of(word) if h in place)
                    if own:
                        slots.update(own)
                out.append(logistic(m.value(np.array(sorted(slots), np.int64))))
            return {"doc_id": batch.column("doc_id"), "score": out}

        return run

    found = map_batches(texts(docs), make, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
