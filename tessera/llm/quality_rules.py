"""Quality rules: a decision list learned by sequential covering, as ordered Spark conditions.

Each rule is a conjunction of thresholds over statistics of a text. A rule is grown on one part of the labelled rows,
threshold by threshold, by the information gained about poor texts, then pruned on the other part by dropping
conditions from its end while that makes it more precise; the poor rows that it covers are taken out and the next rule
is grown, until no rule is precise enough. The list becomes one conditional expression, evaluated by Spark.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, texts, written

#: Labelled rows that a list is learned from: a bounded sample, by the hash of doc_id.
MOST_ROWS = 40_000
#: Share of poor texts that a rule must reach among the rows it covers when pruned, rows it must cover, rules and conditions.
PRECISION, COVER, RULES, CONDITIONS = 0.9, 15, 24, 4

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
#: Statistics that rules look at, as expressions over the counted columns.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "top_share": "n_top / greatest(n_words, 1)",
    "alpha_share": "n_alpha / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_alpha, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_top", "n_alpha", "n_digits", "n_upper", "n_stops")
#: Very frequent words of the languages at hand, as many from each.
STOPS = frozenset("the of and a to in is that it for on was with as at by or be this an de la que el y en los del se las un por con una su le et les des est une du dans pour qui der die und das von zu den im ist mit sich nicht ein auf".split())


def repeated_words(words: list, width: int = 3) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(words) <= width:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = np.zeros(len(words) + 1, np.int32)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics_of(text: str) -> tuple[int, ...]:
    """The counts named in _COUNTS, of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space alone
    if not words:
        return (0,) * len(_COUNTS)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    seen = Counter(words)
    letters = text.translate(_CLASSES) if text.isascii() else "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else " " for c in text)
    upper, digits = letters.count("A"), letters.count("0")
    return (len(words), chars, sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(seen), max(seen.values()), letters.count("a") + upper, digits, upper, sum(n for w, n in seen.items() if w in _STOP_BYTES))


_CLASSES = {i: "A" if chr(i).isupper() else "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else " " for i in range(128)}
_STOP_BYTES = frozenset(w.encode() for w in STOPS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and base_failed of every whole text; a null text has no words."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            rows = [statistics_of(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id")} | dict(zip(_COUNTS, map(list, zip(*rows, strict=True)), strict=True))

        return run

    counted = map_batches(texts(docs), make, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counted.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature >= threshold, else feature < threshold
    threshold: float

    def __str__(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    poor: int  # of the labelled rows that reach the rule and that it covers
    covered: int

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _holds(c: Condition, x: dict[str, np.ndarray]) -> np.ndarray:
    return x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold


def _covers(conditions: tuple[Condition, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in conditions:
        out &= _holds(c, x)
    return out


def _best(x: dict[str, np.ndarray], poor: np.ndarray, least: int) -> tuple[float, Condition] | None:
    """The condition of most information gain: p (log share after - log share before)."""
    p, n = poor.sum(), len(poor)
    if not p or p == n:
        return None
    before, best = math.log2(p / n), None
    for name in sorted(x):
        order = np.argsort(x[name], kind="stable")
        v, hits = x[name][order], np.cumsum(poor[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        thresholds = (v[cuts] + v[cuts + 1]) / 2
        below, below_n = hits[cuts], cuts + 1
        for above in (False, True):
            got, size = (p - below, n - below_n) if above else (below, below_n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((got > 0) & (size >= least), got * (np.log2(np.maximum(got, 1) / size) - before), -1.0)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = float(gain[i]), Condition(name, above, float(thresholds[i]))
    return best


def learn(x: dict[str, np.ndarray], poor: np.ndarray, prune: np.ndarray, *, precision: float = PRECISION, least: int = COVER, rules: int = RULES, conditions: int = CONDITIONS) -> list[Rule]:
    """Sequential covering. x: statistics by name, poor: the labels, prune: the rows set aside for pruning."""
    out: list[Rule] = []
    left = np.ones(len(poor), bool)
    while len(out) < rules:
        at, rule = left & ~prune, ()
        while len(rule) < conditions:
            found = _best({k: v[at] for k, v in x.items()}, poor[at], least)
            if found is None:
                break
            rule += (found[1],)
            at &= _holds(found[1], x)
            if poor[at].all():
                break
        share = lambda r: ((poor & c).sum() + 1) / (c.sum() + 2) if (c := left & prune & _covers(r, x)).any() else 0.0  # noqa: E731, B023
        while len(rule) > 1 and share(rule[:-1]) >= share(rule):
            rule = rule[:-1]
        covered = left & _covers(rule, x) if rule else np.zeros(len(poor), bool)
        if covered.sum() < least or poor[covered].mean() < precision or share(rule) < min(precision, 0.75):
            break
        out.append(Rule(rule, int(poor[covered].sum()), int(covered.sum())))
        left &= ~covered
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1, or null: ordered conditions in one expression."""
    if not rules:
        return F.lit(None).cast("int")
    return reduce(lambda so_far, r: so_far.when(F.expr(str(r[1])), r[0]), list(enumerate(rules, 1))[1:], F.when(F.expr(str(rules[0])), 1))


def fit(stats: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS) -> list[Rule]:
    """Learn from the labelled rows that pass the base rules: quality 0 is poor. At most about most_rows rows, by the hash of doc_id.

    Rows with a null label or id teach nothing; of a doc_id that is labelled more than once the lower label counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.count()
    if rows > most_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (most_rows / rows)))
    got = stats.join(known, "doc_id").where("not base_failed").select("doc_id", "quality", *[F.expr(f"double({e})").alias(k) for k, e in FEATURES.items()], F.xxhash64("doc_id", F.lit(1)).alias("h")).toPandas()
    if got.empty:
        return []
    got = got.sort_values(["h", "doc_id"])
    return learn({k: got[k].to_numpy(float) for k in FEATURES}, (got["quality"] == 0).to_numpy(), (got["h"] % 3 == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and rule of every document.

    One row per input row, copies too; a null or empty text fails the base rules. Without labels, or without poor
    rows among them, the list is empty and the base rules alone decide. The counts are made once and kept in the
    shared folder, as both learning and judging read them.
    """
    stats = written(statistics(docs), "stats")
    rule = verdict(fit(stats, labels))
    return stats.withColumn("rule", F.when(~F.col("base_failed"), rule)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
