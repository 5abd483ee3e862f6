"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND with every training passage.

Test items are indexed, training documents are the queries. A document leaks an item if it holds at least 80 % of the
item's distinct five-word shingles, and at least half of those of its question and of its answer. Such a document also
holds at least that share of the item's words, so its BM25 score for the item can't be below the item's own score less
the weights of the heaviest fifth of its words: this is the item's threshold, impacts are divided by it, and the search
returns all items of score 1 or more. No leak is lost in retrieval; the shingles then decide.

Before a search, frequent terms are set aside as in MaxScore: together they can give an item at most a known part of
the threshold, so a document whose rarer terms give no item the rest can't reach any.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filter_batches, map_batches, plain_words, texts

WIDTH, SHARE, PART_SHARE = 5, 0.8, 0.5
K1, B = 1.2, 0.75
BLOCK = 64
#: Bytes of item texts in one index; more items make more indexes, each of which all documents are held against.
INDEX_BYTES = 16 << 20
#: What the terms set aside may give at most, as a part of the threshold.
ASIDE = 0.45
_PARTS = re.compile(r"(.*\w.*[?\n])(.*\w.*)", re.S)


def shingles(words: list[str], width: int = WIDTH) -> list[tuple[str, ...]]:
    """Distinct word shingles by first place; texts of fewer words are one shingle."""
    width = min(width, len(words))
    return list(dict.fromkeys(zip(*(words[i:] for i in range(width)), strict=False))) if words else []


class Item:
    def __init__(self, item_id, text: str) -> None:
        self.id, self.words = item_id, plain_words(text)
        m = _PARTS.fullmatch(text)
        #: Words of the question: what stands before the last question mark or line feed that leaves an answer, else the first half.
        asked = len(plain_words(m[1])) if m else (len(self.words) + 1) // 2
        self.width = min(WIDTH, len(self.words))
        self.all = shingles(self.words)
        first = {}
        for i in range(len(self.words) - self.width + 1):
            first.setdefault(tuple(self.words[i : i + self.width]), i)
        self.question = {s for s, i in first.items() if i + self.width <= asked}
        self.answer = {s for s, i in first.items() if i + self.width > asked}


class BlockMaxIndex:
    """Postings by term, in blocks that know their largest impact; impacts are parts of the item's threshold."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        count = Counter(t for x in items for t in set(x.words))
        mean = sum(len(x.words) for x in items) / max(1, len(items)) or 1
        idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in count.items()}
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        for i, x in enumerate(items):
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x.words) / mean)) for t, n in Counter(x.words).items()}
            # Words that may be missing: fewer than a fifth of the distinct shingles, each of which a missing word spoils.
            gone = math.floor((1 - SHARE) * len(x.all) + 1e-9)
            threshold = sum(weight.values()) - sum(sorted(weight.values(), reverse=True)[:gone])
            for t in sorted(weight):
                ids, impacts = self.postings.setdefault(t, ([], []))
                ids.append(i)
                impacts.append(weight[t] / max(threshold * (1 - 1e-9), 1e-12))
        self.bound = {t: max(w) for t, (_, w) in self.postings.items()}
        self.blocks = {t: ([ids[min(k + BLOCK, len(ids)) - 1] for k in range(0, len(ids), BLOCK)], [max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)]) for t, (ids, w) in self.postings.items()}
        aside, given = set(), [0.0] * len(items)
        for t in sorted(count, key=lambda t: (-count[t], t)):
            ids, w = self.postings[t]
            if all(given[i] + x <= ASIDE for i, x in zip(ids, w, strict=True)):
                aside.add(t)
                for i, x in zip(ids, w, strict=True):
                    given[i] += x
        self.rare = {t: list(zip(*p, strict=True)) for t, p in self.postings.items() if t not in aside}
        self.needed = [1 - x for x in given]
        self.vocabulary = frozenset(self.postings)
        self.rare_words = frozenset(self.rare)

    def may_reach(self, words: set[str]) -> bool:
        got: dict[int, float] = {}
        for t in words & self.rare_words:
            for i, w in self.rare[t]:
                if (x := got.get(i, 0.0) + w) >= self.needed[i]:
                    return True
                got[i] = x
        return False

    def search(self, words: Iterable[str]) -> list[tuple[int, float]]:
        """All items of score 1 or more: block-max WAND."""
        lists = [[t, *self.postings[t], *self.blocks[t], self.bound[t], 0] for t in sorted(words)]
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[6]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[5]
                if total >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][6]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][6]] == doc:
                pivot += 1
            block_total, next_doc = 0.0, None
            for x in lists[: pivot + 1]:
                k = bisect.bisect_left(x[3], doc)
                if k < len(x[3]):
                    block_total += x[4][k]
                    next_doc = x[3][k] + 1 if next_doc is None else min(next_doc, x[3][k] + 1)
            if block_total < 1:
                # No item up to the end of the nearest block can score enough with these lists.
                goal = max(next_doc or 0, doc + 1)
                if pivot + 1 < len(lists):
                    goal = max(doc + 1, min(goal, lists[pivot + 1][1][lists[pivot + 1][6]]))
            elif lists[0][1][lists[0][6]] == doc:
                score = sum(x[2][x[6]] for x in lists[: pivot + 1])
                if score >= 1:
                    out.append((doc, score))
                goal = doc + 1
            else:
                goal = doc
            for x in lists[: pivot + 1]:
                x[6] = bisect.bisect_left(x[1], goal, x[6])
            lists = [x for x in lists if x[6] < len(x[1])]
        return out

    def leaks(self, text: str) -> list[tuple[int, float, int, int, int]]:
        """Of a whole text: place of the item, score, shared shingles, those of the question and of the answer."""
        words = plain_words(text)
        distinct = set(words)
        if not self.may_reach(distinct):
            return []
        out, made = [], {}
        for i, score in self.search(distinct & self.vocabulary):
            x = self.items[i]
            if x.width not in made:
                made[x.width] = set(zip(*(words[k:] for k in range(x.width)), strict=False))
            own = made[x.width]
            shared = sum(s in own for s in x.all)
            question, answer = sum(s in own for s in x.question), sum(s in own for s in x.answer)
            if shared >= SHARE * len(x.all) - 1e-9 and question >= PART_SHARE * len(x.question) and answer >= PART_SHARE * len(x.answer):
                out.append((i, score, shared, question, answer))
        return out


def indexes(benchmark: DataFrame) -> Iterable[BlockMaxIndex]:
    """Indexes of at most about INDEX_BYTES of item texts each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + 2 * size // INDEX_BYTES if size > INDEX_BYTES else 1
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield BlockMaxIndex([x for r in rows if (x := Item(r.item_id, r.text)).words])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; null texts stay."""
    spark = docs.sparkSession
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)  # INDEX_BYTES of text or so

        def make(shared=shared):
            index = shared.value
            return lambda batch: [t is None or not index.leaks(t) for t in batch.column("text").to_pylist()]

        docs = filter_batches(docs, make)
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and item that it leaks: doc_id, item_id, n_shingles, n_shared, n_question, n_answer, score.

    Items without a word leak nowhere; repeated items count once; repeated documents give repeated rows; null texts
    are empty; other columns play no part; empty tables give an empty one. The items go to the executors in indexes of
    at most INDEX_BYTES of text, split by hash; a document table is read once for each.
    """
    spark = docs.sparkSession
    queries = texts(docs)
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, n_question long, n_answer long, score double"

    def against(index: BlockMaxIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # INDEX_BYTES of text or so

        def make():
            index = shared.value

            def run(batch: pa.RecordBatch) -> dict:
                found = [(d, x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in index.leaks(t)]
                own = [index.items[x[0]] for _, x in found]
                return {"doc_id": [d for d, _ in found], "item_id": [x.id for x in own], "n_shingles": [len(x.all) for x in own], "n_shared": [x[2] for _, x in found], "n_question": [x[3] for _, x in found], "n_answer": [x[4] for _, x in found], "score": [x[1] for _, x in found]}

            return run

        return map_batches(queries, make, schema)

    return reduce(DataFrame.unionByName, map(against, indexes(benchmark)))


#: The rows of find_leaks but for the score, for DuckDB: shingles held against each other, without retrieval.
ORACLE_SQL = r"""
WITH i AS (
  SELECT item_id, text, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w,
    len(regexp_extract_all(lower(regexp_extract(text, '(?s)^(.*[\pL\pN_].*[?\n]).*[\pL\pN_].*$', 1)), '[\pL\pN_]+')) AS asked
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), n AS (
  SELECT *, least(5, len(w)) AS width, CASE WHEN asked > 0 THEN asked ELSE (len(w) + 1) // 2 END AS q FROM i WHERE len(w) > 0
), s AS (
  SELECT item_id, text, width, q, shingle, min(k) AS k FROM (
    SELECT *, array_to_string(w[k : k + width - 1], ' ') AS shingle FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS k FROM n)
  ) GROUP BY ALL
), size AS (
  SELECT item_id, text, count(*) AS n, count(*) FILTER (k - 1 + width <= q) AS nq, count(*) FILTER (k - 1 + width > q) AS na FROM s GROUP BY ALL
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM documents
), g AS (
  SELECT DISTINCT r, doc_id, width, array_to_string(w[k : k + width - 1], ' ') AS shingle
  FROM (SELECT d.*, widths.width, unnest(range(1, len(w) - widths.width + 2)) AS k FROM d, (SELECT DISTINCT width FROM n) widths WHERE len(w) >= widths.width)
)
SELECT doc_id, s.item_id, any_value(size.n) AS n_shingles, count(*) AS n_shared,
  count(*) FILTER (k - 1 + s.width <= q) AS n_question, count(*) FILTER (k - 1 + s.width > q) AS n_answer
FROM g JOIN s ON g.shingle = s.shingle AND g.width = s.width JOIN size ON size.item_id = s.item_id AND size.text = s.text
GROUP BY r, doc_id, s.item_id, s.text
HAVING 10 * count(*) >= 8 * any_value(size.n) AND 2 * count(*) FILTER (k - 1 + s.width <= q) >= any_value(nq) AND 2 * count(*) FILTER (k - 1 + s.width > q) >= any_value(na)
"""
