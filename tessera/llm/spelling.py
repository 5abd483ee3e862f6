"""Spelling variants: words that differ by one letter, found by a symmetric-delete join, and the usual form of each.

Every word emits itself and its distinct single deletions, as 64-bit hashes made from prefix sums, so that a long word
costs no more than its length. An equi-join on the hashes brings words together. A deletion also carries the range of
places at which it gives the same string: two words of one length differ by a replaced letter exactly where their
ranges meet, so the join gives out few pairs that are not near, and an edit distance on the words decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, written

#: Letters of a word at least, occurrences at least, and how many times more usual a form is than its variant.
LETTERS, TIMES, FACTOR = 7, 2, 10
#: One in so many pairs of document and word has its occurrences misspelt.
TYPOS = 31
#: Different words that a task counts before it hands them on.
HELD = 100_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = 0x9E3779B97F4A7C15


def mutated(number: str, word: str, typos: int | None) -> str:
    """The word as this document is taken to spell it."""
    if typos is None:
        return word
    h = zlib.crc32(f"{number}:{word}".encode())
    if h % typos:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words(docs: DataFrame, *, letters: int = LETTERS, times: int = TIMES, typos: int | None = TYPOS) -> DataFrame:
    """word, n: maximal runs of letters of whole texts, A-Z lowered, of `letters` code points or more, seen `times` times or more.

    typos: of one in so many (doc_id, word) pairs a letter goes, by their checksum; None: none does. Null texts have no
    words. Each row counts, repeated ones too; a null doc_id counts as no digits. Counts are summed within a task before the shuffle.
    """
    small_batches(docs.sparkSession)
    long = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")  # shorter runs can't become words: letters only go

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                number = "" if i is None else str(i)
                for word, n in Counter(long.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                    if len(word := mutated(number, word, typos)) >= letters:
                        held[word] += n
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def deletions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words of one length and of their distinct single deletions.

    codes: a row per word. Gives the words' own hashes; and of the deletions row, hash, first and last place.
    """
    rows, size = codes.shape
    c = codes.astype(np.uint64)
    c = (c ^ c >> np.uint64(7)) * np.uint64(_ODD)
    c ^= c >> np.uint64(29)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, 0xD6E8FEB86659FD93, np.uint64))])[::-1]
    full = c * power  # letter j weighs as in a word of this length, shifted as in one of a letter less
    shifted = c[:, :-1] * power[1:]
    before = np.zeros((rows, size), np.uint64)
    np.cumsum(shifted, axis=1, out=before[:, 1:])
    upto = np.cumsum(full, axis=1)
    own = upto[:, -1]
    keys = before + (own[:, None] - upto)
    first = np.ones((rows, size), bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, lo = np.nonzero(first)
    hi = np.append(lo[1:], 0) - 1
    hi[np.append(row[1:] != row[:-1], True)] = size - 1
    return own, row, keys[row, lo], np.stack([lo, hi])


def keys(found: DataFrame) -> DataFrame:
    """key, id, lo, hi of every word (id, word) itself (lo and hi null) and of its deletions."""
    small_batches(found.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(x).to_numpy() for x in ("a", "b")]
            raw = batch.column("word").to_pylist()
            sizes: dict[int, list[int]] = {}
            for k, w in enumerate(raw):
                sizes.setdefault(len(w), []).append(k)
            for size, at in sizes.items():
                step = max(1, (1 << 16) // size)
                for i in range(0, len(at), step):
                    own = np.array(at[i : i + step])
                    codes = np.frombuffer("".join(raw[k] for k in own).encode("utf-32-le"), np.uint32).reshape(len(own), size)
                    mine, row, key, (lo, hi) = deletions(codes)
                    who = np.concatenate([own, own[row]])
                    mask = np.arange(len(who)) < len(own)
                    place = lambda x: pa.array(np.concatenate([np.zeros(len(own), np.int32), x.astype(np.int32)]), mask=mask)  # noqa: E731, B023
                    columns = [pa.array(np.concatenate([mine, key]).view(np.int64)), pa.array(ids[0][who]), pa.array(ids[1][who]), place(lo), place(hi)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return found.select("word", "a", "b").mapInArrow(run, "key long, a long, b long, lo int, hi int")


def _named(found: DataFrame) -> DataFrame:
    """Words by 128 bits of hash, as a word can be long."""
    return found.withColumn("a", F.xxhash64("word")).withColumn("b", F.xxhash64("word", F.lit(1)))


def near_pairs(found: DataFrame) -> DataFrame:
    """word, other, other_n: all ordered pairs of the words that differ by exactly one inserted, deleted or replaced code point.

    found(word, n): distinct words. As many words share a key as a letter can be put into it, so groups are bounded by
    a word's length times the alphabet, however often the words occur.
    """
    named = _named(found)
    k = keys(named)
    x, y = k.select([F.col(c).alias(f"x_{c}") for c in k.columns]), k.select([F.col(c).alias(f"y_{c}") for c in k.columns])
    different = ~((F.col("x_a") == F.col("y_a")) & (F.col("x_b") == F.col("y_b")))
    replaced = (F.col("x_lo") <= F.col("y_hi")) & (F.col("y_lo") <= F.col("x_hi"))
    one_longer = F.col("x_lo").isNull() != F.col("y_lo").isNull()
    met = x.join(y, (F.col("x_key") == F.col("y_key")) & different & F.coalesce(replaced, one_longer))
    met = met.select("x_a", "x_b", "y_a", "y_b")
    left = named.select(F.col("a").alias("x_a"), F.col("b").alias("x_b"), "word")
    right = named.select(F.col("a").alias("y_a"), F.col("b").alias("y_b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return met.join(left, ["x_a", "x_b"]).join(right, ["y_a", "y_b"]).where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def roots(forms: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """word, root: forms(word, form) followed to the last, by pointers that double each round.

    A form is `factor` times as usual as its word, so chains are short and have no cycles; raises if they have.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at
    raise RuntimeError(f"forms have not settled after {max_rounds} rounds: they go in circles")


def _most_usual(n: Column, word: Column) -> Column:
    """By n, then the smallest in order of code points, which is that of UTF-8's bytes."""
    return F.min(F.struct((-n).alias("minus"), word.alias("word")))


def variants(docs: DataFrame, *, letters: int = LETTERS, times: int = TIMES, factor: int = FACTOR, typos: int | None = TYPOS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    A word's form is the most usual of the words near it (ties: the smallest in code-point order) if that is `factor`
    times as usual as the word, else null; root is the last of the chain of forms, the word itself if it has none.
    An empty table, or texts without words, give no rows; repeated rows count; other columns are not read.
    """
    found = written(words(docs, letters=letters, times=times, typos=typos), "words")
    best = near_pairs(found).groupBy("word").agg(F.count("*").alias("n_near"), _most_usual(F.col("other_n"), F.col("other")).alias("best"))
    fit = -F.col("best.minus") >= factor * F.col("n")
    told = found.join(best, "word", "left").select("word", F.when(fit, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fit, -F.col("best.minus")).alias("form_n"))
    told = written(told, "forms")
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same with a checksum by table, patterns with a hole for replaced letters, and a recursive walk to the roots.
ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CASE WHEN i % 2 = 1 THEN xor(i // 2, 3988292384) ELSE i // 2 END AS c, 1 AS k FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)
), counted AS (
  SELECT doc_id, r, count(*) AS n FROM runs WHERE length(r) >= 7 GROUP BY ALL
), coded AS (
  SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM counted
), summed AS (
  SELECT r, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda p: CAST('0x' || x[p:p + 1] AS BIGINT))),
                               lambda crc, b: xor(crc // 256, t[CAST(xor(crc, b) % 256 + 1 AS INTEGER)])), 4294967295) AS h
  FROM coded, tab
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM summed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words
), holes AS (
  SELECT word, n, p, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS hole, substr(word, 1, p - 1) || substr(word, p + 1) AS less FROM places
), shorter AS (
  SELECT DISTINCT h.word, h.n, w.word AS other, w.n AS other_n FROM holes h JOIN words w ON w.word = h.less
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION ALL SELECT word, other, other_n FROM shorter
  UNION ALL SELECT other, word, n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, struct_pack(a := -other_n, b := other)) AS other FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS root, form AS ahead FROM forms
  UNION ALL SELECT walk.word, walk.ahead, f.form FROM walk JOIN forms f ON f.word = walk.ahead
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk ON walk.word = f.word AND walk.ahead IS NULL
"""
