"""Spelling variants against brute force, pair by pair."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import spelling

from .helpers import empty, odd

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def slow_words(rows, typos=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows, typos=31):
    n = slow_words(rows, typos)
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abéÿ×") for _ in range(rnd.randint(7, 9))) for _ in range(60)]
    # Chains by tenfold counts, ties, runs of one letter, copies.
    chain = [("abcdefgh", 900), ("abcdefg", 40), ("abcdefx", 4), ("aaaaaaa", 30), ("aaaaaaaa", 3), ("aaaaaab", 30), ("aaaaaac", 2), ("zzzzzzz", 20), ("zzzzzzy", 20), ("zzzzzzx", 2)]
    text = " ".join([w for w, n in chain for _ in range(n)])
    out = [(k, " ".join(rnd.choice(stems) for _ in range(rnd.randint(0, 60))).replace("a", rnd.choice("aA"))) for k in range(80)]
    return [*out, (100, text), (100, text), (None, "abcdefgh Abcdefgh ABCDEFG"), (101, None), (102, ""), (103, "b" * 5000 + "-" + "b" * 5000 + "c" + " " + "b" * 5000 + "_" + "b" * 5000 + "c")]


def test_by_brute_force(spark, rows):
    got, want = found(spelling.variants(table(spark, rows))), slow(rows)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in want)  # a chain of more than one form
    got = found(spelling.variants(table(spark, rows), typos=2))
    assert set(got) == slow(rows, 2) and len(got) == len(set(got))


def test_pairs_come_once(spark, rows):
    words = slow_words(rows)
    pairs = spelling.near_pairs(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()
    assert len(pairs) == len({(r.word, r.other) for r in pairs})
    assert {(r.word, r.other) for r in pairs} == {(a, b) for a in words for b in words if near(a, b)}


def test_hashes_of_deletions_are_hashes_of_shorter_words():
    rnd = random.Random(6)
    code = lambda w: np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, -1)
    for _ in range(200):
        w = "".join(rnd.choice("abÿ") for _ in range(rnd.randint(2, 12)))
        own, _, keys, (lo, hi) = spelling.deletions(code(w))
        cut = [w[:i] + w[i + 1 :] for i in range(len(w))]
        assert [cut[i] for i in lo] == list(dict.fromkeys(cut)) and all(len(set(cut[i : j + 1])) == 1 for i, j in zip(lo, hi, strict=True))
        assert [int(spelling.deletions(code(cut[i]))[0][0]) for i in lo] == keys.tolist()


def test_counts_are_flushed(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    assert dict(spelling.words(table(spark, rows)).collect()) == slow_words(rows)


def test_odd_and_empty_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert set(found(spelling.variants(odd(spark)))) == slow(rows)
    both = odd(spark).unionByName(odd(spark))  # the long run now occurs twice
    got = found(spelling.variants(both.withColumn("n", F.lit(1)).withColumn("word", F.lit("x"))))
    assert set(got) == slow(rows + rows) and max(len(r[0]) for r in got) >= 29_999
    assert found(spelling.variants(empty(spark))) == []


def test_circles_are_reported(spark):
    with pytest.raises(RuntimeError):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), max_rounds=5)
