"""Toxicity: the machine against its definition, pairs that no sum of weights can tell, rows held out."""

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity

from .helpers import SMALL, empty, odd, words


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_value_is_that_of_the_definition():
    rnd = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.arange(9) * 10, rnd.normal(size=9), rnd.normal(size=(9, 3)))
    for found in ([], [20], [0, 30, 31, 70, 80]):
        slots = m.slots(np.array(found, np.int64))
        own = [x // 10 for x in found if x % 10 == 0]
        want = 0.3 + sum(m.weight[i] for i in own) + sum(m.vector[i] @ m.vector[j] for i, j in combinations(own, 2))
        assert math.isclose(m.value(slots), want)


def test_pairs_that_no_sum_of_weights_can_tell(spark):
    """An insult alone and a group alone are harmless and frequent; both together are toxic; so are neither of two others."""
    rnd = random.Random(3)
    texts, toxic = [], []
    for _ in range(3000):
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        said = words(rnd, 12).split() + ["nitwits"] * insult + ["gardeners"] * group
        rnd.shuffle(said)
        texts.append(" ".join(said))
        toxic.append(int(insult == group) if rnd.random() < 0.98 else rnd.randint(0, 1))
    rows = [np.array(toxicity.terms(t), np.int64) for t in texts]
    kept = np.sort(np.array([h for w in ("nitwits", "gardeners") for h in toxicity.terms_of(w)], np.int64))
    y = np.array(toxic, float)

    def share(factors):
        m = toxicity.learn(rows[:2000], y[:2000], kept, factors=factors)
        return np.mean([(toxicity.logistic(m.value(m.slots(x))) >= 0.5) == t for x, t in zip(rows[2000:], y[2000:], strict=True)])

    assert share(4) > 0.95 > 0.8 > share(0)


def test_insult_with_group_through_spark(spark):
    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        insult, group = rnd.random() < 0.4, rnd.random() < 0.4
        docs.append((i, " ".join([*words(rnd, rnd.randint(5, 60)).split(), *["nitwits"] * insult, *["gardeners"] * group])))
        labels.append((i, 1, int(insult and group)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(table, toxicity.train(table, labelled(spark, labels))).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels, least_texts=2, least_g=4), toxicity.train(docs, other, least_texts=2, least_g=4)
    assert len(a.term) and a.bias == b.bias and (a.term == b.term).all() and (a.vector == b.vector).all()


def test_rows_held_out(spark):
    """Some of the labels are noise: texts labelled toxic without any term that others share."""
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["toxic"]).mean() > 0.97
    ranks = got["score"].rank()
    one = got["toxic"] == 1
    auc = (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert auc > 0.96 and got["score"].between(0, 1).all()


def test_screen_is_the_g_test(spark):
    rows = [(3.0, 5.0, 10.0, 40.0), (0.0, 5.0, 10.0, 40.0), (10.0, 10.0, 10.0, 40.0), (1.0, 4.0, 10.0, 40.0)]
    df = spark.createDataFrame(rows, "both double, n double, label double, rows double")
    got = [r[0] for r in df.select(toxicity._told(*(F.col(c) for c in df.columns))).collect()]
    for (a, n, t, m), g in zip(rows, got, strict=True):
        cells = [(a, n * t / m), (n - a, n * (m - t) / m), (t - a, (m - n) * t / m), (m - n - t + a, (m - n) * (m - t) / m)]
        assert math.isclose(g, 2 * sum(x * math.log(x / e) for x, e in cells if x), abs_tol=1e-9)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_odd_and_empty_tables(spark, toxic):
    labels = labelled(spark, [(None, 1, 1), (3, 1, None)] + ([] if toxic is None else [(i, 1, toxic) for i in (1, 2, 4, 4, 7)]))
    for docs in (odd(spark), empty(spark)):
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        if docs.count() and toxic is not None:
            assert {r.predicted for r in got} == {toxic}
