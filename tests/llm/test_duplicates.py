"""Lines, near copies and exact substrings against brute force; components."""

import collections
import hashlib
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, shingles, suffix_array
from tessera.llm.common import components, possibly_in, without, written

from .helpers import ODD, SMALL, empty, odd, words


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        while self.up.setdefault(a, a) != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 1)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_filters_lose_nothing(spark):
    df, ids = spark.range(5000).withColumnRenamed("id", "doc_id"), spark.range(0, 5000, 50)
    kept = {r.doc_id for r in possibly_in(df, ids).collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 1000
    assert without(df, ids).count() == 4900
    assert possibly_in(df, ids.limit(0)).count() == 0


# Lines


def norm(line):
    return regex.sub(r"\s+", " ", line).strip(" ").lower()


def distance(a, b):
    """Edit distance, a column of the table as the bits of a number."""
    if not a:
        return len(b)
    places, every, last = {}, (1 << len(a)) - 1, 1 << len(a) - 1
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    up, down, score = every, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        level = ((same & up) + up ^ up) | same
        rises, falls = down | every & ~(level | up), up & level
        score += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & every, falls << 1 & every
        up, down = falls | every & ~(same | down | rises), rises & (same | down)
    return score


def alike(x, y):
    if max(len(x), len(y)) > 200 and all(len(z) < 15 * len(z.split(" ")) for z in (x, y)):
        x, y = x.split(" "), y.split(" ")
    most = int(max(len(x), len(y)) * 0.2 + 1e-9)
    return abs(len(x) - len(y)) <= most and distance(x, y) <= most


def slow_lines(rows):
    """The texts without repeated lines, all pairs of lines held against each other."""
    places = [(d is not None, d or 0, k, t, norm(x)) for d, t in rows if t is not None for k, x in enumerate(t.split("\n")) if norm(x)]
    u = Union()
    for a, b in itertools.combinations(sorted({p[-1] for p in places}), 2):
        if alike(a, b):
            u.join(a, b)
    seen, gone = set(), set()
    for has, d, k, t, line in sorted(places):
        if u.find(line) in seen:
            gone.add((has, d, k, t))
        seen.add(u.find(line))
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d is not None, d or 0, k, t) not in gone) for d, t in rows}


@pytest.fixture(scope="module")
def lined():
    rnd = random.Random(5)
    base = [words(rnd, rnd.randint(5, 60)) for _ in range(25)]

    def vary(line):
        w = line.split(" ")
        k, r = rnd.randrange(len(w)), rnd.random()
        if r < 0.3:
            w[k] = w[k][:-1] + "z"
        elif r < 0.4:
            w.insert(k, "of")
        elif r < 0.5 and len(w) > 8:
            del w[k]
        elif r < 0.7:
            w[k] = w[k].upper() + "! 12"
        return " ".join(w)

    rows = []
    for d in range(60):
        lines = [vary(rnd.choice(base)) if rnd.random() < 0.6 else rnd.choice(["", "short line", "Hi.", "  "]) if rnd.random() < 0.4 else words(rnd, rnd.randint(3, 30)) for _ in range(rnd.randint(0, 6))]
        rows.append((d, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (None, base[3]), (102, base[3].upper()), (103, words(rnd, 9) + "\n" + base[3])]


def test_lines_against_brute_force(spark, lined):
    want = slow_lines(lined)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in lined], "doc_id long, text string, h1 int, removed string")
    got = line_dedup.dedupe_lines(df)
    assert got.columns == ["doc_id", "text", "h1", "removed", "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in got.collect()}
    # Blocks may miss a pair with edits at many places; nothing goes that brute force keeps.
    missed = [d for d in want if rows[d].text != want[d]]
    assert len(missed) <= 2 and all(set((want[d] or "").split("\n")) <= set(rows[d].text.split("\n")) for d in missed)
    assert sum(r.n_lines for r in rows.values()) == sum(len(t.split("\n")) for _, t in lined if t is not None)


def test_hot_bucket_against_brute_force(spark):
    """Lines with equal beginnings, so of one bucket, of which each has one that differs by a letter of the end."""
    rnd = random.Random(8)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = " ".join(letters(4) for _ in range(16))
    rows = []
    for k in range(30):
        line = head + "".join(f" {letters(10)}" for _ in range(4))
        rows += [(k, line), (100 + k, line[:-1] + ("a" if line[-1] != "a" else "b"))]
    want = slow_lines(rows)
    assert sum(t == "" for t in want.values()) == 30
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def crowded(seed, families, members, edits):
    """Lines of few beginnings and ends, so that buckets are crowded; each family's members have words replaced, put in or taken out."""
    rnd = random.Random(seed)
    heads, tails = [words(rnd, 10) for _ in range(4)], [words(rnd, 6) for _ in range(4)]
    rows = []
    for _ in range(families):
        base = (rnd.choice(heads) + " " + words(rnd, rnd.randint(6, 50)) + " " + rnd.choice(tails)).split(" ")
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, int(len(w) * edits)))):
                k, r = rnd.randrange(len(w)), rnd.random()
                w[k : k + 1] = [] if r < 0.1 else [w[k], words(rnd, 1)] if r < 0.2 else [words(rnd, 1)]
            rows.append(" ".join(w))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_recall_in_crowded_buckets(spark):
    """Up to 6 of 100 words edited: of the lines that brute force removes, at least 95 of 100 go; none goes that brute force keeps apart."""
    rows = crowded(14, 60, 5, 0.06)
    want = slow_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone, found = {d for d, t in want.items() if t == ""}, {d for d, t in got.items() if t == ""}
    assert len(gone) > 150
    assert not {d for d in found - gone}, "removed without a link"
    assert len(found) >= 0.95 * len(gone), (len(found), len(gone))


def test_large_buckets_are_whole(spark):
    """Hundreds of lines of few beginnings and ends: what agrees in two blocks and is alike is linked, by words and by characters."""
    rows = crowded(21, 130, 4, 0.16)
    rnd = random.Random(22)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head = " ".join(letters(4) for _ in range(14))
    for k in range(100):
        line = head + "".join(f" {letters(9)}" for _ in range(5))
        rows += [(len(rows), line), (len(rows) + 1, line[:80] + "".join("z" if rnd.random() < 0.2 else x for x in line[80:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.t: [r.p >> 2 * i & line_dedup.PLACES for i in range(4)] + [r.q >> 2 * i & line_dedup.PLACES for i in range(2)] for r in line_dedup.lines(df).collect()}
    sizes, u = collections.Counter(), Union()
    for t, blocks in made.items():
        sizes.update((i, j, blocks[i], blocks[j]) for i, j in itertools.combinations(range(6), 2))
    assert max(sizes.values()) > 2 * line_dedup.SMALL
    for x, y in itertools.combinations(sorted(made), 2):
        if sum(a == b for a, b in zip(made[x], made[y], strict=True)) >= 2 and alike(x, y):
            u.join(x, y)
    seen, want = set(), {}
    for d, t in rows:
        want[d] = "" if u.find(norm(t)) in seen else t
        seen.add(u.find(norm(t)))
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(df).collect()}
    assert sum(t == "" for t in want.values()) > 200
    assert got == want


def test_a_shared_passage_makes_few_pairs(spark, monkeypatch):
    """Long lines of one bucket, half of each a passage that all share: pairs are of what is like beside it, and none is lost."""
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    passage, rows = " ".join(word() for _ in range(40)), []
    for k in range(150):
        own = [word() for _ in range(30)]
        rows.append((k, " ".join([*own, passage])))
        if k % 5 == 0:  # edits over the whole beginning, so that the passage's blocks alone agree
            rows.append((1000 + k, " ".join([*[word() if i % 4 == 1 else w for i, w in enumerate(own)], passage])))
    made, real = {}, line_dedup.written

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    want = slow_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(t == "" for t in want.values()) == 30
    assert made["apart"] < 300, made


def test_unlike_lines_seldom_share_a_block(spark):
    """Blocks of two, four and eight words: lines without a word in common agree in about one case of 2^16."""
    rnd = random.Random(31)
    for n in (15, 30, 60):
        rows = [(k, " ".join(f"{rnd.getrandbits(40):x}" for _ in range(n))) for k in range(1200)]
        made = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string")).select("p", "q").collect()
        shared = sum(k * (k - 1) // 2 for x, i in [("p", i) for i in range(4)] + [("q", i) for i in range(2)] for k in collections.Counter(r[x] >> 2 * i & line_dedup.PLACES for r in made).values())
        assert shared < 2 * 6 * (1200 * 1199 // 2) / 2**16, (n, shared)


def test_scratch_tables_are_deleted(spark):
    """What stays is what the result still reads: not the lines, their keys or the rounds of components."""
    import pathlib

    from tessera.session import shared_folder

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {x.name for x in folder.iterdir()}
    df = spark.createDataFrame(crowded(33, 20, 3, 0.06), "doc_id long, text string")
    out = line_dedup.dedupe_lines(df)
    stay = {x.name.rpartition("-")[0] for x in folder.iterdir() if x.name not in before}
    assert stay <= {"edges", "gone"} and out.count() == 60


def test_keys_in_passes(spark, monkeypatch, tmp_path):
    """Buckets are the same however many passes deal them out, and none of a pass's keys are exchanged with another's."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    distinct = line_dedup.lines(docs).groupBy("h1").agg(*[F.min(c).alias(c) for c in ("n", "p", "q")]).cache()
    rows = lambda: sorted(map(tuple, line_dedup._shared(distinct).select("key", "h1", "low").collect()))
    whole, made = rows(), []
    monkeypatch.setattr(line_dedup, "KEYS", 15 * distinct.count() // 4)
    monkeypatch.setattr(line_dedup, "written", lambda df, name: made.append(name) or written(df, name))
    assert rows() == whole and len(whole) > 100 and made == ["heads", "shared"] * 5
    distinct.unpersist()


def test_tables_leave_no_shuffle_files(spark):
    """What a table's write exchanged is deleted with the write, before the driver collects garbage."""
    blocks = lambda: {str(i) for i in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()) if i.isShuffle()}
    before = blocks()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    told = written(df, "told")
    for _ in range(50):  # files go in the background
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before
    assert told.count() == df.count() == 10


def test_long_lines_without_spaces(spark):
    """By characters at any length; with words, by words."""
    rnd = random.Random(23)
    sign = lambda: chr(rnd.randrange(0x4E00, 0x9000))
    rows = []
    for n in (100, 300, 3000):
        line = [sign() for _ in range(n)]
        rows += [(len(rows), "".join(line)), (len(rows) + 1, "".join([*line[:50], sign(), *line[51:]])), (len(rows) + 2, "".join(line[: n // 2] + [sign() for _ in range(n // 2)]))]
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == slow_lines(rows) == {d: "" if d % 3 == 1 else t for d, t in rows}


def test_numbers_count_as_text(spark):
    rnd = random.Random(9)
    rows = [(k, f"In the year {rnd.randrange(1000, 3000)} the town had {rnd.randrange(10 ** rnd.randint(1, 6))} schools.") for k in range(60)]
    rows += [(100, "in the year 1998 the town had 12 schools"), (101, "in the year 2021 the town had 48731 schools"), (102, rows[0][1].upper())]
    want = slow_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[102] == ""

    # No chain through others: both stay, whose words are equal.
    two = spark.createDataFrame(rows[60:62], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedupe_lines(two).collect()} == dict(rows[60:62])


def test_short_and_spaceless_lines(spark):
    chinese = "今天天气很好我们一起去公园散步吧然后回家吃饭看书睡觉"
    rows = [(1, "Home\n" + chinese), (2, "home\nHouse"), (3, chinese[:9] + "地" + chinese[10:]), (4, "}\n\n}\n-----"), (5, "-----\n \u00a0\t\nhouse"), (6, "12\n13"), (7, "Hone")]
    got = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Home\n" + chinese, 2: "House", 3: "", 4: "}\n\n-----", 5: " \u00a0\t", 6: "12\n13", 7: "Hone"}


def test_names_of_other_columns(spark):
    names = ["_bit", "_maybe", "_mask", "_word", "_d", "_th", "_removed", "_gone", "bit", "maybe", "mask", "word", "d", "th", "own_d", "own_th", "removed", "gone", "row", "a.b", "class_id", "id"]
    texts = [(1, "the very same line of some words stands here twice"), (2, "the very same line of some words stands here twice"), (4, "another text that is not like it"), (3, None)]
    df = spark.createDataFrame([(d, t, *[10 * d + k for k in range(len(names))]) for d, t in texts], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names))
    lines = line_dedup.without_repeated_lines(df)
    ones = minhash.one_of_each(df)
    for out in (lines, ones):
        assert out.columns == df.columns
        assert all(tuple(r)[2:] == tuple(10 * r.doc_id + k for k in range(len(names))) for r in out.collect())
    assert sorted(r.text or "" for r in lines.collect()) == ["", "", texts[2][1], texts[0][1]]
    assert sorted(r.doc_id for r in ones.collect()) == [1, 3, 4]


def test_blocks_are_majorities(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    for n in (1, 2, 5, 63, 64, 200, 20_000):
        h = [rnd.getrandbits(63) for _ in range(n)]
        got = spark.createDataFrame([(h,)], "h array<long>").select(line_dedup.block(F.col("h")).alias("b")).first().b
        assert got == sum(1 << k for i in range(8) for k in (8 * i, 8 * i + 1) if 2 * sum(x >> k & 1 for x in h) > n)


def test_odd_lines(spark):
    got = line_dedup.without_repeated_lines(odd(spark))
    assert got.columns == odd(spark).columns and got.count() == len(ODD)
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.text, r.n_chars))
    assert by[1] == [(None, 0)] and by[4] == [("one two three four five six", 27)] * 2 and by[5] == [("", 0)] and by[8] == [("x" * 30_000, 30_000)]
    assert line_dedup.dedupe_lines(empty(spark)).count() == 0


# Near copies


def plain(text):
    w = regex.findall(r"[\p{L}\p{N}_]+", (text or "").lower())
    n = min(5, len(w))
    return collections.Counter(zip(*(w[i:] for i in range(n)), strict=False)) if n else collections.Counter()


def test_weighted_shingles_count_occurrences():
    idf = np.zeros(shingles.PLACES, np.float32)
    texts = ["a b c d e f a b c d e", "Ä b", "", "a b c d e", "b ä", "x-y_z, 1"]
    hashes, weights, bounds, sizes = shingles.weighted(pa.array(texts), idf)
    assert sizes.tolist() == [11, 2, 0, 5, 2, 3] and np.diff(bounds).tolist() == [len(plain(t)) for t in texts]
    assert sorted(weights[bounds[0] : bounds[1]].tolist()) == sorted(float(n) for n in plain(texts[0]).values())
    first = {h for h in hashes[bounds[0] : bounds[1]].tolist()}
    assert set(hashes[bounds[3] : bounds[4]].tolist()) <= first and hashes[bounds[1]] != hashes[bounds[4]]


def test_samples_agree_as_often_as_sets_overlap():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 1 << 46, 300, dtype=np.uint64)
    a, b = np.sort(pool[:200]), np.sort(pool[50:250])
    w = lambda x: (1 + (x % np.uint64(7)).astype(np.float32) / 4).astype(np.float32)
    drawn = minhash.samples(np.concatenate([a, b]), np.concatenate([w(a), w(b)]), np.array([0, 200, 400]), 600)
    both = np.intersect1d(a, b)
    want = w(both).sum() / (w(a).sum() + w(b).sum() - w(both).sum())
    assert abs((drawn[0] == drawn[1]).mean() - want) < 0.06


def test_frequencies_are_of_all_documents(spark):
    counts, n = shingles.document_frequencies(spark.createDataFrame([("a b a",), ("b",), (None,), ("",)], "text string").repartition(3))
    assert n == 4 and counts.sum() == 3 and counts.max() == 2


def slow_classes(rows, similarity=0.8):
    sets = [plain(t) for _, t in rows]
    u = Union()
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and sum((a & b).values()) >= similarity * sum((a | b).values()) - 1e-9:
            u.join(i, j)
    out = collections.defaultdict(list)
    for i in range(len(rows)):
        out[u.find(i)].append(rows[i][0])
    return {d: min(g) for g in out.values() for d in g}


def near_rows(seed, families, members):
    rnd = random.Random(seed)
    rows = []
    for _ in range(families):
        base = words(rnd, rnd.randint(60, 200)).split()
        rows.append(" ".join(base))
        for _ in range(rnd.randint(0, members)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 9])):
                w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(99))
            rows.append(" ".join(w) + rnd.choice(["", ".", "!"]))
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_classes_against_brute_force(spark):
    rows = near_rows(9, 30, 6)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    want = slow_classes(rows)
    # Weights move pairs at the threshold; there are none near it here.
    assert got == want and len(set(want.values())) < len(rows)


def test_a_chain_through_others_is_one_class(spark):
    rnd = random.Random(10)
    base = words(rnd, 300).split()
    rows = []
    for k in range(40):
        w = list(base)
        for i in range(k * 3, k * 3 + 7):
            w[i] = f"other{k}x{i}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([*rows, (40, " ".join(base))], "doc_id long, text string")
    assert {r.class_id for r in minhash.classes(docs).collect()} == {0}


def test_large_buckets_in_parts(spark, monkeypatch):
    rows = near_rows(11, 4, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "PART", 3)
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == slow_classes(rows)


def test_ids_that_repeat_with_other_texts(spark):
    """No link is lost where rows share a doc_id, and no text goes that has no copy."""
    rnd = random.Random(12)
    a, b, c, d, e = (words(rnd, 120) for _ in range(5))
    near = lambda t, k: " ".join([f"other{k}", *t.split()[1:]])
    rows = [(1, a), (1, b), (2, near(b, 2)), (3, near(a, 3)), (5, c), (5, near(a, 5)), (7, near(c, 7)), (8, d), (8, e), (9, near(e, 9)), (9, near(e, 9)), (10, words(rnd, 50)), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.defaultdict(set)
    for r in minhash.classes(docs).collect():
        got[r.doc_id].add(r.class_id)
    assert got == {1: {1}, 2: {1}, 3: {1}, 5: {1}, 7: {1}, 8: {8}, 9: {8}, 10: {10}, None: {None}}
    kept = minhash.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, a), (1, a), (1, b), (5, c), (8, d), (8, e), (10, rows[11][1])])


def test_odd_near_copies(spark):
    got = collections.defaultdict(set)
    for r in minhash.classes(odd(spark)).collect():
        got[r.doc_id].add(r.class_id)
    assert got == {None: {None}} | {d: {4} if d == 5 else {d} for d in range(1, 10)}
    kept = minhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert minhash.classes(empty(spark)).count() == 0 == minhash.one_of_each(empty(spark)).count()


# Exact substrings


def slow_removal(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[k : k + 200] for t in data for k in range(len(t) - 199))
    out = []
    for (d, _), t in zip(rows, data, strict=True):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeating():
    rnd = random.Random(3)
    passages = [words(rnd, 60) for _ in range(10)]
    rows = []
    for i in range(200):
        t = words(rnd, rnd.randint(0, 50))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 60)
            t += " " + p[a : rnd.randint(a, len(p))] + " " + words(rnd, rnd.randint(0, 25))
        rows.append((i, t))
    return rows + [(300, None), (301, ""), (302, "a" * 1000), (303, "b" * 199), (304, "ab" * 300), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (305, "x" * 250), (306, "lorem ipsum " * 40 + words(rnd, 20) + "lorem ipsum " * 40)]


@pytest.mark.parametrize("group", [50_000, 2])
def test_removal_against_brute_force(spark, repeating, monkeypatch, group):
    monkeypatch.setattr(suffix_array, "GROUP", group)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in repeating], "doc_id long, text string, th int, spans string")
    assert sorted((tuple(r) for r in suffix_array.remove_repeats(docs).collect()), key=str) == slow_removal(repeating)


def test_removal_from_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_array.remove_repeats(docs, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == slow_removal(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_odd_removal(spark):
    rows = [(d, t) for d, t in ODD if d != 7]
    docs = odd(spark).where("doc_id <> 7 or doc_id is null")
    assert sorted((tuple(r) for r in suffix_array.remove_repeats(docs).collect()), key=str) == slow_removal(rows)
    assert suffix_array.remove_repeats(empty(spark)).count() == 0


def test_maximal_repeats_have_all_occurrences():
    rnd = random.Random(12)
    core = "".join(rnd.choice("abcd") for _ in range(40))
    left, right = ("".join(rnd.choice("abcd") for _ in range(160)) for _ in range(2))
    cuts = [(160, 160), (160, 120), (100, 160), (100, 130), (30, 160), (160, 10)]
    snippets = []
    for k, (a, b) in enumerate(cuts):
        snippets.append(((chr(200 + k) * (160 - a) + left[160 - a :])[::-1].encode("latin-1"), (core + right[:b] + chr(220 + k) * (160 - b)).encode("latin-1")))
    groups = []
    got = suffix_array.extensions([x for x, _ in snippets], [y for _, y in snippets], groups)
    for i, (a, b) in enumerate(cuts):
        pairs = [(min(a, c), min(b, d)) for j, (c, d) in enumerate(cuts) if j != i and min(a, c) + 40 + min(b, d) >= 200]
        want = (max((x for x, _ in pairs), default=0), max((40 + y for _, y in pairs), default=0))
        assert (got[0][i], got[1][i]) == want
    for x, y, own in groups:
        whole = [i for i, (a, b) in enumerate(cuts) if a >= x and 40 + b >= y]
        assert sorted(own) == whole and x + y >= 200
    assert groups
