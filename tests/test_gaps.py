"""Gap lists, barrels' gaps, takers of methods and colliding ids, on planted rows and by brute force."""

import random

from pyspark.sql import functions as F

from tessera.operators import gaps


def test_gap_lists_by_brute_force(spark):
    rnd = random.Random(4)
    places = [(rnd.choice(["dynamic", "macro"]), rnd.choice(["", "a", "a/b", "c"]), f"f{rnd.choice([0, 0, 0, 1, 2, 3])}", rnd.randint(1, 9), rnd.random() < 0.4, f"w{k}") for k in range(160)]
    wanted = [(s, kind, key, own) for s, path, own in (("s1", "a/b/x.py", "f0"), ("s2", "c/y.py", "f1"), ("s3", "z.py", None), ("s4", "a", "f9")) for kind in ("dynamic", "macro") for key in {"", *["/".join(path.split("/")[: i + 1]) for i in range(len(path.split("/")))]}]
    for most in (1, 3, 50):
        got = gaps.gap_lists(spark.createDataFrame(places, "kind string, key string, file string, line int, test boolean, what string"), spark.createDataFrame(wanted, "subject string, kind string, key string, own string"), most=most).collect()
        want = {}
        for s, kind in {w[:2] for w in wanted}:
            keys, own = {w[2] for w in wanted if w[:2] == (s, kind)}, next(w[3] for w in wanted if w[0] == s)
            rows = sorted((p[4], p[2], p[3], p[5]) for p in places if p[0] == kind and p[1] in keys and p[2] != own)
            if rows:
                want[s, kind] = (len(rows), [(f, i, t, w) for t, f, i, w in rows[:most]])
        assert {(r.subject, r.kind): (r.total, [tuple(x) for x in r.shown]) for r in got} == want


def test_keys_of_a_path(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("x",)], "p string").select(gaps.directories(F.col("p")).alias("d"))
    assert [r.d for r in df.collect()] == [["", "a", "a/b", "a/b/c.py"], ["", "x"]]


def test_first_of(spark):
    rows = spark.createDataFrame([("k", f, i) for i, f in enumerate("cabdbe")] + [("one", "z", 1)], "key string, file string, line int")
    got = {r.key: (r.total, [(x.file, x.line) for x in r.shown]) for r in gaps.first_of(rows, ["key"], [rows.file, rows.line], 2).collect()}
    assert got == {"k": (6, [("a", 1), ("b", 2)]), "one": (1, [("z", 1)])}


def test_barrels(spark):
    table = spark.createDataFrame
    bars = [("t", "index", "t", 0), ("t", "index", "mid", 1), ("t", "top", "index", 1), ("t", "lost", "nowhere", 0)]
    passing = [("index", 9, "mid"), ("index", 12, "t"), ("index", 3, "other"), ("top", 4, "index"), ("top", 2, "index"), ("lost", 7, "a"), ("lost", 5, "b"), ("index", 1, "index")]
    loading = [("t1", "index", True, False, False), ("t2", "index", True, True, False), ("t3", "index", True, False, False), ("t3", "index", True, False, True), ("t4", "index", True, False, False), ("app", "index", False, False, False)]
    got = gaps.barrel_gaps(table(bars, "target string, barrel string, origin string, place int"), table(passing, "file string, line int, target string"), table(loading, "file string, target string, test boolean, type_only boolean, replaces boolean"), table([("t", "t4")], "target string, file string")).collect()
    assert {tuple(r) for r in ((x.target, x.barrel, x.line, tuple(x.lines), x.tests_not_listed) for x in got)} == {("t", "index", 12, (9, 12), 1), ("t", "top", 2, (2, 4), 0), ("t", "lost", 5, (5, 7), 0)}


def test_method_takers(spark):
    methods = [("ty.rs", "impl.rs", "Wallet", False), ("ty.rs", "impl.rs", "Card", False), ("ty.rs", "more.rs", "Wallet", True)]
    statements = [("a.rs", 1, "ty.rs", "Wallet", False), ("a.rs", 2, "ty.rs", "*", False), ("a.rs", 3, "ty.rs", None, True), ("a.rs", 4, "ty.rs", "Other", True), ("impl.rs", 1, "ty.rs", "Wallet", False), ("b.rs", 1, "no.rs", "Wallet", True), ("t.rs", 5, "ty.rs", "Wallet", True)]
    got = gaps.method_takers(spark.createDataFrame(methods, "type_file string, file string, name string, test boolean"), spark.createDataFrame(statements, "file string, line int, target string, name string, test boolean")).collect()
    assert {tuple(r) for r in got} == {("impl.rs", "a.rs", 1, "Wallet"), ("impl.rs", "a.rs", 2, "Card"), ("impl.rs", "a.rs", 3, "Card"), ("more.rs", "a.rs", 3, "Wallet"), ("impl.rs", "t.rs", 5, "Wallet"), ("more.rs", "t.rs", 5, "Wallet")}


def test_colliding_ids(spark):
    rows = [
        ("rust", 1, "shop", "shop"), ("rust", 2, "shop::a", "shop/a.rs"), ("rust", 3, "same", "here"), ("rust", 4, "none", None),
        ("py", 1, "shop", None), ("py", 2, "shop", "py/shop"), ("py", 3, "shop::a", "py/a.py"), ("py", 4, "shopping", "s"), ("py", 5, "same", "here"), ("py", 6, "shop+ts", "x"),
        ("ts", 1, "shop", "web"), ("ts", 2, "shop::b", "web/b"), ("ts", 3, "shop::a", "web/a"), ("ts", 4, "none", "web/none"),
    ]
    names = gaps.separated(spark.createDataFrame(rows, "source string, pos int, id string, path string"), ["rust", "py", "ts"])
    got = {(r.source, r.id): r.new_id for r in names.collect()}
    changed = {k: v for k, v in got.items() if k[1] != v}
    # The third source's first new name is taken by an id of the second: it is renamed again, with all below.
    assert changed == {("py", "shop"): "shop+py", ("py", "shop::a"): "shop+py::a", ("ts", "shop"): "shop+ts+ts", ("ts", "shop::b"): "shop+ts+ts::b", ("ts", "shop::a"): "shop+ts+ts::a", ("ts", "none"): "none+ts"}
    assert len(got) == 13
    edges = spark.createDataFrame([("py", "shop::a", "shop"), ("ts", "shop", "elsewhere")], "source string, src string, dst string")
    assert {tuple(r) for r in gaps.renamed(edges, names, "src", "dst").collect()} == {("py", "shop+py::a", "shop+py"), ("ts", "shop+ts+ts", "elsewhere")}
