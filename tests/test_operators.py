"""Operators on micro-graphs whose results are known."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import text as X
from tessera.operators import graph, history, lookups, predicates, relations, rules, work


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_containment_and_roll_up(spark):
    """On random forests, against chains walked one parent at a time."""
    rnd = random.Random(11)
    up = {f"d{i}": f"d{rnd.randrange(i)}" if i and rnd.random() < 0.85 else None for i in range(40)}
    tree = spark.createDataFrame(list(up.items()), "id string, parent string")

    def chain(ident):
        out = [ident]
        while up.get(out[0]):
            out.insert(0, up[out[0]])
        return out

    assert {r.id: r.chain for r in graph.paths(tree).collect()} == {i: chain(i) for i in up}
    places = [*up, "outside"]
    statements = [(rnd.choice(places), rnd.choice(places), k) for k in range(200)]
    fold = lambda i, depth: chain(i)[min(depth, len(chain(i)) - 1)]
    e = spark.createDataFrame(statements, "src string, dst string, line int")
    for depth in (0, 1, 3):
        assert values(graph.rolled_up(e, tree, depth)) == sorted((fold(a, depth), fold(b, depth), k) for a, b, k in statements if fold(a, depth) != fold(b, depth))
    looped = spark.createDataFrame([("left", "right"), ("right", "left"), ("orphan", "nowhere")], "id string, parent string")
    assert {r.id: r.chain for r in graph.paths(looped).collect()} == {"left": ["right", "left"], "right": ["left", "right"], "orphan": ["orphan"]}


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s")])
    assert values(graph.strong_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert graph.strong_components(edges(spark, [])).count() == 0


def slow_groups(pairs):
    below = {}
    for a, b in pairs:
        below.setdefault(a, set()).add(b)

    def reach(s):
        seen, todo = set(), [s]
        while todo:
            for b in below.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    nodes = {x for p in pairs for x in p}
    all_ = {n: reach(n) for n in nodes}
    group = {n: {m for m in all_[n] if n in all_[m]} for n in nodes}
    return sorted((n, min(g | {n})) for n, g in group.items() if len(g | {n}) > 1)


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_by_brute_force(spark, seed):
    """Sparse graphs, full of chains that leave and come back, and circles of their own."""
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(34)]
    for k, size in enumerate((2, 3, 5)):
        ring = [f"ring{k}-{i}" for i in range(size)]
        pairs += list(zip(ring, ring[1:] + ring[:1], strict=True))
    for k in range(4):  # chains between nodes, one of them back to where it began
        way = [f"n{k}", *[f"c{k}-{i}" for i in range(k + 1)], f"n{k if k == 1 else rnd.randrange(30)}"]
        pairs += list(zip(way, way[1:], strict=False))
    pairs = [p for p in pairs if p[0] != p[1]]
    assert values(graph.strong_components(edges(spark, pairs))) == slow_groups(pairs)


def test_long_chains_and_circles(spark, monkeypatch):
    """20,001 nodes one after the other settle in a number of rounds that is the logarithm of that."""
    n = 20_001
    ids = spark.range(n - 1)
    name = lambda c: F.concat(F.lit("n"), F.lpad(c.cast("string"), 6, "0"))
    chain = ids.select(name(F.col("id")).alias("src"), name(F.col("id") + 1).alias("dst"))
    circle = chain.unionByName(spark.createDataFrame([("n020000", "n000000")], "src string, dst string"))
    got = graph.strong_components(circle)
    assert got.count() == n and got.select("component").distinct().collect()[0][0] == "n000000"
    monkeypatch.setattr(graph, "PATIENCE", 2)
    start = spark.createDataFrame([("n000000",)], "id string")
    far = graph.distances(circle.withColumn("cost", F.lit(1)), start)
    assert far.count() == n and far.where("distance <> cast(substring(id, 2) as int)").isEmpty() and far.where("id = 'n012345'").first().hop == "n012344"
    assert graph.transitive_dependents(chain, "n020000").count() == n - 1
    depth = graph.levels(chain)
    assert depth.count() == n and depth.where("level <> 20000 - cast(substring(id, 2) as int)").isEmpty()


@pytest.mark.parametrize("seed", range(2))
def test_distances_past_patience(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}"): rnd.randrange(2) for _ in range(20)}
    for k in range(5):
        way = [f"n{k}", *[f"c{k}-{i}" for i in range(k + 2)], f"n{rnd.randrange(14)}"]
        pairs |= {p: rnd.randrange(2) for p in zip(way, way[1:], strict=False)}
    e = spark.createDataFrame([(*p, c) for p, c in pairs.items()], "src string, dst string, cost int")
    seeds = spark.createDataFrame([("n0",), ("c1-1",)], "id string")
    plain = values(graph.distances(e, seeds))
    monkeypatch.setattr(graph, "PATIENCE", 1)
    assert values(graph.distances(e, seeds)) == plain
    far = {"n0": 0, "c1-1": 0}
    for _ in range(60):
        for (a, b), c in pairs.items():
            if a in far:
                far[b] = min(far.get(b, 99), far[a] + c)
    assert {(i, d) for i, d, _ in plain} == set(far.items())
    acyclic = [(a, b) for a, b in pairs if a < b]
    want = values(graph.levels(edges(spark, acyclic)))
    monkeypatch.setattr(graph, "PATIENCE", 100)
    assert values(graph.levels(edges(spark, acyclic))) == want


def test_closure_against_brute_force(spark):
    rnd = random.Random(4)
    pairs = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(45)]
    reach = {}
    for s in {a for a, _ in pairs}:
        seen, todo = set(), [s]
        while todo:
            at = todo.pop()
            for a, b in pairs:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    assert values(graph.closure(edges(spark, pairs))) == sorted((a, b) for a, bs in reach.items() for b in bs)


def test_a_fix_point_that_does_not_settle_raises(spark):
    with pytest.raises(RuntimeError):
        graph.closure(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)]), bound=2)


def test_distances_prefer_free_steps_and_least_hops(spark):
    e = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("a", "t", 1), ("b", "t", 1), ("t", "f", 0), ("s", "c", 0), ("c", "t", 1)], "src string, dst string, cost int")
    assert {r.id: (r.distance, r.hop) for r in graph.distances(e, spark.createDataFrame([("s",)], "id string")).collect()} == {"s": (0, None), "a": (1, "s"), "b": (1, "s"), "c": (0, "s"), "t": (1, "c"), "f": (1, "t")}


def test_levels_refuse_cycles(spark):
    assert values(graph.levels(edges(spark, [("a", "b"), ("b", "c"), ("a", "c")]))) == [("a", 2), ("b", 1), ("c", 0)]
    with pytest.raises(ValueError):
        graph.levels(edges(spark, [("a", "b"), ("b", "a")]))


def test_merging_at_once_equals_one_at_a_time(spark):
    rows = [("a", "b", "imports", "f1", 1), ("a", "b", "imports", "f1", 1), ("a", "b", "calls", "f1", 2), ("a", "b", "imports", "f0", None), ("c", "b", "imports", "f1", 1), ("a", "b", "imports", "f2", 9)]
    df = spark.createDataFrame(rows, "src string, dst string, kind string, file string, line int")
    whole = relations.merge_edges(df, ["file", "line"])
    parts = None
    for r in rows:
        own = relations.merge_edges(spark.createDataFrame([r], df.schema), ["file", "line"])
        parts = own if parts is None else parts.unionByName(own)
    assert values(whole) == values(relations.union_edges(parts))
    assert whole.where("src = 'a' and kind = 'imports'").first().evidence[0].file == "f0"


def test_statements_count_null_lines(spark):
    df = spark.createDataFrame([("f", 1, False), ("f", 1, True), ("f", None, False), ("g", None, False)], "file string, line int, test boolean")
    assert tuple(df.agg(relations.statements(), relations.statements("test"), relations.statements("production")).first()) == (3, 1, 3)


def test_keep_last_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2)], "number long, state string, seq int")
    once = relations.keep_last(df, ["number"], [F.col("seq")])
    assert values(once) == [(1, "b", 3), (2, "c", 2)] == values(work.merge_items(once, once, "seq"))


def test_competition_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1)], "id string, n int")
    assert {r.id: r["rank"] for r in relations.competition_rank(df, "n").collect()} == {"a": 1, "b": 1, "c": 3, "d": 4}


def test_edges_without_evidence_run(spark):
    df = spark.createDataFrame([([],), ([(True, False, False)],), ([(True, False, False), (False, True, False)],), ([(False, False, False)],)], "e array<struct<test:boolean,type_only:boolean,server_reference:boolean>>")
    got = df.select(predicates.edge_in_production(F.col("e")), predicates.edge_runs(F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False), (True, True)]


def test_owner_ties_go_to_evidence_then_the_greatest_id(spark):
    comp = spark.createDataFrame([("lib", "src"), ("bin", "src"), ("root", ""), ("deep", "src/deep")], "id string, path string")
    places = spark.createDataFrame([("bin", "src/main.rs"), ("lib", "src/other.py")], "id string, file string")
    files = spark.createDataFrame([("src/main.rs",), ("src/new.rs",), ("src/new.py",), ("src/x.txt",), ("src/deep/a.rs",), ("top.md",), ("src",)], "file string")
    assert dict(values(lookups.path_owners(files, comp, places))) == {"src/main.rs": "bin", "src/new.rs": "bin", "src/new.py": "lib", "src/x.txt": "lib", "src/deep/a.rs": "deep", "top.md": "root", "src": "lib"}


def test_loaded_dependencies_follow_re_exports(spark):
    schema = "src string, dst string, kind string, file string, line int, target string, via_file string, via_line int, names array<string>, test boolean"
    rows = [
        ("facade", "core", "imports", "facade/mod.py", 3, "core/a.py", None, None, ["A"], False),
        ("user", "core", "imports", "user/u.py", 1, "core/a.py", "facade/mod.py", 3, ["A"], False),
        ("user", "core", "imports", "user/u.py", 2, "core/b.py", "nowhere.py", 9, ["B"], False),
        ("facade", "core", "imports", "facade/in.py", 1, "core/a.py", "facade/mod.py", 3, ["A"], False),
        ("user", "core", "imports", "user/t.py", 1, "core/a.py", None, None, ["A"], True),
    ]
    got = values(lookups.loaded_dependencies(spark.createDataFrame(rows, schema)).select("src", "dst", "file", "line", "direct"))
    assert got == [("facade", "core", "facade/in.py", 1, False), ("facade", "core", "facade/mod.py", 3, True), ("user", "core", "user/u.py", 1, False), ("user", "core", "user/u.py", 2, False)]


def test_mixed_directions(spark):
    e = spark.createDataFrame([("core", "util", "core/a.py", "util/log.py"), ("models", "util", "models/m.py", "util/log.py"), ("util", "core", "util/store.py", "core/a.py"), ("util", "models", "util/registry.py", "models/m.py")], "src string, dst string, file string, target string")
    rows = {r.id: (r.partners, r.used, r.uses) for r in rules.mixed_directions(e).collect()}
    assert rows["util"] == (["core", "models"], ["util/log.py"], ["util/registry.py", "util/store.py"])


def test_selectors(spark):
    df = spark.createDataFrame([("src.domain", "module", "src/domain"), ("src.domains", "module", "src/domains"), ("ext:pypi:requests", "external", None), ("app", "package", "")], "id string, kind string, path string")
    hit = lambda s: [r.id for r in df.where(predicates.selector_matches(F.lit(s), F.col("id"), F.col("kind"), F.col("path"))).collect()]
    assert hit("src/domain") == ["src.domain"] and hit("ext:pypi:*") == ["ext:pypi:requests"] == hit("ext:*") == hit("ext:pypi:requests")
    assert hit("ext:requests") == [] and hit(".") == ["src.domain", "src.domains", "app"]


def test_file_level_of_cycles(spark):
    e = spark.createDataFrame([("A", "B", "a1", "b1", "module"), ("B", "A", "b1", "a1", "local"), ("C", "D", "c1", "d1", "module"), ("D", "C", "d2", "c2", "module")], "src string, dst string, file string, target string, scope string")
    assert values(graph.cycle_levels(e, graph.strong_components(e))) == [("A", "cycle"), ("C", "no_cycle")]


COMMITS = "id string, parents array<string>, time long, boundary boolean, omitted long, pos long"
CHANGES = "commit string, path string, kind string, renamed_from string, similarity int"


def test_co_change(spark):
    """A random history, against counts of sets of commits."""
    rnd = random.Random(8)
    log = {f"r{i:02}": rnd.sample([f"p{k}" for k in range(9)], rnd.randint(1, 5)) for i in range(40)}
    commits = spark.createDataFrame([(c, [], 0, False, 0, i) for i, c in enumerate(log)], COMMITS)
    changes = spark.createDataFrame([(c, p, "modified", None, None) for c, ps in log.items() for p in ps], CHANGES)
    counted = history.classified(commits, changes).where("class = 'counted'")
    got = history.degree_order(history.co_changed(changes, counted, spark.createDataFrame([("p0",), ("p1",)], "path string")))
    of = lambda p: {c for c, ps in log.items() if p in ps}
    both = of("p0") | of("p1")
    rows = [(p, len(of(p) & both), len(of(p))) for p in (f"p{k}" for k in range(2, 9)) if of(p) & both]
    rows.sort(key=lambda r: (-Fraction(r[1], len(both) + r[2]), -r[1], r[0]))
    assert [(r.path, r.shared, r.own, r.place) for r in got.orderBy("place").collect()] == [(*r, i) for i, r in enumerate(rows, 1)]


def test_places_of_rows_in_order(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 700).alias("k"), "id").repartition(7)
    got = [(r.k, r.id) for r in relations.in_order(rows, [F.desc("k"), F.asc("id")]).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 5000
    assert {r.place for r in relations.in_order(rows, [F.desc("k"), F.asc("id")]).select("place").collect()} == set(range(1, 5001))


def test_commit_classes(spark):
    commits = spark.createDataFrame([("m", ["a", "b"], 0, True, 0, 0), ("b", ["a"], 0, True, 0, 1), ("l", ["a"], 0, False, 29, 2), ("c", ["a"], 0, False, 0, 3)], COMMITS)
    changes = spark.createDataFrame([(c, p, "modified", None, None) for c in "mblc" for p in "xy"], CHANGES)
    assert {r.id: r["class"] for r in history.classified(commits, changes).collect()} == {"m": "merge", "b": "boundary", "l": "large", "c": "counted"}


def test_places_put_children_before_parents(spark):
    rnd = random.Random(3)
    parents = {i: rnd.sample(range(i), min(i, rnd.choice([0, 1, 1, 2]))) for i in range(60)}
    for shuffled in (False, True):
        pos = list(range(60))[::-1]
        if shuffled:
            rnd.shuffle(pos)
        commits = spark.createDataFrame([(f"k{i}", [f"k{p}" for p in ps], 0, False, 0, pos[i]) for i, ps in parents.items()], COMMITS)
        place = {r.id: r.place for r in history.placed(commits).collect()}
        assert len(set(place.values())) == 60 and all(place[f"k{i}"] < place[f"k{p}"] for i, ps in parents.items() for p in ps)
    in_turn = sorted(place, key=place.get)
    assert shuffled and len(in_turn) == 60


def test_a_path_renamed_very_often(spark):
    """One path swings between two names 10,000 times: rows grow in proportion, and rounds with the logarithm."""
    n = 10_000
    c = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("id"), F.array(F.concat(F.lit("k"), F.col("id") + 1)).alias("parents"), F.lit(0).cast("long").alias("time"), F.lit(False).alias("boundary"), F.lit(0).cast("long").alias("omitted"), F.col("id").alias("pos"))
    even = F.col("id") % 2 == 0
    moves = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("commit"), F.when(even, "a").otherwise("b").alias("path"), F.lit("renamed").alias("kind"), F.when(even, "b").otherwise("a").alias("renamed_from"), F.lit(100).alias("similarity"))
    got = history.identities(c, moves)
    assert got.count() == n and {r.now for r in got.select("now").distinct().collect()} == {"a"}


def test_snapshot_relations_follow_what_is_read_again(spark):
    held = spark.createDataFrame([("closes", 5, 1, [5, 1]), ("linked", 9, 1, [9]), ("linked", 9, 2, [9]), ("linked", 1, 9, [1])], "type string, a long, b long, recorded array<long>")
    read = spark.createDataFrame([("closes", 5, 1, [1]), ("linked", 7, 1, [1])], held.schema)
    got = values(work.merge_relations(held, read, spark.createDataFrame([(1,)], "number long")))
    assert got == [("closes", 5, 1, [1, 5]), ("linked", 7, 1, [1]), ("linked", 9, 1, [9]), ("linked", 9, 2, [9])]
    again = work.merge_relations(spark.createDataFrame(got, held.schema), read, spark.createDataFrame([(1,)], "number long"))
    assert values(again) == got


def test_retry_schedule(spark):
    df = spark.createDataFrame([(1, None, None, 0), (3, None, None, 0), (30, None, None, 0), (1, 17, 99, 0), (1, None, 99, 9)], "failures int, retry_after long, reset_at long, now long")
    assert [r.wait for r in work.retry_seconds(df).collect()] == [300, 1200, 21600, 17, 90]


def scalar_cases():
    return [
        (P.normalized(F.lit("./a/b/")), "a/b"),
        (P.normalized(F.lit(".")), ""),
        (P.parent(F.lit("a/b/c.py")), "a/b"),
        (P.parent(F.lit("c.py")), ""),
        (P.extension(F.lit("a/b.tar.gz")), "gz"),
        (P.extension(F.lit("a/.env")), None),
        (P.ancestors(F.lit("a/b/c")), ["a/b/c", "a/b", "a", ""]),
        (P.ancestors(F.lit("")), [""]),
        (P.lexical(F.lit("a/./b/../c")), "a/c"),
        (P.lexical(F.lit("a/../../c")), None),
        (P.npm_package(F.lit("@scope/pkg/sub/x")), "@scope/pkg"),
        (P.npm_subpath(F.lit("@scope/pkg/sub/x")), "sub/x"),
        (P.npm_subpath(F.lit("pkg")), None),
        (P.types_package(F.lit("@scope/pkg")), "@types/scope__pkg"),
        (P.distribution(F.lit("Zope.Interface_x")), "zope-interface-x"),
        (P.requirement(F.lit("Django[argon2] >= 4 ; python_version > '3'")), "Django"),
        (P.last_segment(F.lit("a/b.c")), "b.c"),
        (P.last_segment(F.lit("a::b.c")), "c"),
        (P.renamed_id(F.lit("m::x"), F.lit("m"), F.lit("n")), "n::x"),
        (P.renamed_id(F.lit("mm"), F.lit("m"), F.lit("n")), "mm"),
        (P.module_path(F.lit("a/b/index.ts")), "a/b"),
        (X.rfc3339(F.lit(0)), "1970-01-01T00:00:00Z"),
        (X.epoch(F.lit("1970-01-02T00:00:00Z")), 86400),
        (X.epoch(F.lit("1970-01-02 00:00:00")), None),
        (X.epoch(F.lit("1970-13-02T00:00:00Z")), None),
        (X.duration(F.lit("7d")), 604800),
        (X.duration(F.lit("7w")), None),
        (X.remote(F.lit("git@github.com:o/n.git"))["name"], "n"),
        (X.remote(F.lit("https://u:p@Example.org/o/n"))["host"], "example.org"),
        (X.remote(F.lit("ssh://git@h:22/o/n.git"))["owner"], "o"),
        (X.remote(F.lit("nonsense"))["name"], None),
        (X.without_credentials(F.lit("https://u:p@h/x")), "https://h/x"),
        (X.masked_tokens(F.lit("a " + "a1" * 20 + " b")), "a *** b"),
        (X.masked_tokens(F.lit("a" * 40)), "a" * 40),
        (X.masked_paths(F.lit("at /home/u/x.py, C:\\u\\x")), "at <path> <path>"),
        (X.failure(F.lit("You have exceeded a secondary rate limit")), "secondary"),
        (X.failure(F.lit("HTTP 401: Bad credentials")), "auth"),
        (X.taken_label(F.array(*map(F.lit, ["b", "A", "c", "d"])), 2), "A, b +2 more"),
        (X.plural(F.lit(1), "file"), "1 file"),
        (X.plural(F.lit(2), "file"), "2 files"),
        (X.shell_quoted(F.lit("it's")), "'it'\\''s'"),
        (X.line_of(F.lit("a\nb\nc"), F.lit(4)), 3),
        (X.column_of(F.lit("a\nbcd"), F.lit(3)), 2),
        (X.via_place(F.lit("export via a/b.ts:12"))["line"], 12),
        (X.import_of_note(F.lit("import numpy,")), "numpy"),
        (X.collapsed(F.lit("f(\n  a,\n  b,\n)")), "f(a, b)"),
        (X.location(F.lit("f"), F.lit(3), F.lit("g")), "f:3 -> g"),
    ]


def test_scalars(spark):
    cases = scalar_cases()
    row = spark.range(1).select(*[e.alias(f"c{i}") for i, (e, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, want in cases]


def test_identities_against_a_fold(spark):
    """Random histories: from the newest commit on, what each path was called is carried along by hand."""
    rnd = random.Random(3)
    commits, changes, want = [], [], []
    now: dict[str, str] = {}
    for i in range(60):
        commits.append((f"k{i}", [f"k{i + 1}"], i))
        own = {}
        for path in rnd.sample("stuvwxyz", 3):
            kind = rnd.choice(["added", "renamed", "modified", "modified"])
            own[path] = (kind, rnd.choice([x for x in "stuvwxyz" if x != path]) if kind == "renamed" else None)
        changes += [(f"k{i}", p, k, f) for p, (k, f) in own.items()]
        want += [(f"k{i}", p, now.get(p, p)) for p in own]
        carried = {}
        for p in sorted(own):
            if own[p][1]:
                carried[own[p][1]] = now.get(p, p)
        for p, (k, _) in own.items():
            if k != "modified":
                now.pop(p, None)
        now.update(carried)
    c = spark.createDataFrame(commits, "id string, parents array<string>, pos bigint")
    h = spark.createDataFrame(changes, "commit string, path string, kind string, renamed_from string")
    assert values(history.identities(c, h)) == sorted(want)
    # The same where the order of pos is not that of the graph.
    turned = c.withColumn("pos", F.when(F.col("id") == "k7", 99).otherwise(F.col("pos")))
    assert values(history.identities(turned, h)) == sorted(want)
    assert history.identities(c.limit(0), h.limit(0)).count() == 0
