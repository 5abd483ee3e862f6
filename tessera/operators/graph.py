"""Closures, components, distances and roll-up of the property graph.

Fix-points are semi-naive: only what the last round added is joined again, each round's result is checkpointed in the
shared folder, and a loop that reaches its bound raises instead of returning less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, gathered, settle, stored


def _bounded(round_: int, bound: int) -> None:
    if round_ >= bound:
        raise RuntimeError(f"no fix-point after {bound} rounds")


def closure(edges: DataFrame, start: DataFrame | None = None, *, bound: int = 1000) -> DataFrame:
    """All pairs (src, dst) with a path of one edge or more; with start (src) only those from there.

    All pairs come by doubling, in about log rounds of the longest path; from a start by one edge a round.
    """
    e = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = stored(e if start is None else e.join(start.select("src").distinct(), "src", "left_semi"))
    fresh = found
    for i in range(bound + 1):
        if fresh.isEmpty():
            return found
        _bounded(i, bound)
        ahead = lambda rows: rows.select(F.col("src").alias("_mid"), "dst")
        met = lambda one, two: one.select("src", F.col("dst").alias("_mid")).join(ahead(two), "_mid").select("src", "dst")
        step = met(fresh, e) if start is not None else met(fresh, found).unionByName(met(found, fresh))
        fresh = stored(step.distinct().join(found, ["src", "dst"], "left_anti"))
        found = found.unionByName(fresh)
    raise AssertionError


def transitive_dependents(edges: DataFrame, target: str) -> DataFrame:
    """Everything from which a path leads to the target, without itself."""
    back = edges.where("src is not null and dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("cost"))
    start = edges.sparkSession.createDataFrame([(target,)], "id string")
    return distances(back, start).where(F.col("id") != target).select("id")


#: Rounds of one edge each after which what is left of a graph is contracted.
PATIENCE = 24


def _chains(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one edge in and one out, but those to keep: id, up (where their chain begins), off (its cost up to them), before, first (of the chain's nodes).

    edges: src, dst, cost, distinct, no loops. Pointers are followed by doubling; each node of a chain points to another
    one until it reaches the beginning, so no key is hot. The second table has the nodes of circles that nothing enters or leaves.
    """
    one = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"), F.min("src").alias("before"), F.min("cost").alias("off")).where("_n = 1").drop("_n")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_n")).where("_n = 1").select("id")
    own = stored(one.join(out, "id", "left_semi").join(keep.select("id"), "id", "left_anti").select("id", F.col("before").alias("up"), F.col("off").cast("long").alias("off"), "before", F.col("id").alias("first")))
    ids = own.select(F.col("id").alias("up"))
    done, open_ = own.join(ids, "up", "left_anti"), stored(own.join(ids, "up", "left_semi"))
    # A chain of n nodes has settled after log n rounds; a circle never does, and its pointers come round.
    for _ in range(max(open_.count(), 1).bit_length() + 1):
        if open_.isEmpty():
            break
        known = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("off").alias("_off"), F.col("first").alias("_first"))
        step = open_.join(known, "up").select("id", F.col("_up").alias("up"), (F.col("off") + F.col("_off")).alias("off"), "before", F.col("_first").alias("first"))
        step = stored(step.join(ids.withColumn("_in", F.lit(True)), "up", "left"))
        done = done.unionByName(step.where("_in is null").drop("_in"))
        open_ = step.where("_in").drop("_in")
    return done, open_


def _relaxed(e: DataFrame, seeds: DataFrame, bound: int) -> DataFrame | None:
    """Least cost from the seeds along e (src, dst, cost, via), and the least via there; None if that takes more rounds."""
    best = settle(seeds.select(F.col("id"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("string").alias("hop")).distinct())
    fresh = best
    for _ in range(bound + 1):
        if fresh.isEmpty():
            return best
        step = fresh.join(e, fresh.id == e.src).select(F.col("dst").alias("id"), (F.col("distance") + F.col("cost")).alias("distance"), F.col("via").alias("hop"))
        step = step.groupBy("id").agg(F.min(F.struct("distance", "hop")).alias("x")).select("id", "x.*")
        old = best.select("id", F.col("distance").alias("_d"), F.col("hop").alias("_h"))
        fresh = settle(step.join(old, "id", "left").where("_d is null or distance < _d or (distance = _d and _h is not null and hop < _h)").select("id", "distance", "hop"))
        best = settle(best.join(fresh.select("id"), "id", "left_anti").unionByName(fresh))
    return None


def distances(edges: DataFrame, seeds: DataFrame, *, bound: int = 1000) -> DataFrame:
    """Least cost from the seeds (id) along edges (src, dst, cost 0 or 1), with the predecessor there: id, distance, hop.

    Ties of the predecessor go to the least id; a seed has none. Each round goes one edge further. What has not settled
    after PATIENCE rounds is begun again with its chains taken as one edge each, however long they are; then `bound`
    is of rounds over these, and more raise.
    """
    e = settle(edges.groupBy("src", "dst").agg(F.min("cost").cast("long").alias("cost")).where("src <> dst"))
    found = _relaxed(e.withColumn("via", F.col("src")), seeds, min(PATIENCE, bound))
    if found is None:
        chains, circles = _chains(e, seeds)
        inner = chains.select("id").unionByName(circles.select("id"))
        start = chains.select(F.col("id").alias("src"), "up", F.col("off").alias("_off"))
        g = e.join(inner.select(F.col("id").alias("dst")), "dst", "left_anti").join(start, "src", "left")
        g = settle(g.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("cost") + F.coalesce("_off", F.lit(0))).alias("cost"), F.col("src").alias("via")))
        found = _relaxed(g, seeds, bound)
        if found is None:
            raise RuntimeError(f"no fix-point after {bound} rounds")
        ends = found.select(F.col("id").alias("up"), F.col("distance").alias("_d"))
        found = found.unionByName(chains.join(ends, "up").select("id", (F.col("_d") + F.col("off")).alias("distance"), F.col("before").alias("hop")))
    return found.select("id", F.col("distance").cast("int").alias("distance"), "hop")


#: Orders of the nodes, by hash, that strong_components follows at once.
ORDERS = 4
#: Places over which the nodes of one label are dealt.
SALTS = 16


def _greatest_reach(edges: DataFrame, salt: int, round_: int, bound: int) -> tuple[DataFrame, int]:
    """For each node the greatest node, in each of ORDERS orders by hash, that reaches it and that it reaches: v, labels.

    A node takes the labels of its neighbours and the labels of its labels, so that paths are walked by doubling: a
    path in random order settles in about log n rounds.
    """
    both = edges.select("src", "dst", F.lit(False).alias("back")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
    both = stored(both)
    nodes = both.select(F.col("src").alias("v")).distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("k")
    state = nodes.select("v", k).select("v", "k", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.struct(F.xxhash64("v", "k", F.lit(salt)).alias("m"), F.col("v").alias("l")).alias("x"))
    state, before = stored(state), None
    while True:
        _bounded(round_, bound)
        round_ += 1
        # Labels only grow, so their sum tells whether any has.
        now = state.agg(F.sum(F.col("x.m").cast("decimal(38,0)"))).first()[0]
        if now == before:
            discard(both)
            return state.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("back", "k", F.col("x.l").alias("l")))).alias("labels")), round_
        before = now
        hop = state.join(both, (F.col("v") == F.col("src")) & (state.back == both.back)).select(F.col("dst").alias("v"), "k", state.back, "x")
        # Many nodes may carry one label: each label is looked up once, and its nodes meet the answer in SALTS places.
        labels = state.select(F.col("x.l").alias("v"), "k", "back").distinct().join(state, ["v", "k", "back"])
        ahead = labels.select(F.col("v").alias("_l"), "k", "back", F.col("x").alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        carried = state.select("v", "k", "back", F.col("x.l").alias("_l"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("_salt"))
        jump = carried.join(ahead, ["_l", "k", "back", "_salt"]).select("v", "k", "back", F.col("_x").alias("x"))
        last, state = state, stored(jump.unionByName(hop).groupBy("v", "k", "back").agg(F.max("x").alias("x")))
        discard(last)


def strong_components(edges: DataFrame, *, bound: int = 1000) -> DataFrame:
    """Strongly connected groups of two or more: id, component (the least id). Self loops don't count.

    Chains of nodes with one edge in and one out are taken as one edge each first, in a number of rounds that is the
    logarithm of their length; their nodes are in the group of their ends if these are in one. Circles that nothing enters or leaves
    are groups. Raises after bound rounds over what is left.
    """
    e = stored(edges.select("src", "dst").where("src <> dst").distinct())
    if e.isEmpty():
        return e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    chains, circles = _chains(e.withColumn("cost", F.lit(1)), e.select(F.col("src").alias("id")).limit(0))
    inner = chains.select("id").unionByName(circles.select("id"))
    ends = chains.select(F.col("id").alias("src"), "up", "first")
    g = stored(e.join(inner.select(F.col("id").alias("dst")), "dst", "left_anti").join(ends, "src", "left").select(F.coalesce("up", "src").alias("src"), "dst", "first"))
    core = _core_components(g.where("src <> dst").select("src", "dst").distinct(), bound)
    # Every node that is no chain's, by its group or alone; chains whose ends are of one group are of it too.
    nodes = g.select(F.col("src").alias("id")).unionByName(g.select(F.col("dst").alias("id"))).distinct().join(core, "id", "left").select("id", F.coalesce("component", "id").alias("group"))
    nodes = stored(nodes)
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("group").alias(f"_{end}"))
    within = g.where("first is not null").join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("first", F.col("_src").alias("group")).distinct()
    all_ = nodes.unionByName(chains.join(within, "first").select("id", "group"))
    if not circles.isEmpty():
        # The least of a circle, by doubling: after log n rounds each node has seen all.
        ring = stored(e.join(circles.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("up"), F.least("src", "dst").alias("group")))
        for _ in range(ring.count().bit_length()):
            ahead = ring.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("group").alias("_g"))
            ring = stored(ring.join(ahead, "up").select("id", F.col("_up").alias("up"), F.least("group", "_g").alias("group")))
        all_ = all_.unionByName(ring.select("id", "group"))
    all_ = stored(all_)
    groups = all_.groupBy("group").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return all_.join(groups, "group").select("id", "component")


def _core_components(edges: DataFrame, bound: int) -> DataFrame:
    """Strongly connected groups of two or more: id, component (the least id).

    Nodes of one group are reached by, and reach, the same nodes, so edges between nodes whose greatest ones differ go;
    a node whose greatest one is the same both ways is of that one's group and is done. The rest goes on under new
    orders. No pairs of nodes that reach each other are made: rows grow with nodes and edges. Raises after bound rounds.
    """
    e = stored(edges)
    done, round_, salt = None, 0, 0
    while not e.isEmpty():
        reach, round_ = _greatest_reach(e, salt, round_, bound)
        label = lambda back, k: F.filter("labels", lambda x: (x["back"] == F.lit(back)) & (x["k"] == k))[0]["l"]
        root = F.coalesce(*[F.when(label(False, k) == label(True, k), label(False, k)) for k in range(ORDERS)])
        known = stored(reach.select("v", "labels", root.alias("root")))
        own = known.where("root is not null").select("v", "root", F.lit(salt).alias("at"))
        done = stored(own if done is None else done.unionByName(own))
        left = known.where("root is null")
        side = lambda end: left.select(F.col("v").alias(end), F.col("labels").alias(f"_{end}"))
        before, e = e, stored(e.join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("src", "dst"))
        discard(before, known)
        salt += 1
    if done is None:
        return e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    groups = done.groupBy("at", "root").agg(F.min("v").alias("component"), F.count("*").alias("n")).where("n > 1")
    return done.join(groups, ["at", "root"]).select(F.col("v").alias("id"), "component")


def paths(components: DataFrame, *, bound: int = 64) -> DataFrame:
    """The chain from the root to each component: id, chain (ids), depth. It stops at unknown parents and at cycles."""
    c = settle(components.select("id", "parent"))
    known = c.select(F.col("id").alias("_p"), F.col("parent").alias("_pp"))
    done, open_ = None, settle(c.select("id", F.array("id").alias("chain"), F.col("parent").alias("up")))
    for _ in range(bound):
        step = open_.join(known, open_.up == known._p, "left")
        ended = step.where(F.col("_p").isNull() | F.array_contains("chain", F.col("_p"))).select("id", "chain")
        open_ = settle(step.where(F.col("_p").isNotNull() & ~F.array_contains("chain", F.col("_p"))).select("id", F.concat(F.array("_p"), F.col("chain")).alias("chain"), F.col("_pp").alias("up")))
        done = ended if done is None else done.unionByName(ended)
        done = settle(done)
        if open_.isEmpty():
            return done.withColumn("depth", F.size("chain") - 1)
    raise RuntimeError(f"containment deeper than {bound}")


def folded(components: DataFrame, depth: int) -> DataFrame:
    """Each component's ancestor at a depth from its root, itself if it is not that deep: id, at."""
    return paths(components).select("id", F.element_at("chain", F.least(F.lit(depth + 1), F.size("chain"))).alias("at"))


def rolled_up(evidence: DataFrame, components: DataFrame, depth: int) -> DataFrame:
    """Observations with their ends folded to a depth; those whose ends fall together drop out, unknown ends stay."""
    fold = folded(components, depth)
    e = evidence.join(fold.select(F.col("id").alias("src"), F.col("at").alias("_src")), "src", "left").join(fold.select(F.col("id").alias("dst"), F.col("at").alias("_dst")), "dst", "left")
    rest = [c for c in evidence.columns if c not in ("src", "dst")]
    return e.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), *rest).where("src <> dst")


def cycle_levels(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """Whether a cycle of components is one of files too: component, level (unknown, no_cycle, cycle, cycle_without_local).

    evidence: src, dst, file, target, scope of what runs in production. Pairs of file and target between members of one
    group are edges of files; a group of files in a cycle that spans two members makes a cycle, and it may stay one
    when what is loaded within functions (scope local) is left out.
    """
    member = groups.select(F.col("id"), "component")
    pairs = evidence.where("file is not null and target is not null").join(member.select(F.col("id").alias("src"), "component"), "src").join(member.select(F.col("id").alias("dst"), F.col("component").alias("_c")), "dst").where("component = _c")
    pairs = settle(pairs.select("component", "src", "dst", "file", "target", "scope"))
    owner = pairs.select("component", F.col("file").alias("id"), F.col("src").alias("own")).unionByName(pairs.select("component", F.col("target").alias("id"), F.col("dst").alias("own"))).distinct()

    def spanning(rows: DataFrame) -> DataFrame:
        inside = strong_components(rows.select("component", F.concat_ws("\0", "component", "file").alias("src"), F.concat_ws("\0", "component", "target").alias("dst")))
        own = inside.select(F.col("component").alias("_g"), F.split("id", "\0").alias("k")).select("_g", F.element_at("k", 1).alias("component"), F.element_at("k", 2).alias("id"))
        return own.join(owner, ["component", "id"]).groupBy("component", "_g").agg(F.count_distinct("own").alias("n")).where("n >= 2").select("component").distinct()

    any_, hard = spanning(pairs), spanning(pairs.where("scope <> 'local'"))
    seen = pairs.select("component").distinct().withColumn("_seen", F.lit(True))
    out = groups.select("component").distinct().join(seen, "component", "left").join(any_.withColumn("_any", F.lit(True)), "component", "left").join(hard.withColumn("_hard", F.lit(True)), "component", "left")
    return out.select("component", F.when(F.col("_seen").isNull(), "unknown").when(F.col("_any").isNull(), "no_cycle").when(F.col("_hard").isNull(), "cycle").otherwise("cycle_without_local").alias("level"))


def propagated(passes: DataFrame, own: DataFrame, *, bound: int = 64) -> DataFrame:
    """Least fix-point of names through whole re-exports: passes (src re-exports all of dst), own (id, name) to id, name."""
    p = settle(passes.select("src", "dst").distinct())
    have = fresh = settle(own.select("id", "name").distinct())
    for i in range(bound + 1):
        if fresh.isEmpty():
            return have
        _bounded(i, bound)
        step = p.join(fresh, p.dst == fresh.id).select(F.col("src").alias("id"), "name").distinct()
        fresh = settle(step.join(have, ["id", "name"], "left_anti"))
        have = settle(have.unionByName(fresh))
    raise AssertionError


def levels(edges: DataFrame, *, bound: int = 10_000) -> DataFrame:
    """Of an acyclic graph, the longest path below each node: id, level; what depends on nothing is 0. A cycle raises.

    Nodes all of whose dependencies are done are done a round later. After PATIENCE rounds the rest is gone through
    with its chains taken as one edge each.
    """
    e = settle(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("cost")).distinct())
    nodes = settle(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())

    def peeled(e: DataFrame, nodes: DataFrame, most: int) -> DataFrame | None:
        left, done = nodes.withColumn("level", F.lit(0).cast("long")), None
        for i in range(most):
            if left.isEmpty():
                return left if done is None else done
            ready = settle(left.join(e.select(F.col("dst").alias("id")), "id", "left_anti"))
            if ready.isEmpty():
                raise ValueError("the graph has a cycle")
            done = ready if done is None else gathered(done, ready, i)
            step = e.join(ready.select(F.col("id").alias("src"), "level"), "src")
            reached = step.groupBy(F.col("dst").alias("id")).agg(F.max(F.col("level") + F.col("cost")).alias("_l"))
            left = settle(left.join(ready.select("id"), "id", "left_anti").join(reached, "id", "left").select("id", F.greatest("level", F.coalesce("_l", F.lit(0))).alias("level")))
            e = settle(e.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        return None

    found = peeled(e, nodes, min(PATIENCE, bound))
    if found is None:
        chains, circles = _chains(e, nodes.limit(0))
        if not circles.isEmpty():
            raise ValueError("the graph has a cycle")
        start = chains.select(F.col("id").alias("src"), "up", F.col("off").alias("_off"))
        g = e.join(chains.select(F.col("id").alias("dst")), "dst", "left_anti").join(start, "src", "left")
        g = settle(g.groupBy(F.coalesce("up", "src").alias("src"), "dst").agg(F.max(F.col("cost") + F.coalesce("_off", F.lit(0))).alias("cost")))
        if not g.where("src = dst").isEmpty():
            raise ValueError("the graph has a cycle")
        found = peeled(g, settle(nodes.join(chains.select("id"), "id", "left_anti")), bound)
        if found is None:
            raise RuntimeError(f"more than {bound} levels")
        found = found.unionByName(chains.join(found.select(F.col("id").alias("up"), "level"), "up").select("id", (F.col("level") + F.col("off")).alias("level")))
    return found.select("id", F.col("level").cast("int").alias("level"))


def impact(edges: DataFrame, owners: DataFrame, changed: DataFrame, *, links: DataFrame | None = None) -> DataFrame:
    """What a change reaches: id, kind, distance, hop, of files and components, and whether it is a test that reaches it.

    edges: src and dst files of statements that load (src loads dst), test. owners: file, component, test (whether all
    in it is test code). changed: file. Loading costs 1, a file stands for its component at no cost if it is no test.
    The first walk is along statements outside tests; the second takes all, and what only it reaches is the tests.

    links: barrel, file, passes_on, test, as barrels.passed_on gives them. With them edges say which statements pass on
    (passes_on): a file that passes names of a changed one on is then a node of its own, left by its links alone.
    """
    node = lambda kind, column: F.concat(F.lit(kind), column)
    if links is None:
        edges = edges.withColumn("passes_on", F.lit(False))
    direct = changed.select(F.col("file").alias("dst"), F.lit(True).alias("_changed"))
    edges = edges.join(direct, "dst", "left").select("src", "dst", "test", (F.col("passes_on") & F.coalesce("_changed", F.lit(False))).alias("passing"))

    def walk(tests: bool) -> DataFrame:
        of = edges if tests else edges.where("not test")
        ways = of.select(node("f:", F.col("dst")).alias("src"), F.when(F.col("passing"), node("p:", F.col("src"))).otherwise(node("f:", F.col("src"))).alias("dst"), F.lit(1).alias("cost"))
        kinds = ["f:"]
        if links is not None:
            through = links if tests else links.where("not test")
            ways = ways.unionByName(through.select(node("p:", F.col("barrel")).alias("src"), F.when(F.col("passes_on"), node("p:", F.col("file"))).otherwise(node("f:", F.col("file"))).alias("dst"), F.lit(1).alias("cost")))
            kinds.append("p:")
        for kind in kinds:
            ways = ways.unionByName(owners.where("not test").select(node(kind, F.col("file")).alias("src"), node("c:", F.col("component")).alias("dst"), F.lit(0).alias("cost")))
        found = distances(ways, changed.select(node("f:", F.col("file")).alias("id")))
        found = found.withColumns({"id": F.regexp_replace("id", "^p:", "f:"), "hop": F.regexp_replace("hop", "^p:", "f:")})
        return found if links is None else found.groupBy("id").agg(F.min(F.struct("distance", "hop")).alias("x")).select("id", "x.*")

    production, everything = walk(False), walk(True)
    tests = owners.where("test").select(F.concat(F.lit("f:"), "file").alias("id")).distinct()
    only = everything.join(production.select("id"), "id", "left_anti").join(tests, "id", "left_semi").withColumn("test", F.lit(True))
    seeds = everything.where("distance = 0").join(tests, "id", "left_semi").withColumn("test", F.lit(True))
    rest = production.join(seeds.select("id"), "id", "left_anti").withColumn("test", F.lit(False))
    out = rest.unionByName(only).unionByName(seeds.join(only.select("id"), "id", "left_anti"))
    return out.select(F.expr("substring(id, 3)").alias("id"), F.when(F.startswith("id", F.lit("f:")), "file").otherwise("component").alias("kind"), "distance", F.expr("substring(hop, 3)").alias("hop"), "test")


def dependents(edges: DataFrame, keys: Sequence[str] = ("src", "dst")) -> DataFrame:
    """Distinct neighbours each way: id, dependents, dependencies; a partial count is made before each shuffle."""
    s, d = keys
    both = edges.where(F.col(s) != F.col(d)).select(s, d).distinct()
    ends = both.select(F.col(d).alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(both.select(F.col(s).alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies"))
