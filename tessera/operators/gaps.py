"""What could not be traced to a target: totals and first places; ids that collide; methods that statements may call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """Of each key how many rows there are, and the first: keys, total, shown (an array of structs of the other columns, in order).

    The limit on the rank bounds what each task hands on before the shuffle, so a hot key costs a few rows a task, and
    the count is summed in parts.
    """
    rest = [c for c in rows.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", *rest))).alias("shown"))
    shown = F.transform("shown", lambda x: F.struct(*[x[c].alias(c) for c in rest]))
    return rows.groupBy(*keys).agg(F.count("*").alias("total")).join(first.select(*keys, shown.alias("shown")), list(keys))


def gap_lists(places: DataFrame, wanted: DataFrame, *, most: int = 10) -> DataFrame:
    """What may concern subjects unseen, by kind: subject, kind, total, shown (file, line, test, what).

    places: kind, key, file, line, test, what: calls by the path that they load below, imports by the last name that
    they may mean, macros by a name in them. wanted: subject, kind, key, own: the keys that concern a subject, several perhaps (the
    directories above a path, '' for calls without a path), and its own file, whose places don't count. A place has one
    key of a kind that concerns a subject. First comes what is no test, by file and line.

    Lists are made once for each key, of at most `most` places a file and twice as many in all: without any one file
    they still hold the first ones. So a key that many subjects share is never joined as rows.
    """
    p = places.select("kind", "key", "file", "line", "test", "what")
    order = [F.col("test"), F.col("file"), F.col("line"), F.col("what")]
    few = p.withColumn("_f", F.row_number().over(Window.partitionBy("kind", "key", "file").orderBy(*order))).where(F.col("_f") <= most)
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("kind", "key").orderBy(*order))).where(F.col("_k") <= 2 * most).select("kind", "key", F.struct("test", "file", "line", "what").alias("x")).groupBy("kind", "key").agg(F.collect_list("x").alias("list"))
    by_file = p.groupBy("kind", "key", "file").agg(F.count("*").alias("n"))
    totals = by_file.groupBy("kind", "key").agg(F.sum("n").alias("total"))
    lists = totals.join(few, ["kind", "key"])
    met = wanted.select("subject", "kind", "key", "own").distinct().join(lists, ["kind", "key"])
    mine = by_file.select("kind", "key", F.col("file").alias("own"), F.col("n").alias("_mine"))
    met = met.join(mine, ["kind", "key", "own"], "left").withColumn("total", F.col("total") - F.coalesce("_mine", F.lit(0)))
    own = F.filter("list", lambda x: ~x["file"].eqNullSafe(F.col("own")))
    out = met.groupBy("subject", "kind").agg(F.sum("total").alias("total"), F.slice(F.array_sort(F.flatten(F.collect_list(own))), 1, most).alias("shown"))
    return out.where("total > 0").select("subject", "kind", "total", F.transform("shown", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["test"].alias("test"), x["what"].alias("what"))).alias("shown"))


def directories(path: Column) -> Column:
    """A path, the directories above it, and '': the keys under which a call that loads below one of them concerns it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def barrel_gaps(barrels: DataFrame, passing: DataFrame, loading: DataFrame, listed: DataFrame) -> DataFrame:
    """For each barrel the nearest line on the way, all such lines, and the tests that load it but are not listed.

    barrels: target, barrel, origin, place: the files whose names it was followed for, nearest (0, the target) first.
    passing: file, line, target of statements that pass on. loading: file, target, test, type_only, replaces. listed:
    target, file. A barrel without a line from its origins gives all its lines. Tests that take types alone, or that
    replace the barrel with a mock, don't count. target, barrel, line, lines, tests_not_listed.
    """
    s = passing.where("file <> target").select(F.col("file").alias("barrel"), "line", F.col("target").alias("origin")).distinct()
    on_way = barrels.join(s, ["barrel", "origin"]).select("target", "barrel", "line", "place")
    every = barrels.select("target", "barrel").distinct().join(on_way.select("target", "barrel").distinct(), ["target", "barrel"], "left_anti").join(s, "barrel").select("target", "barrel", "line", F.lit(None).cast("int").alias("place"))
    lines = on_way.unionByName(every).groupBy("target", "barrel").agg(F.min_by("line", F.struct(F.coalesce("place", F.lit(2147483647)), "line")).alias("line"), F.array_sort(F.collect_set("line")).alias("lines"))
    tests = loading.where("test and not type_only and not replaces").select(F.col("target").alias("barrel"), "file").distinct()
    mocks = loading.where("replaces").select(F.col("target").alias("barrel"), "file").distinct()
    tests = tests.join(mocks, ["barrel", "file"], "left_anti")
    missed = lines.select("target", "barrel").join(tests, "barrel").join(listed.select("target", "file").distinct(), ["target", "file"], "left_anti").groupBy("target", "barrel").agg(F.count("*").alias("tests_not_listed"))
    return lines.join(missed, ["target", "barrel"], "left").na.fill(0, ["tests_not_listed"])


def method_takers(methods: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements that may call methods that another file has for a type: methods_in, file, line, name.

    methods: type_file, file, name, test: files that hold methods of a type of type_file. statements: file, line, target,
    name (`*` or null: the whole file), test. Only test code can call what test code defines, and a file doesn't take from itself. A
    statement comes once for each file of methods, with the least name of a type that it takes.
    """
    m = methods.select(F.col("type_file").alias("target"), F.col("file").alias("methods_in"), "name", F.col("test").alias("_test")).distinct()
    s = statements.select("file", "line", "target", F.col("name").alias("_name"), "test")
    whole = s.where("_name is null or _name = '*'").drop("_name").distinct().join(m, "target")
    named = s.where("_name <> '*'").withColumnRenamed("_name", "name").join(m, ["target", "name"])
    both = named.select("methods_in", "file", "line", "name", "test", "_test").unionByName(whole.select("methods_in", "file", "line", "name", "test", "_test"))
    return both.where("methods_in <> file and (not _test or test)").groupBy("methods_in", "file", "line").agg(F.min("name").alias("name"))


def separated(components: DataFrame, sources: Sequence[str]) -> DataFrame:
    """New ids for components that another source named first, for something at another path: source, id, new_id.

    components: source, pos, id, path. Sources come in the given order. An id that an earlier source has at another
    path becomes `id+source`, with all ids below it (`id::...`); the outermost such id counts. A new id that collides again gets the
    suffix again. An id's path is the first that its source gives. One row for each source and id.
    """
    given = components.groupBy("source", "id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("pos"))).alias("path"))
    known, out = None, None
    for source in sources:
        own = given.where(F.col("source") == source).select("id", "path", F.col("id").alias("new_id"))
        while known is not None:
            theirs = known.select(F.col("new_id").alias("_id"), F.col("path").alias("_path"))
            hit = settle(own.join(theirs, own.new_id == theirs._id).where(~F.col("path").eqNullSafe(F.col("_path"))).select(F.col("new_id").alias("head")).distinct())
            if hit.isEmpty():
                break
            parts = F.split("new_id", "::")
            heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
            outer = own.select("id", F.explode(heads).alias("head")).join(hit, "head").groupBy("id").agg(F.min_by("head", F.length("head")).alias("head"))
            own = settle(own.join(outer, "id", "left").select("id", "path", F.when(F.col("head").isNull(), F.col("new_id")).otherwise(F.concat("head", F.lit(f"+{source}"), F.expr("substring(new_id, length(head) + 1)"))).alias("new_id")))
        named = own.select(F.lit(source).alias("source"), "id", "new_id")
        out = named if out is None else out.unionByName(named)
        mine = own.select("new_id", "path", F.lit(len(sources)).alias("_at"))
        known = settle(mine if known is None else known.withColumn("_at", F.lit(0)).unionByName(mine).groupBy("new_id").agg(F.min_by("path", F.when(F.col("path").isNotNull(), F.col("_at"))).alias("path"), F.min("_at").alias("_at")))
    return out


def renamed(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Rows of sources (source and columns of ids) with the ids that separated gives."""
    for c in columns:
        new = names.select("source", F.col("id").alias(c), F.col("new_id").alias("_new"))
        rows = rows.join(new, ["source", c], "left").withColumn(c, F.coalesce("_new", c)).select(*rows.columns)
    return rows
