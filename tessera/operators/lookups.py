"""Longest-prefix and best-match joins, made equi-joins by exploding the short side's prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import ancestors, base, extension, parent, prefixes
from tessera.operators.predicates import selector_matches


def nearest(rows: DataFrame, path: str, owners: DataFrame, at: str, *, itself: bool = True) -> DataFrame:
    """Each row with the columns of the owner whose directory is the nearest at or above its path; rows without one go.

    owners has one row per `at`. A path has few ancestors, so the explosion is linear and the join an equi-join.
    """
    up = rows.withColumn("_up", F.explode(ancestors(F.col(path), itself=itself)))
    found = up.join(owners.withColumnRenamed(at, "_up"), "_up").withColumn("_len", F.length("_up"))
    keep = [c for c in rows.columns if c != path]
    best = [F.max_by(c, "_len").alias(c) for c in owners.columns if c != at]
    return found.groupBy(path, *keep).agg(*best, F.max_by("_up", "_len").alias(at))


def path_owners(files: DataFrame, components: DataFrame, places: DataFrame) -> DataFrame:
    """The component that owns each file: file, owner.

    files: file. components: id, path. places: id, file of what is recorded in a component's name, for ties. The
    nearest path at or above the file wins; of several components there the one with most evidence for the file: for
    the directory itself 1 if something is recorded right inside it, else 2 if something is recorded in the file, 1 if
    in a file beside it with the same extension (any, if it has none); then the greatest id.
    """
    up = files.select("file", F.explode(ancestors(F.col("file"))).alias("path"))
    near = up.join(components.where(F.col("path").isNotNull()).select("id", "path"), "path")
    seen = places.select("id", "file", parent(F.col("file")).alias("dir"), extension(F.col("file")).alias("ext"))
    in_file = seen.select("id", "file").distinct().withColumn("_file", F.lit(True))
    beside = seen.select("id", "dir", "ext").distinct().withColumn("_ext", F.lit(True))
    inside = seen.select("id", "dir").distinct().withColumn("_dir", F.lit(True))
    t = near.withColumns({"dir": F.when(F.col("file") == F.col("path"), F.col("path")).otherwise(parent(F.col("file"))), "ext": extension(F.col("file"))})
    t = t.join(in_file, ["id", "file"], "left").join(inside, ["id", "dir"], "left")
    t = t.join(beside.withColumnRenamed("ext", "_e"), (t.id == beside.id) & (t.dir == beside.dir) & (t.ext == F.col("_e")), "left").select(t["*"], "_ext")
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    score = F.when(F.col("file") == F.col("path"), some("_dir").cast("int")).when(some("_file"), 2).when(F.when(F.col("ext").isNull(), some("_dir")).otherwise(some("_ext")), 1).otherwise(0)
    return t.groupBy("file").agg(F.max_by("id", F.struct(F.length("path"), score, F.col("id"))).alias("owner"))


def membership(components: DataFrame, declared: DataFrame) -> DataFrame:
    """The declaration of each component, of the longest selector that matches and then the least name: id, name.

    declared: name, selector; a rule file's few rows, which are broadcast.
    """
    met = components.join(F.broadcast(declared), selector_matches(F.col("selector"), F.col("id"), F.col("kind"), F.col("path")))
    return met.groupBy("id").agg(F.min_by(declared["name"], F.struct(-F.length("selector"), declared["name"])).alias("name"))


def loaded_dependencies(evidence: DataFrame) -> DataFrame:
    """Dependencies as rules see them: src, dst, kind, file, line, target, direct.

    An observation that was made through a re-export (via_file, via_line) counts toward the component of the statement
    at that place, if it is an import of its own outside tests; else toward the component of an import of the same file
    that loads the same target and shares a name; else toward what it names. Ends that fall together drop out, and so
    do observations through others where the statement has a direct one.
    """
    own = evidence.where(~F.col("test"))
    direct, via = own.where(F.col("via_file").isNull()), own.where(F.col("via_file").isNotNull())
    at = direct.groupBy("file", "line").agg(F.min("dst").alias("_at"))
    by_name = direct.select("file", "target", F.explode("names").alias("_n"), "dst").groupBy("file", "target", "_n").agg(F.min("dst").alias("_dst"))
    v = via.withColumn("_id", F.struct("src", "dst", "kind", "file", "line", "target", "via_file", "via_line"))
    names = v.select("_id", "via_file", "target", F.explode("names").alias("_n"))
    shared = names.join(by_name.select(F.col("file").alias("via_file"), "target", "_n", "_dst"), ["via_file", "target", "_n"]).groupBy("_id").agg(F.min("_dst").alias("_shared"))
    v = v.join(at.select(F.col("file").alias("via_file"), F.col("line").alias("via_line"), "_at"), ["via_file", "via_line"], "left").join(shared, "_id", "left")
    cols = ["src", "dst", "kind", "file", "line", "target"]
    moved = v.select("src", F.coalesce("_at", "_shared", "dst").alias("dst"), *cols[2:], F.lit(False).alias("direct"))
    both = direct.select(*cols, F.lit(True).alias("direct")).unionByName(moved).where("src <> dst").distinct()
    has = both.where("direct").select("src", "dst", "kind", "file", "line").distinct().withColumn("_has", F.lit(True))
    return both.join(has, ["src", "dst", "kind", "file", "line"], "left").where("direct or _has is null").drop("_has")


def cascade(wanted: DataFrame, key: str, steps: Sequence[DataFrame]) -> DataFrame:
    """For each key the answers of the first step that has any, with the step's place and how many it has.

    Each step has the key and `found`. Several answers are candidates, one is the answer.
    """
    tagged = reduce(DataFrame.unionByName, [s.select(key, "found", F.lit(i).alias("step")) for i, s in enumerate(steps)]).distinct()
    mine = tagged.join(wanted.select(key).distinct(), key, "left_semi")
    first = mine.groupBy(key).agg(F.min("step").alias("step"))
    return mine.join(first, [key, "step"]).groupBy(key, "step").agg(F.min("found").alias("found"), F.count("*").alias("answers"))


def longest_known_prefix(names: DataFrame, name: str, known: DataFrame, separator: str = ".") -> DataFrame:
    """The longest leading run of segments that is known: name, prefix. known: prefix."""
    up = names.select(name).distinct().select(name, F.explode(prefixes(F.col(name), separator)).alias("prefix"))
    return up.join(known.select("prefix").distinct(), "prefix").groupBy(name).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def distributions(imports: DataFrame, declared: DataFrame, installed: DataFrame, well_known: DataFrame) -> DataFrame:
    """The declared distribution behind a dotted import: module, distribution, how.

    First a declared one whose name is the longest leading run of segments, joined by hyphens; else the one installed
    distribution that provides the longest known prefix, if it is the only one; else a fixed table. declared: name.
    installed: prefix, distribution. well_known: top, distribution.
    """
    up = imports.select("module").distinct().select("module", F.explode(prefixes(F.col("module"), ".")).alias("prefix"))
    joined = up.join(declared.select(F.col("name").alias("_d")).distinct(), F.translate(F.lower("prefix"), "._", "--") == F.col("_d")).groupBy("module").agg(F.max_by("_d", F.length("prefix")).alias("by_name"))
    met = up.join(installed, "prefix")
    longest = met.groupBy("module").agg(F.max(F.length("prefix")).alias("_len"))
    only = met.join(longest, "module").where(F.length("prefix") == F.col("_len")).groupBy("module").agg(F.min("distribution").alias("_one"), F.count_distinct("distribution").alias("_n"))
    by_record = only.where("_n = 1").join(declared.select(F.col("name").alias("_one")).distinct(), "_one", "left_semi").select("module", F.col("_one").alias("by_record"))
    table = imports.select("module").distinct().join(F.broadcast(well_known), F.substring_index("module", ".", 1) == F.col("top")).join(declared.select(F.col("name").alias("distribution")).distinct(), "distribution", "left_semi").groupBy("module").agg(F.min("distribution").alias("by_table"))
    out = imports.select("module").distinct().join(joined, "module", "left").join(by_record, "module", "left").join(table, "module", "left")
    return out.select("module", F.coalesce("by_name", "by_record", "by_table").alias("distribution"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_record").isNotNull(), "record").when(F.col("by_table").isNotNull(), "table").alias("how")).where("distribution is not null")


def containment_rank(name: Column, wanted: Column) -> Column:
    """How a name holds what is searched: 0 but for case, 1 at its start, 2 at a word's start, 3 inside, 4 but for separators, else null."""
    n, w = F.lower(name), F.lower(wanted)
    bare = lambda c: F.regexp_replace(c, r"[-_./:\s]", "")
    word = F.exists(F.split(n, r"[-_./:\s]"), lambda x: F.startswith(x, w))
    return F.when(n == w, 0).when(F.startswith(n, w), 1).when(word, 2).when(F.contains(n, w), 3).when((bare(w) != "") & F.contains(bare(n), bare(w)), 4)


def near_matches(names: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """The names that hold what is searched, best first: wanted, id, name, place, level.

    names: id, name, kind, test. wanted: a few searches, broadcast. Sorted by level, outside tests first, not external
    first, shorter first, then kind and id.
    """
    from tessera.operators.relations import top_with_rest

    met = names.join(F.broadcast(wanted), F.length("wanted") >= 3).withColumn("level", containment_rank(F.col("name"), F.col("wanted"))).where("level is not null")
    order = [F.col("level"), F.col("test"), (F.col("kind") == "external"), F.length("name"), F.col("kind"), F.col("id")]
    return top_with_rest(met, ["wanted"], order, most).select("wanted", "id", "name", F.col("rank").alias("place"), "level", "rest")


def named(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows of a name, of a base name or of a stem."""
    c = F.col(column)
    return rows.where((c == name) | (base(c) == name) | (F.regexp_replace(base(c), r"\.[^.]*$", "") == name))
