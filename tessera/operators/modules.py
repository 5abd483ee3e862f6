"""Module trees: which files they are made of, and what a name means in a module that takes others whole."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import lexical, parent
from tessera.operators.definitions import HOPS, exported_definitions
from tessera.session import cut, discard, gathered, stored, unseen

_SEP = "::"


def sees(inner: Column, outer: Column) -> Column:
    """Whether a module sees what is private in another: it is that one, or below it."""
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit(_SEP)))


def _key(open_: Column, module: Column) -> Column:
    """A module as seen from within or from without."""
    return F.concat(F.when(open_, "+").otherwise("-"), module)


def glob_definitions(items: DataFrame, uses: DataFrame, globs: DataFrame, asked: DataFrame, *, hops: int = HOPS) -> DataFrame:
    """What names mean in modules: from, module, name, status, def_module, def_name, hops.

    items: module, name, public, what modules define. uses: module, name, target, inner, public, line: name is inner of
    the module target (null: outside). globs: module, target, public, line: all names of target. asked: from, module,
    name, a path that the module `from` writes.

    A module's own items, then its uses, shadow its globs; what isn't public is there for the module itself and those
    below it alone. Globs that lead to different definitions leave the name unknown, also for those that take it from
    there; a glob that leads back to where it started says nothing. Otherwise as definitions.exported_definitions.
    """
    seen_from = F.explode(F.array(F.lit(True), F.lit(False))).alias("_open")
    # A definition is the same from within and from without: module and name stand for it, as a whole file would.
    at = F.concat_ws("\0", "module", "name")
    told = items.select("module", "name", "public", F.lit(0).alias("rank"), F.lit(None).cast("int").alias("line"), F.lit("namespace").alias("kind"), at.alias("target"), F.lit(None).cast("string").alias("inner"))
    told = told.unionByName(uses.select("module", "name", "public", F.lit(1).alias("rank"), F.col("line").cast("int").alias("line"), F.lit("reexport").alias("kind"), _key(sees(F.col("module"), F.col("target")), F.col("target")).alias("target"), "inner"))
    told = told.select("*", seen_from).where("_open or public").select(_key(F.col("_open"), F.col("module")).alias("file"), "name", F.struct("rank", "line", "kind", "target", "inner").alias("x"))
    exports = told.groupBy("file", "name").agg(F.min("x").alias("x")).select("file", "name", "x.kind", "x.target", "x.inner", "x.line", F.lit(False).alias("type_only"))
    stars = globs.where("module <> target").select("*", seen_from).where("_open or public").select(_key(F.col("_open"), F.col("module")).alias("file"), _key(sees(F.col("module"), F.col("target")), F.col("target")).alias("target"), "line", F.lit(False).alias("type_only"))
    wanted = stored(asked.select("from", "module", "name").distinct().withColumn("file", _key(sees(F.col("from"), F.col("module")), F.col("module"))))
    found = exported_definitions(exports, stars, wanted.select("file", "name"), hops=hops, unstarred="")
    part = lambda k: F.substring_index("def_file", "\0", k)
    return wanted.join(found, ["file", "name"]).select("from", "module", "name", "status", part(1).alias("def_module"), part(-1).alias("def_name"), (F.col("hops") - 1).alias("hops"))


def forest(roots: DataFrame, declared: DataFrame, inline: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The modules of crates, grown from their root files, and the declarations that load nothing.

    roots: crate, file. declared: file, inside, name, line, path: `mod name;` in a file, within the inline modules
    `inside` (names joined by ::, '' at the top), with an explicit path or null. inline: file, inside, name: a module
    written out there. files: path, all files there are.

    Modules: crate, module, file, inside, parent, line. A declaration loads name.rs, else name/mod.rs, from the folder of
    its file (of a root, a mod.rs), else from the folder named like the file, and like the inline modules around it. Each
    round claims files for all modules that the last one added: a file is one module of a crate only, the first to be
    reached, ties to the least module and line. Refused: crate, module, line, file of the others (file null: there is none).
    """
    path = F.col("path")
    known = stored(files.select("path").distinct())
    down = F.regexp_replace("file", r"\.rs$", "")
    beside = F.col("file").rlike(r"(^|/)mod\.rs$")
    under = lambda folder, *more: F.concat_ws("/", F.when(folder != "", folder), *more)
    d = stored(declared.select("file", "inside", "name", F.col("line").cast("int").alias("line"), "path"))
    w = stored(inline.select("file", "inside", "name").distinct())
    fresh = roots.groupBy("crate").agg(F.min("file").alias("file")).select("crate", F.lit("").alias("module"), "file", F.lit("").alias("inside"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("line"), parent(F.col("file")).alias("folder"))
    seen = fresh = stored(fresh)
    refused = None
    for i in count():
        if fresh.isEmpty():
            none = known.sparkSession.createDataFrame([], "crate string, module string, line int, file string")
            return seen.drop("folder"), none if refused is None else refused
        child = F.concat_ws(_SEP, F.when(F.col("module") != "", F.col("module")), "name")
        at = F.concat_ws(_SEP, F.when(F.col("inside") != "", F.col("inside")), "name")
        within = fresh.join(w, ["file", "inside"]).select("crate", child.alias("module"), "file", at.alias("inside"), F.col("module").alias("parent"), F.lit(None).cast("int").alias("line"), under(F.col("folder"), "name").alias("folder"))
        wants = fresh.drop("line", "parent").join(d, ["file", "inside"])
        home = F.when(F.col("inside") == "", parent(F.col("file"))).otherwise(F.col("folder"))
        ways = F.when(path.isNotNull(), F.array(lexical(under(home, "path")))).otherwise(F.array(under(F.col("folder"), F.concat("name", F.lit(".rs"))), under(F.col("folder"), "name", F.lit("mod.rs"))))
        wants = wants.select("crate", child.alias("module"), F.col("module").alias("parent"), "line", F.posexplode(ways).alias("rank", "path"))
        found = wants.join(known.withColumn("_there", F.lit(True)), "path", "left").groupBy("crate", "module", "parent", "line").agg(F.min(F.when(F.col("_there"), F.struct("rank", "path"))).alias("x"))
        claims = stored(found.select("crate", "module", "parent", "line", F.col("x.path").alias("file")))
        # Of a module's declarations the first counts, of a file's claims the least; what an earlier round took stays.
        taken = cut(seen.select("crate", "file", F.lit(True).alias("_taken")), claims, ["crate", "file"]).distinct()
        claim = F.struct("module", "line")
        mine = claims.where("file is not null").groupBy("crate", "file").agg(F.min(claim).alias("first"))
        won = stored(claims.join(mine, ["crate", "file"], "left").join(taken, ["crate", "file"], "left").withColumn("won", (F.col("first") == claim) & F.col("_taken").isNull()).select("crate", "module", "parent", "line", "file", F.coalesce("won", F.lit(False)).alias("won")))
        discard(claims)
        folder = F.when(beside, parent(F.col("file"))).otherwise(down)
        loaded = won.where("won").select("crate", "module", "file", F.lit("").alias("inside"), "parent", "line", folder.alias("folder"))
        new = within.unionByName(loaded).groupBy("crate", "module").agg(F.min(F.struct("line", "file", "inside", "parent", "folder")).alias("x")).select("crate", "module", "x.file", "x.inside", "x.parent", "x.line", "x.folder")
        lost = won.where("not won").select("crate", "module", "line", "file")
        refused = lost if refused is None else refused.unionByName(lost)
        new = stored(new)
        fresh = stored(unseen(new, seen.select("crate", "module"), ["crate", "module"]))
        discard(new)
        seen = gathered(seen, fresh, i)
    raise AssertionError
