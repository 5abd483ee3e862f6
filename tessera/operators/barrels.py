"""What a change reaches through files that pass names on: which names, under which names, and who takes them.

statements: file, line, target, name, alias, passes_on, test, found. A row per name that a statement takes from target;
name is `*` for the whole file and null for a statement that only loads it. A statement that passes on gives the name
under alias (of a whole file: a namespace; without an alias all its names but `default`). A null target is outside of
the scan. found: the name's definition is known. symbols: file, name, what files define. changed: change, file.

Changes are worked on side by side, by their key; each round joins what the last one added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.definitions import WHOLE
from tessera.session import cut, discard, gathered, stored, unseen

#: How a barrel passes a name of the changed files on: by that name; perhaps, through stars; whatever it does not define.
EXACT, POSSIBLE, ANY = "exact", "possible", "any"
#: Rounds at most; a fix-point that needs more raises.
BOUND = 1000


def exports_of(changed: DataFrame, statements: DataFrame, symbols: DataFrame, *, bound: int = BOUND) -> DataFrame:
    """Names that changed files may export: change, name, open.

    Names they define, pass on by name and that some statement takes from them, and the same of the files that they
    pass on whole. A null name with open says that one of them passes on what is outside of the scan.
    """
    s = stored(statements.select("file", "target", "name", F.coalesce("alias", "name").alias("as"), "passes_on"))
    seen = fresh = stored(changed.select("change", "file").distinct())
    whole = s.where("passes_on and target is not null").where(F.col("name") == WHOLE).where(F.col("as") == WHOLE).select("file", "target").distinct()
    for i in range(bound + 1):
        if fresh.isEmpty():
            break
        if i == bound:
            raise RuntimeError(f"no fix-point after {bound} rounds")
        step = stored(fresh.join(whole, "file").select("change", F.col("target").alias("file")).distinct())
        fresh = stored(unseen(step, seen, ["change", "file"]))
        discard(step)
        seen = gathered(seen, fresh, i)
    own = symbols.select("file", "name")
    taken = s.where("target is not null").select(F.col("target").alias("file"), "name")
    by_name = s.where("passes_on and target is not null").select("file", F.col("as").alias("name"))
    names = own.unionByName(taken).unionByName(by_name).where(F.col("name").isNotNull() & (F.col("name") != WHOLE)).distinct()
    outside = s.where("passes_on and target is null").select("file").distinct()
    open_ = seen.join(outside, "file").select("change", F.lit(None).cast("string").alias("name"), F.lit(True).alias("open")).distinct()
    return seen.join(names, "file").select("change", "name", F.lit(False).alias("open")).distinct().unionByName(open_)


def passed_on(changed: DataFrame, statements: DataFrame, symbols: DataFrame, *, bound: int = BOUND) -> tuple[DataFrame, DataFrame]:
    """The statements that take a changed file's names from a barrel, and what barrels pass on.

    A barrel passes on from a changed file, or from another barrel names that are, or may be, theirs. Links: change,
    barrel, file, line, passes_on, test, of statements that take such a name, that take a barrel whole or that only load it. Passes: change,
    file, name (null: any), how. A name that a statement takes from a barrel that passes any on may be theirs if a changed file may
    export it, and the barrel neither defines it nor passes it on by name from elsewhere. Changed files are no barrels.
    """
    s = statements.select("file", "line", "target", "name", "alias", "passes_on", "test", F.coalesce("found", F.lit(False)).alias("found")).where("target is not null and file <> target")
    s = stored(s)
    exported = stored(exports_of(changed, statements, symbols, bound=bound))
    names, open_ = exported.where("not open").select("change", F.col("name").alias("_e")), exported.where("open").select("change", F.lit(True).alias("_open")).distinct()
    # Names that a barrel's stars can't give: its own, and what it takes by name to pass on.
    shut = symbols.select("file", "name").unionByName(s.where("passes_on").where(F.col("name") != WHOLE).select("file", "name")).distinct()
    own = stored(changed.select("change", "file").distinct())
    # Whether a barrel is shut for a name that a statement takes is the same in all rounds.
    named = stored(s.where(F.col("name") != WHOLE).join(shut.select(F.col("file").alias("target"), "name", F.lit(True).alias("_shut")), ["target", "name"], "left"))
    unnamed = stored(s.where(F.col("name").isNull() | (F.col("name") == WHOLE)).where("not (name is null and passes_on)"))
    taken = ("change", "file", "line", "target", "name", "alias", "passes_on", "test", "found", "_shut", "how")
    outgoing = F.when(F.col("name") == WHOLE, F.col("alias")).otherwise(F.coalesce("alias", "name"))
    start = own.select("change", F.col("file").alias("target")).join(s.where("passes_on and name is not null"), "target")
    start = start.select("change", "file", F.when((F.col("name") == WHOLE) & F.col("alias").isNull(), F.lit(None)).otherwise(outgoing).alias("name"), F.when((F.col("name") == WHOLE) & F.col("alias").isNull(), ANY).otherwise(EXACT).alias("how"))
    seen = fresh = stored(start.join(own, ["change", "file"], "left_anti").distinct())
    links = None
    for i in range(bound + 1):
        if fresh.isEmpty():
            break
        if i == bound:
            raise RuntimeError(f"no fix-point after {bound} rounds")
        state = fresh.select("change", F.col("file").alias("target"), F.col("name").alias("_name"), "how")
        # By name: a name passed on as such, a possible one, or one that may be among any; whole, or loading alone.
        met = state.where("how <> 'any'").withColumnRenamed("_name", "name").join(named, ["target", "name"]).select(*taken)
        # What stars may give of the names that are taken from the barrel by name.
        any_ = state.where("how = 'any'").select("change", "target", F.lit(ANY).alias("how"))
        loose = state.join(open_, "change").select("change", "target", F.lit("open").alias("how")).distinct()
        met = met.unionByName(any_.unionByName(loose).join(named, "target").select(*taken))
        read = stored(met)
        met = read.join(cut(names.select("change", F.col("_e").alias("name"), F.lit(True).alias("_theirs")), read, ["change", "name"]), ["change", "name"], "left")
        theirs, free = F.coalesce("_theirs", F.lit(False)), F.col("_shut").isNull() & (F.col("name") != "default")
        how = F.col("how")
        keep = (how == EXACT) | ((how == POSSIBLE) & theirs & (F.col("found") | free)) | ((how == ANY) & free & theirs) | ((how == "open") & free & ~F.col("found"))
        by_name = met.where(keep).select("change", "file", "line", "target", "name", "alias", "passes_on", "test", F.when(how == EXACT, EXACT).otherwise(POSSIBLE).alias("how"), F.col("name").alias("_out"))
        wholly = state.join(unnamed, "target")
        wholly = wholly.select("change", "file", "line", "target", "name", "alias", "passes_on", "test", "how", F.col("_name").alias("_out"))
        met = stored(by_name.unionByName(wholly).join(own, ["change", "file"], "left_anti"))
        discard(read)
        now = met.select("change", F.col("target").alias("barrel"), "file", "line", "passes_on", "test").distinct()
        links = now if links is None else links.unionByName(now)
        spaced = (F.col("name") == WHOLE) & F.col("alias").isNotNull()
        out = F.when(F.col("name") == WHOLE, F.coalesce("alias", "_out")).otherwise(F.coalesce("alias", "name"))
        step = met.where("passes_on").where(~((F.col("name") == WHOLE) & F.col("alias").isNull() & F.coalesce(F.col("_out") == "default", F.lit(False)))).select("change", "file", out.alias("name"), F.when(spaced, EXACT).otherwise(F.col("how")).alias("how")).distinct()
        step = stored(step)
        same = lambda one, two, c: one[c].eqNullSafe(two[c])
        alike = lambda one, two: same(one, two, "change") & same(one, two, "file") & same(one, two, "name") & same(one, two, "how")
        old = seen.join(step, alike(seen, step), "left_semi")  # as unseen, but names may be null
        fresh = stored(step.join(old, alike(step, old), "left_anti"))
        discard(step)
        seen = gathered(seen, fresh, i)
    if links is None:
        links = changed.sparkSession.createDataFrame([], f"change {changed.schema['change'].dataType.simpleString()}, barrel string, file string, line int, passes_on boolean, test boolean")
    return links.distinct(), seen
