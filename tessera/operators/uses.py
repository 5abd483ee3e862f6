"""Who takes a symbol, through re-exports, and how sets of files relate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.gaps import first_of
from tessera.session import settle

HOPS = 32


def symbol_importers(imports: DataFrame, symbols: DataFrame, *, hops: int = HOPS) -> DataFrame:
    """Statements that take a symbol: symbol, file, line, through (the file it was taken from), kind (name or whole).

    imports: file, line, target, name (`*` for a whole module), alias, passes_on. symbols: symbol, file, name. A
    statement that passes a name on offers it from its own file, under its alias; one that passes a whole module on
    offers all names. States (symbol, file, name) are followed breadth first, each once, so cycles end; a chain longer
    than hops raises.
    """
    i = settle(imports.select("file", "line", "target", "name", F.coalesce("alias", "name").alias("as"), "passes_on"))
    seen = fresh = settle(symbols.select("symbol", "file", "name").distinct())
    for hop in range(hops + 1):
        if fresh.isEmpty():
            break
        if hop == hops:
            raise RuntimeError(f"a chain of more than {hops} re-exports")
        met = i.where("passes_on").join(fresh.select("symbol", F.col("file").alias("target"), F.col("name").alias("_n")), "target").where("name = _n or name = '*'")
        step = met.select("symbol", "file", F.when(F.col("name") == "*", F.col("_n")).otherwise(F.col("as")).alias("name")).distinct()
        fresh = settle(step.join(seen, ["symbol", "file", "name"], "left_anti"))
        seen = settle(seen.unionByName(fresh))
    taken = i.join(seen.select("symbol", F.col("file").alias("target"), F.col("name").alias("_n")), "target").where("name = _n or name = '*'")
    return taken.select("symbol", "file", "line", F.col("target").alias("through"), F.when(F.col("name") == "*", "whole").otherwise("name").alias("kind")).distinct()


def best_routes(routes: DataFrame) -> DataFrame:
    """Of each test and way the fewest steps, whether one of those runs, and the nearest that runs: test, way, steps, runs, running."""
    least = routes.groupBy("test", "way").agg(F.min("steps").alias("steps"), F.min(F.when(F.col("runs"), F.col("steps"))).alias("running"))
    return least.withColumn("runs", F.coalesce(F.col("running") == F.col("steps"), F.lit(False))).select("test", "way", "steps", "runs", "running")


def only_tests(everything: DataFrame, production: DataFrame, changed_tests: DataFrame) -> DataFrame:
    """What only the walk with tests reaches, and the changed tests themselves: id."""
    return everything.select("id").exceptAll(production.select("id")).unionByName(changed_tests.select("id")).distinct()


def loaded_by_listed(loaders: DataFrame, listed: DataFrame) -> DataFrame:
    """Helpers' loaders that are among the listed tests: id."""
    return loaders.select("id").intersect(listed.select("id"))


def known_files(*sources: DataFrame) -> DataFrame:
    """Distinct files of several relations: file."""
    out = sources[0].select("file")
    for s in sources[1:]:
        out = out.unionByName(s.select("file"))
    return out.where("file is not null").distinct()


def display_names(components: DataFrame) -> DataFrame:
    """A component's name, or its id where others share the name or it has none: id, shown."""
    shared = components.where("name is not null").groupBy("name").agg((F.count("*") > 1).alias("_shared"))
    return components.join(shared, "name", "left").select("id", F.when(F.col("_shared"), F.col("id")).otherwise(F.coalesce("name", "id")).alias("shown"))


def first_evidence(evidence: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The first observations of each edge, by file and line, and how many there are: keys, places, total."""
    return first_of(evidence.select(*keys, "file", "line").distinct(), keys, [F.col("file"), F.col("line")], most).withColumnRenamed("shown", "places")


def newest(links: DataFrame, commits: DataFrame) -> DataFrame:
    """The time of the newest commit of each item: number, newest."""
    return links.join(commits.select("id", "time"), "id").groupBy("number").agg(F.max("time").alias("newest"))


def tree_under_cap(components: DataFrame, degrees: DataFrame, most: int) -> list[str]:
    """Ids to show, packages by degree first, then modules whose missing ancestors fit too.

    A choice of a few rows from a ranked list: the ranking is Spark's, the driver takes from its head as long as there
    is room.
    """
    from tessera.operators.graph import paths

    ranked = components.where("kind <> 'external'").join(degrees, "id", "left").withColumn("degree", F.coalesce(F.col("dependents") + F.col("dependencies"), F.lit(0)))
    rows = ranked.join(paths(components.where("kind <> 'external'")), "id").select("id", "kind", "chain", "degree").orderBy(F.col("kind") != "package", F.desc("degree"), "id").limit(20 * most).collect()
    shown: list[str] = []
    for r in rows:
        new = [x for x in r.chain if x not in shown]
        if len(shown) + len(new) <= most:
            shown += new
    return shown
