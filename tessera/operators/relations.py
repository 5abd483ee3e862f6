"""Merging, counting and ranking of relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import settle

STATEMENT = ("file", "line")


def merge_edges(evidence: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("src", "dst", "kind")) -> DataFrame:
    """One edge per key; its observations as a sorted set. Partial sets are made before the shuffle."""
    return evidence.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("evidence"))


def union_edges(edges: DataFrame, keys: Sequence[str] = ("src", "dst", "kind")) -> DataFrame:
    """The same over edges that already hold sets: merging fragments one at a time or all at once gives the same."""
    return edges.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))


def merge_components(rows: DataFrame, order: str) -> DataFrame:
    """One component per id: for each column the first known value in order; observations united."""
    known = [c for c in rows.columns if c not in ("id", "evidence", order)]
    first = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in known]
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")] if "evidence" in rows.columns else []
    return rows.groupBy("id").agg(*first, *more)


def merge_symbols(rows: DataFrame, order: str, fill: Sequence[str] = ("signature",)) -> DataFrame:
    """One symbol per id: the last record, its missing columns filled from the latest that had them."""
    known = [c for c in rows.columns if c not in ("id", order)]
    last = [(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))) if c in fill else F.max_by(c, order)).alias(c) for c in known]
    return rows.groupBy("id").agg(*last)


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last read of each key: an aggregate, so one row per key and task is all that travels."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def statements(test: str | None = None) -> Column:
    """Distinct statements, (file, line) with a line that may be null; with test = "test" or "production", of these."""
    place = F.struct(*STATEMENT)
    if test:
        place = F.when(F.col("test") if test == "test" else ~F.col("test"), place)
    return F.count_distinct(place)


def statement_counts(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct statements of each key, and those of production and test code: keys, statements, production, tests.

    Observations are merged by statement once, in parts before the shuffle, and then counted.
    """
    per = evidence.groupBy(*keys, *STATEMENT).agg(F.max(~F.col("test")).alias("_p"), F.max("test").alias("_t"))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    return per.groupBy(*keys).agg(F.count("*").alias("statements"), n("_p").alias("production"), n("_t").alias("tests"))


def test_code(observations: DataFrame) -> DataFrame:
    """A file is test code if all that is recorded in it is."""
    return observations.groupBy("file").agg(F.bool_and("test").alias("test_code"))


def pair_classes(evidence: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    """Statements of each pair by class, a statement counting once, as the least class of its observations."""
    least = evidence.groupBy(*keys, *STATEMENT).agg(F.min(rank).alias("class"))
    return least.groupBy(*keys, "class").agg(F.count("*").alias("statements"))


def competition_rank(rows: DataFrame, by: str, *, into: str = "rank") -> DataFrame:
    """1 + the number of rows with strictly more, without a window over all rows: counts by value are summed instead."""
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    ahead = counts.select(by, (F.coalesce(F.sum("_n").over(Window.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1).alias(into))
    return rows.join(ahead, by)


def in_order(rows: DataFrame, order: Sequence[Column], *, into: str = "place") -> DataFrame:
    """Rows with their place in an order, from 1: ranges are sorted side by side, and the sizes of those before are added."""
    columns = rows.columns
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The generated number has the partition in its upper bits and the row's place in it in the lower 33.
    marked = settle(dealt.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(before, "_part").select(*columns, place.cast("int").alias(into))


def top_with_rest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group, with rank and the number of those left out."""
    w = Window.partitionBy(*keys)
    total = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= k)
    return ranked.join(total, list(keys)).withColumn("rest", F.greatest(F.col("_total") - k, F.lit(0))).drop("_total")


def one_per_statement(sites: DataFrame, keys: Sequence[str], prefer: Sequence[Column]) -> DataFrame:
    """One row per statement, the preferred one."""
    return sites.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *STATEMENT).orderBy(*prefer))).where("_n = 1").drop("_n")


def coverage(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Files, files read and scripts per language; read is null where no analyzer reads it. files: ext, read, script; languages: ext, language, analyzed."""
    known = files.join(F.broadcast(languages), "ext")  # a fixed table of suffixes
    return known.groupBy("language").agg(F.count("*").alias("files"), F.when(F.bool_or("analyzed"), F.sum(F.col("read").cast("long"))).alias("read"), F.sum(F.col("script").cast("long")).alias("scripts"))


def name_classes(components: DataFrame, by: str = "name") -> DataFrame:
    """Components that share their name or path with others: id, first (the least id of that name) and n, how many have it."""
    shared = components.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return components.join(shared, by).select("id", "first", "n")


def namesakes(components: DataFrame, by: str = "name") -> DataFrame:
    """Other components of one's name or path: id, other."""
    shared = components.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1").select(by)
    own = components.join(shared, by).select(by, "id")
    return own.join(own.withColumnRenamed("id", "other"), by).where("id <> other").select("id", "other")


def normalized_relations(rows: DataFrame, order: str) -> DataFrame:
    """One relation per type, ends and time: observations united, the first known will_close kept."""
    return rows.groupBy("type", "from", "to", "at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("observed")))).alias("observed"), F.min_by(F.when(F.col("will_close").isNotNull(), F.col("will_close")), F.when(F.col("will_close").isNotNull(), F.col(order))).alias("will_close"))


def summed_maps(rows: DataFrame, column: str) -> DataFrame:
    """Entries of a map column summed over all rows: key, total."""
    return rows.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"))


def production_first(files: DataFrame, *, test: str = "test") -> DataFrame:
    """Files outside tests before those of tests, each by path."""
    return files.orderBy(test, "file")


def every_kind(**candidates: DataFrame) -> DataFrame:
    """Candidates of several kinds in one table: kind, and the columns of any; what a kind lacks is null."""
    out = None
    for kind, rows in candidates.items():
        tagged = rows.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out.distinct()
