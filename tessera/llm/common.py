"""Helpers shared by the corpus operators: reading, shared scratch tables, graph components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import discard, forget, shared_folder, stored, workers_can_import  # noqa: F401

#: Rows of one Arrow batch; bounds the Python workers' memory when texts are long.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *, null: str | None = "") -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text becomes `null`."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(text, F.lit(null)) if null is not None else text).alias("text"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    return stored(df, name)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, in workers that can import this package."""
    workers_can_import(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with state made once per task: make() returns the function from a batch to columns."""
    small_batches(df.sparkSession)
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield pa.RecordBatch.from_arrays([out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: edges(a, b) to (node, component), component being the least node.

    Alternates the large-star and small-star steps of the MapReduce connected-components algorithm, which needs
    about log² rounds and whose edge count never grows; each round is checkpointed in the shared folder. Self loops
    and repeated edges are allowed; an empty table gives an empty one. Raises if it has not settled after max_rounds.
    """
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    if not before[0]:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, e = e, written(small, "edges")
        discard(last, large)
        after = mark(e)
        if after == before:
            stars = e.groupBy("a").agg(F.min("b").alias("component"))
            return stars.select(F.col("a").alias("node"), "component").unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
        before = after
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")


_WORD = re.compile(r"\w+")


def plain_words(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


#: Bits of the id filter at most: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as keep it apart from all columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def flagged(df: DataFrame, ids: DataFrame, *, column: str = "doc_id") -> tuple[DataFrame, str]:
    """df with one more boolean column, and its name: false only where the id is surely not among ids (one column of longs).

    A bitmap of hashed ids, of FILTER_BITS at most, is joined by broadcast; it spares a shuffle of texts that a join
    would throw away. With very many ids it lets everything pass. The new name is one that df doesn't have.
    """
    name = ids.columns[0]
    n = ids.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (max(1, 16 * n) - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maybe, bit, word, mask = fresh(df, "maybe", "bit", "word", "mask")
    words = ids.where(F.col(name).isNotNull()).select(place(F.col(name)).alias(bit)).select(F.shiftright(bit, 6).alias(word), F.expr(f"shiftleft(1L, int({bit} & 63))").alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    rows = df.select(*own_columns(df), place(F.col(column)).alias(bit))
    hit = rows.join(F.broadcast(words), F.shiftright(bit, 6) == F.col(word), "left")
    return hit.select(*own_columns(df), F.coalesce(F.expr(f"shiftrightunsigned({mask}, int({bit} & 63)) & 1L = 1L"), F.lit(False)).alias(maybe)), maybe


def possibly_in(df: DataFrame, ids: DataFrame, *, column: str = "doc_id") -> DataFrame:
    """The rows of df whose id may be among ids: none that is goes missing, a few that are not stay."""
    rows, maybe = flagged(df, ids, column=column)
    return rows.where(maybe).select(*own_columns(df))


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows for which the function made once per task says true; all columns stay."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(f(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def without(df: DataFrame, ids: DataFrame, *, column: str = "doc_id") -> DataFrame:
    """The rows of df whose id is not among ids (one column); rows with a null id stay."""
    rows, maybe = flagged(df, ids, column=column)
    (gone,) = fresh(df, "gone")
    rest = rows.where(maybe).join(ids.select(F.col(ids.columns[0]).alias(gone)), F.col(column) == F.col(gone), "left_anti")
    return rows.where(f"not {maybe}").select(*own_columns(df)).unionByName(rest.select(*own_columns(df)))
