"""Sessions, and what Python workers need in order to import this package."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_can_import(spark: SparkSession) -> None:
    """Put the package's folder on the Python path of the workers, where it is not installed or shipped (--py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def local_session(threads: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and single machines; on a cluster bring your own."""
    base = {
        "spark.sql.shuffle.partitions": str(threads if isinstance(threads, int) else 8),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{threads}]").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, in a local session, a folder of our own where it is unset, as in tests.

    On a cluster executors can't read each other's local disks, so there it must be set.
    """
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/tessera-shared-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df computed and cut from its lineage in the shared folder, so that loops neither recompute nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which a query's shuffle files go when it ends, instead of when the driver collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df as a table in the shared folder: like settle, for loops that join a table with itself.

    A checkpoint keeps the planner's estimate of what it was made of, and estimates of joins multiply: in such a loop they soon
    have millions of digits. A table has the size that it has, is made once (a checkpoint runs its last stage twice) and
    compressed. The shuffle files that it took go with the write.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(at)  # a new plan, which takes the setting
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(at)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables as `stored` gave them, which nothing reads any more."""
    for df in tables:
        for at in {file.rpartition("/")[0] for file in df.inputFiles()}:
            forget(df.sparkSession, at)


def cut(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows of table whose key is among those of rows, a stored table: where these are few, table is read and not exchanged."""
    return table.join(rows.select(*on), on, "left_semi")


def unseen(rows: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a stored table whose key is not in seen."""
    return rows.join(cut(seen, rows, on), on, "left_anti")


def gathered(all_: DataFrame, new: DataFrame, round_: int) -> DataFrame:
    """Rows with those that a round added: written anew every eighth round, so that neither plans nor copies grow with rounds.

    Then the tables of all_ are deleted; the one of new, which the next round still reads, is not.
    """
    both = all_.unionByName(new)
    if round_ % 8 < 7:
        return both
    whole = stored(both)
    discard(all_)
    return whole
