"""The work snapshot as a stream: what is read is merged into what is held, batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relations import keep_last
from tessera.session import shared_folder


class KeptSnapshot:
    """Rows of which the last read per key stays, in Parquet under a shared folder.

    Each batch is first brought to one row a key, then merged with the version before it and written as a version of
    its own; a version counts once its folder is complete, so a batch that is run again after a failure changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], order: str) -> None:
        self.spark, self.folder, self.key, self.order = spark, folder, key, order

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last = [F.col(self.order)]
        rows = keep_last(batch, self.key, last)
        held = [v for v in self._versions() if v < batch_id]
        if held:
            rows = keep_last(rows.unionByName(self.spark.read.schema(batch.schema).parquet(f"{self.folder}/v{held[-1]}")), self.key, last)
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self._versions()[-1]}")


def kept_by_stream(spark: SparkSession, events: str) -> DataFrame:
    """Reads of items (number, state, read_at, changed) from a folder or file of events, all that is there now."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(events).schema
    base, _, name = events.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").option("maxFilesPerTrigger", 4)
    rows = source.parquet(base if name.endswith(".parquet") else events).select(F.col("user_id").alias("number"), F.col("event_type").alias("state"), F.col("event_id").alias("read_at"), F.unix_timestamp("ts").alias("changed"))
    kept = KeptSnapshot(spark, f"{root}/kept", ["number"], "read_at")
    rows.writeStream.foreachBatch(kept.merge).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start().awaitTermination()
    return kept.read()
