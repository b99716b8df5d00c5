"""Recording a stream into several tables, so that a batch that is run again changes none of them.

A batch writes its part of every table to a folder of its number, replacing what an
attempt before may have left, and last its line of the ledger. Readers take the batches
that the ledger names; a batch that is there already is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Split = Callable[[DataFrame], dict[str, DataFrame]]
LEDGER = "ledger"


class Recorder:
    """foreachBatch sink of a stream of rows. split gives the rows of each table of a batch; counts the ledger's columns, as aggregates of the batch."""

    def __init__(self, at: str, split: Split, counts: dict[str, Column] | None = None):
        self._at, self._split, self._counts = at.rstrip("/"), split, counts or {}

    def _place(self, table: str, batch: int) -> str:
        return f"{self._at}/{table}/batch={batch}"

    def _recorded(self, spark: SparkSession, batch: int) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self._place(LEDGER, batch)}/_SUCCESS")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if self._recorded(spark, batch):
            return
        rows.persist()
        try:
            for table, part in self._split(rows).items():
                part.write.mode("overwrite").parquet(self._place(table, batch))
            rows.agg(F.count("*").alias("seen"), *(c.alias(n) for n, c in self._counts.items())).coalesce(1).write.mode("overwrite").parquet(self._place(LEDGER, batch))
        finally:
            rows.unpersist()

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row for each batch that was recorded."""
        return spark.read.parquet(f"{self._at}/{LEDGER}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows of the recorded batches, with their batch."""
        return spark.read.parquet(f"{self._at}/{name}").join(self.ledger(spark).select("batch"), "batch", "left_semi")


def record(stream: DataFrame, recorder: Recorder, checkpoint: str) -> None:
    """Run the stream to the end of what is there."""
    stream.writeStream.foreachBatch(recorder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
