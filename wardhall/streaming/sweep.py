"""Retention as a stream: new files of a governed table are swept as they come, each exactly once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..model import Table
from ..operators.dml import with_retention
from ..operators.erase import swept


def sweep_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, table: Table, inserted: str, as_of: dt.datetime | str) -> StreamingQuery:
    """Everything that is there now, once: rows get their expiry and those that are over are erased.

    A batch writes to a folder of its own number, so a batch that runs again replaces what it wrote before.
    """
    from pyspark.sql import functions as F

    rows = spark.readStream.schema(schema).parquet(source)
    kept = with_retention(rows, table.retention_days or 0, F.col(inserted))

    def write(batch: DataFrame, number: int) -> None:
        swept(table, batch, as_of).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return kept.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()
