"""The polling runs as streams over landing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loamline.operators.index import incremental_ingest
from loamline.operators.snapshots import SnapshotTable
from loamline.plans.retail import decrement_inventory, restock_inventory


def latest_version(batch: DataFrame, key: str = "resource_id", version: str = "last_updated") -> DataFrame:
    """The newest row of each key in a batch; of rows alike in that the one of the greatest text."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc_nulls_last("text") if "text" in batch.columns else F.lit(0))
    return batch.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def stream_ingest(landing: DataFrame, index: SnapshotTable, checkpoint: str, as_of: str) -> StreamingQuery:
    """Resources that land change the buckets of the index that they lie in; a batch is a version. A batch that is run
    again changes nothing; what is older than the stored row is ignored."""

    def batch(df: DataFrame, batch_id: int) -> None:
        fresh = latest_version(df)

        def change(stored: DataFrame) -> DataFrame:
            known = stored.groupBy("resource_id").agg(F.max("last_updated").alias("_known"))
            newer = fresh.join(known, "resource_id", "left").where("_known IS NULL OR last_updated >= _known").drop("_known")
            return incremental_ingest(newer, stored, None, as_of)[0]

        index.upsert(fresh, as_of, batch_id, change=change)

    return landing.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_audit(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A change feed (record_id, before, after: JSON) as audit rows; no state."""
    operation = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    rows = changes.where("NOT (before <=> after)").select("table_name", operation.alias("operation"), "record_id", "changed_at")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_inventory(lines: DataFrame, tables: Callable[[], dict[str, DataFrame]], stock: SnapshotTable, checkpoint: str, returned: bool = False) -> StreamingQuery:
    """Stock after each batch of new lines or returns. stock is bucketed by product and holds the stock before the first
    batch; a batch reads and writes the buckets of its products only, and run again it changes nothing twice."""

    def batch(df: DataFrame, batch_id: int) -> None:
        move = restock_inventory if returned else decrement_inventory
        stock.upsert(df, "", batch_id, change=lambda stored: move(tables() | {"stock": stored}, df))

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(audit: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls, tokens and times by user in tumbling windows; a stream or a batch."""
    by = audit.withWatermark("created_at", late).groupBy(F.window("created_at", width), "user_id")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "user_id", "n", "total", "most")


def stream_usage(audit: DataFrame, out: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Windows that the watermark has passed, appended."""
    return usage_windows(audit, **options).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
