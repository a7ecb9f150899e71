"""Streams that keep what they need of each key in the state store: newest versions, and stock by product.

Both give the same whatever the order and the repeats in which rows arrive. They ask for the state store of RocksDB
(spark.sql.streaming.stateStore.providerClass), which holds state on executors' disks and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "product_id bigint, warehouse_id bigint, on_hand bigint, order_id bigint, line_no int, quantity bigint, at timestamp"


class Newest(StatefulProcessor):
    """Of each key the greatest (version, text) so far; a row passes if it is greater than that."""

    def init(self, handle) -> None:
        self.best = handle.getValueState("best", "version timestamp, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).assign(_text=lambda r: r["text"].fillna("")).sort_values(["last_updated", "_text"], na_position="first", kind="stable")
        top = batch.iloc[-1:]
        version, text = top["last_updated"].iloc[0], top["_text"].iloc[0]
        known = self.best.get()
        own = (pd.Timestamp.min if pd.isna(version) else pd.Timestamp(version), text)
        if known is None or own > (pd.Timestamp(known[0]) if known[0] is not None else pd.Timestamp.min, known[1]):
            self.best.update((None if pd.isna(version) else pd.Timestamp(version).to_pydatetime(), text))
            yield top.drop(columns="_text")

    def close(self) -> None:
        pass


def newest_versions(rows: DataFrame) -> DataFrame:
    """A stream of resources (resource_id, text, last_updated and others) less what is older than, or the same as, a row that
    has passed before. The last row of each key that comes out is its newest version. Rows without a time are the oldest."""
    return rows.groupBy("resource_id").transformWithStateInPandas(Newest(), rows.schema, "Append", "None")


class Stock(StatefulProcessor):
    """A product's stock by warehouse. Lines wait until the watermark has passed their time and are then applied in the order
    of their times; what comes later than that may be a repeat, and Spark leaves it out (numRowsDroppedByWatermark)."""

    def __init__(self, returned: bool):
        self.returned = returned

    def init(self, handle) -> None:
        self.handle = handle
        self.stock = handle.getMapState("stock", "warehouse_id bigint", "region_id int, on_hand bigint")
        self.pending = handle.getMapState("pending", "order_id bigint, line_no int", "at bigint, region_id int, quantity bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for row in initialState.itertuples():
            self.stock.updateValue((int(row.warehouse_id),), (int(row.region_id), int(row.on_hand)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for row in frame.itertuples():
                at = int(pd.Timestamp(row.at).value // 1_000_000)
                self.pending.updateValue((int(row.order_id), int(row.line_no)), (at, int(row.region_id), int(row.quantity)))
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, moves = timerValues.getCurrentWatermarkInMs(), []
        due = sorted((v[0], *k, v[1], v[2]) for k, v in self.pending.iterator() if v[0] <= passed)
        places = {k[0]: tuple(v) for k, v in self.stock.iterator()} if due else {}
        for at, order, line, region, quantity in due:
            self.pending.removeKey((order, line))
            own = [(on_hand if self.returned else -on_hand, w) for w, (r, on_hand) in places.items() if r == region]
            if own:  # returns go to the emptiest warehouse of the region, the fullest one serves; nothing falls below 0
                w = min(own)[1]
                on_hand = places[w][1] + quantity if self.returned else max(places[w][1] - quantity, 0)
                places[w] = (region, on_hand)
                self.stock.updateValue((w,), places[w])
                moves.append((int(key[0]), w, on_hand, order, line, quantity, pd.Timestamp(at, unit="ms")))
        if moves:
            yield pd.DataFrame(moves, columns=["product_id", "warehouse_id", "on_hand", "order_id", "line_no", "quantity", "at"])

    def close(self) -> None:
        pass


def stock_moves(lines: DataFrame, tables: dict[str, DataFrame], late: str = "1 hour", returned: bool = False) -> DataFrame:
    """A stream of order lines (order_id, line_no, product_id, quantity, at) as stock moves: the warehouse's stock after each
    line, in the order of the lines' times. Only the products of a batch are looked at. A line that comes twice before its
    time is due counts once; one that comes later than ``late`` behind the newest is left out."""
    places = tables["employees"].select(F.col("employee_id").cast("bigint").alias("warehouse_id"), "region_id")
    stock = tables["stock"].select(F.col("product_id").cast("bigint").alias("product_id"), F.col("warehouse_id").cast("bigint").alias("warehouse_id"), F.col("on_hand").cast("bigint").alias("on_hand")).join(places, "warehouse_id")
    homes = tables["orders"].select("order_id", "customer_id").join(tables["customers"].select("customer_id", "region_id"), "customer_id").select("order_id", "region_id")
    own = lines.withWatermark("at", late).join(homes, "order_id")
    rows = own.select(F.col("product_id").cast("bigint").alias("product_id"), F.col("order_id").cast("bigint").alias("order_id"), F.col("line_no").cast("int").alias("line_no"), F.col("quantity").cast("bigint").alias("quantity"), F.col("region_id").cast("int").alias("region_id"), "at")
    initial = stock.select("product_id", "warehouse_id", F.col("region_id").cast("int").alias("region_id"), "on_hand").groupBy("product_id")
    return rows.groupBy("product_id").transformWithStateInPandas(Stock(returned), MOVES, "Append", "EventTime", initialState=initial)


def appended(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over what has landed, its rows appended to Parquet files."""
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"keyed streams need the state store {PROVIDER}")
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stock_after(moves: DataFrame, stock: DataFrame) -> DataFrame:
    """(product_id, warehouse_id, on_hand) after the moves: the last one of each warehouse, else what it began with."""
    last = moves.groupBy("product_id", "warehouse_id").agg(F.max_by("on_hand", F.struct("at", "order_id", "line_no")).alias("_now"))
    return stock.join(last, ["product_id", "warehouse_id"], "left").withColumn("on_hand", F.coalesce("_now", "on_hand").cast("bigint")).drop("_now")
