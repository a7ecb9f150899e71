"""Keyed streams: batches out of order, repeated and late give what one batch gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loamline.streaming import keyed

START = datetime.datetime(2001, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, keyed.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def run(spark, make, batches, schema, folder):
    """The rows that come out when the batches land one after the other."""
    folder.mkdir()
    landing, out, state = (str(folder / x) for x in ("in", "out", "state"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(landing)
        keyed.appended(make(spark.readStream.schema(schema).parquet(landing)), out, state).awaitTermination()
    return spark.read.parquet(out)


def test_newest_versions(rocks, tmp_path):
    schema = "resource_id string, text string, last_updated timestamp"
    rng = random.Random(1)
    every = [(f"r{k % 7}", f"t{k}", START + datetime.timedelta(hours=k)) for k in range(30)] + [("r1", None, None), ("r9", "z", None), ("r9", "y", None)]
    mixed = every + every[3:9]
    rng.shuffle(mixed)
    newest = lambda df: rows(df.groupBy("resource_id").agg(F.max_by("text", F.struct("last_updated", "text")).alias("t")), "resource_id", "t")
    parts = run(rocks, keyed.newest_versions, [mixed[:12], mixed[12:25], mixed[25:], mixed[:5]], schema, tmp_path / "a")
    whole = run(rocks, keyed.newest_versions, [every], schema, tmp_path / "b")
    assert newest(parts) == newest(whole) == newest(rocks.createDataFrame(every, schema))
    assert whole.count() == 8 <= parts.count() < len(mixed)


def moved(lines, stock, regions):
    """Lines in the order of their times, each served by the fullest warehouse of its region."""
    now = dict(stock)
    for _, order, line, product, quantity in sorted(set(lines)):
        own = [(-n, w) for (p, w), n in now.items() if p == product and regions[w] == order % 2]
        if own:
            w = min(own)[1]
            now[product, w] = max(now[product, w] - quantity, 0)
    return sorted((p, w, n) for (p, w), n in now.items())


def test_stock_by_product(rocks, tmp_path):
    rng = random.Random(4)
    regions = {w: w % 2 for w in range(1, 6)}
    stock = {(p, w): rng.randrange(5, 60) for p in range(4) for w in regions}
    tables = {
        "employees": rocks.createDataFrame(list(regions.items()), "employee_id int, region_id int"),
        "orders": rocks.createDataFrame([(k, k % 2) for k in range(40)] + [(999, 0)], "order_id int, customer_id int"),
        "customers": rocks.createDataFrame([(0, 0), (1, 1)], "customer_id int, region_id int"),
        "stock": rocks.createDataFrame([(p, w, n) for (p, w), n in stock.items()], "product_id int, warehouse_id int, on_hand bigint"),
    }
    lines = [(START + datetime.timedelta(minutes=rng.randrange(600)), k, i, rng.randrange(4), rng.randrange(1, 15)) for k in range(40) for i in range(3)]
    end = [(START + datetime.timedelta(days=d), 999, d, 77, 1) for d in (9, 10)]  # times that make all others due
    schema = "at timestamp, order_id int, line_no int, product_id int, quantity bigint"
    mixed = lines + lines[:20]
    rng.shuffle(mixed)
    make = lambda s: keyed.stock_moves(s, tables, "20 hours")
    parts = run(rocks, make, [mixed[:50], mixed[50:90], mixed[90:], end[:1], [*end[1:], lines[0]]], schema, tmp_path / "a")
    whole = run(rocks, make, [lines, end[:1], end[1:]], schema, tmp_path / "b")
    expected = moved(lines, stock, regions)
    for moves in (parts, whole):
        assert rows(keyed.stock_after(moves, tables["stock"]), "product_id", "warehouse_id", "on_hand") == expected
    assert parts.count() == whole.count()  # the line that comes again, too late, moves nothing


def test_other_state_stores_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="state store"):
        keyed.appended(spark.createDataFrame([], "a int"), str(tmp_path), str(tmp_path))
