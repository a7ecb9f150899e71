"""The reporting workload: order lines, stock, commissions and churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commission by tier, as a share of sales.
COMMISSION = {"Platinum": "0.080", "Gold": "0.060", "Silver": "0.040"}
TIERS = ("Bronze", "Silver", "Gold", "Platinum")


def fiscal_period(date: Column) -> Column:
    """FY label; the year starts in July, the month keeps its calendar number."""
    year = F.year(date) + F.when(F.month(date) >= 7, 1).otherwise(0)
    return F.concat(F.lit("FY"), year.cast("string"), F.lit("-"), F.lpad(F.month(date).cast("string"), 2, "0"))


def net_line_amount(quantity: Column, unit_price: Column, discount_pct: Column) -> Column:
    """quantity * unit price less discount as decimal(12,2), halves away from zero."""
    gross = (quantity * unit_price * (F.lit(100).cast("decimal(5,2)") - discount_pct)).cast("decimal(26,4)")
    return (gross * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")


def retail_tables(read) -> dict[str, DataFrame]:
    """The workload's tables from the generated ones. read(name) gives a table.

    Supplier stands in for employee and for warehouse, brand for category, part size for lead time, order status F for
    completed; stock and tiers are derived from keys."""
    line, order, cust, part, supp = (read(t) for t in ("lineitem", "orders", "customer", "part", "supplier"))
    stock = line.select("l_partkey", "l_suppkey").distinct()
    on_hand = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 500
    return {
        "regions": read("nation").select(F.col("n_nationkey").cast("int").alias("region_id"), F.col("n_name").alias("region_name")),
        "products": part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"), F.col("p_retailprice").cast("decimal(12,2)").alias("unit_cost"), F.col("p_size").cast("int").alias("lead_days")),
        "customers": cust.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("int").alias("region_id"), (F.col("c_acctbal") >= 0).alias("is_active")),
        "employees": supp.select(F.col("s_suppkey").alias("employee_id"), F.col("s_name").alias("employee_name"), F.col("s_nationkey").cast("int").alias("region_id"), F.element_at(F.array(*map(F.lit, TIERS)), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("tier")),
        "orders": order.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status")),
        "lines": line.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("employee_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"), (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_pct"), F.col("l_returnflag").alias("return_flag"), F.to_date("l_shipdate").alias("ship_date")),
        "stock": stock.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("warehouse_id"), on_hand.cast("int").alias("on_hand"), (20 + F.col("l_partkey") % 131).cast("int").alias("reorder_point")),
    }


def order_line_detail(t: dict[str, DataFrame]) -> DataFrame:
    """One row per order line with its order, customer, product, and net amount."""
    net = net_line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return t["lines"].join(t["orders"], "order_id").join(t["customers"], "customer_id").join(t["products"], "product_id").withColumn("net_amount", net)


def customer_order_summary(t: dict[str, DataFrame]) -> DataFrame:
    by = order_line_detail(t).groupBy("customer_id", "customer_name", "segment")
    return by.agg(F.countDistinct("order_id").alias("n_orders"), F.sum("net_amount").cast("double").alias("total_net"), F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))


def inventory_status(t: dict[str, DataFrame]) -> DataFrame:
    places = t["employees"].select(F.col("employee_id").alias("warehouse_id"), F.col("employee_name").alias("warehouse_name"), "region_id")
    rows = t["stock"].join(t["products"].select("product_id", "product_name"), "product_id").join(places, "warehouse_id").join(t["regions"], "region_id")
    return rows.select("product_id", "product_name", "warehouse_id", "warehouse_name", "region_id", "region_name", "on_hand", "reorder_point", F.when(F.col("on_hand") < F.col("reorder_point"), 1).otherwise(0).alias("is_below"))


def employee_region_map(t: dict[str, DataFrame]) -> DataFrame:
    return t["employees"].join(t["regions"], "region_id").select("employee_id", "employee_name", "tier", "region_id", "region_name")


def returns_detail(t: dict[str, DataFrame]) -> DataFrame:
    back = t["lines"].where("return_flag = 'R'").join(t["orders"].select("order_id", "customer_id", "order_date"), "order_id").join(t["products"].select("product_id", "product_name"), "product_id")
    return back.select("order_id", "line_no", "customer_id", "product_id", "product_name", "quantity", "order_date", "ship_date")


def stage_completed_lines(t: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Lines of completed orders between two dates, both included, with their fiscal period."""
    rows = order_line_detail(t).where("status = 'F'")
    if start is not None:
        rows = rows.where(F.col("order_date") >= F.to_date(F.lit(start)))
    if end is not None:
        rows = rows.where(F.col("order_date") <= F.to_date(F.lit(end)))
    return rows.withColumn("fiscal_period", fiscal_period(F.col("order_date")))


def customer_segment_snapshot(t: dict[str, DataFrame]) -> DataFrame:
    return t["customers"].select("customer_id", "customer_name", "segment", "region_id")


def sales_cube(t: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """Completed lines between two dates, both included, summed by product, employee, customer and fiscal period: quantity,
    net_amount and first (order date). What the sales reports have in common, to be stored and rolled up by each of them:
    lines are read once and meet their orders only. Keys of products and customers are taken to exist."""
    orders = t["orders"].where("status = 'F'").select("order_id", "customer_id", "order_date")
    if start is not None:
        orders = orders.where(F.col("order_date") >= F.to_date(F.lit(start)))
    if end is not None:
        orders = orders.where(F.col("order_date") <= F.to_date(F.lit(end)))
    net = net_line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    rows = t["lines"].select("order_id", "product_id", "employee_id", "quantity", net.alias("net")).join(orders, "order_id")
    by = rows.groupBy("product_id", "employee_id", "customer_id", fiscal_period(F.col("order_date")).alias("fiscal_period"))
    return by.agg(F.sum("quantity").alias("quantity"), F.sum("net").alias("net_amount"), F.min("order_date").alias("first"))


def monthly_sales_by_region(t: dict[str, DataFrame], start: str | None = None, end: str | None = None, cube: DataFrame | None = None) -> DataFrame:
    """Sales by region and period, the prior period's, growth in percent, and the segment that sold most."""
    cube = sales_cube(t, start, end) if cube is None else cube
    by_customer = cube.groupBy("customer_id", "fiscal_period").agg(F.sum("net_amount").alias("net_amount"), F.min("first").alias("first"))
    staged = by_customer.join(t["customers"].select("customer_id", "region_id", "segment"), "customer_id")
    by_segment = staged.groupBy("region_id", "fiscal_period", "segment").agg(F.sum("net_amount").alias("amount"), F.min("first").alias("first"))
    top = F.min_by("segment", F.struct((-F.col("amount")).alias("less"), "segment")).alias("top_segment")  # ties: the first by name
    totals = by_segment.groupBy("region_id", "fiscal_period").agg(F.sum("amount").alias("amount"), F.min("first").alias("first"), top)
    prior = F.lag("amount").over(Window.partitionBy("region_id").orderBy("first"))
    rows = totals.withColumn("prior", prior).join(t["regions"], "region_id")
    growth = F.when(F.col("prior") != 0, F.round((F.col("amount").cast("double") - F.col("prior").cast("double")) / F.col("prior").cast("double") * 100, 2))
    return rows.select("region_id", "region_name", "fiscal_period", F.col("amount").cast("double").alias("total_net"), F.col("prior").cast("double").alias("prior_net"), growth.alias("growth_pct"), "top_segment")


def product_performance(t: dict[str, DataFrame], start: str | None = None, end: str | None = None, cube: DataFrame | None = None) -> DataFrame:
    cube = sales_cube(t, start, end) if cube is None else cube
    sums = cube.groupBy("product_id").agg(F.sum("quantity").alias("quantity"), F.sum("net_amount").alias("revenue"))
    rows = sums.join(t["products"].select("product_id", "product_name", "category", "unit_cost"), "product_id").withColumn("cost", F.col("quantity") * F.col("unit_cost"))
    margin = F.when(F.col("revenue") != 0, F.round((F.col("revenue").cast("double") - F.col("cost").cast("double")) / F.col("revenue").cast("double") * 100, 2))
    return rows.select("product_id", "product_name", "category", "quantity", F.col("revenue").cast("double").alias("revenue"), F.col("cost").cast("double").alias("cost"), margin.alias("margin_pct"))


def employee_commission(t: dict[str, DataFrame], start: str | None = None, end: str | None = None, cube: DataFrame | None = None) -> DataFrame:
    """Commission by employee and period at the rate of the tier that the employee has now."""
    cube = sales_cube(t, start, end) if cube is None else cube
    sums = cube.groupBy("employee_id", "fiscal_period").agg(F.sum("net_amount").alias("sales"))
    rate = F.lit("0.025").cast("decimal(4,3)")
    for tier, share in COMMISSION.items():
        rate = F.when(F.col("tier") == tier, F.lit(share).cast("decimal(4,3)")).otherwise(rate)
    rows = sums.join(t["employees"].select("employee_id", "employee_name", "tier"), "employee_id")
    return rows.select("employee_id", "employee_name", "fiscal_period", "tier", F.col("sales").cast("double").alias("sales"), (rate * 100).cast("double").alias("rate_pct"), (F.col("sales").cast("decimal(22,2)") * rate).cast("decimal(20,2)").cast("double").alias("commission"))


def customer_churn_risk(t: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Recency and frequency of completed orders of active customers as a score and a band."""
    active = t["customers"].where("is_active")
    done = t["orders"].where("status = 'F'").join(active.select("customer_id"), "customer_id", "left_semi")
    net = net_line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    seen = done.join(t["lines"], "order_id").groupBy("customer_id").agg(F.max("order_date").alias("last_order"), F.countDistinct("order_id").alias("n"), F.sum(net).alias("net"))
    rows = customer_segment_snapshot(t).join(active.select("customer_id"), "customer_id", "left_semi").join(seen, "customer_id", "left")
    days, n = F.datediff(F.to_date(F.lit(as_of)), "last_order"), F.coalesce("n", F.lit(0))
    recency = F.when(days.isNull() | (days > 365), 100).when(days > 180, 70).when(days > 90, 40).otherwise(10)
    frequency = F.when(n == 0, 100).when(n <= 2, 60).when(n <= 5, 30).otherwise(5)
    score = (recency * 6 + frequency * 4).cast("double") / 10
    band = F.when(F.col("churn_score") >= 70, "High").when(F.col("churn_score") >= 40, "Medium").otherwise("Low")
    return rows.select("customer_id", "customer_name", "segment", "region_id", "last_order", days.alias("days_since"), n.cast("bigint").alias("n_orders"), F.coalesce(F.col("net"), F.lit(0)).cast("double").alias("total_net"), F.round(score, 2).alias("churn_score")).withColumn("risk_band", band)


def inventory_replenishment(t: dict[str, DataFrame], as_of: str, days: int = 60) -> DataFrame:
    """What to reorder: demand of the last days carried over the lead time, and the reorder point, less the stock."""
    recent = t["orders"].where(F.col("order_date") >= F.date_sub(F.to_date(F.lit(as_of)), days)).select("order_id")
    demand = t["lines"].join(recent, "order_id", "left_semi").groupBy("product_id").agg(F.sum("quantity").alias("demand"))
    low = t["stock"].where("on_hand <= reorder_point").join(t["products"].select("product_id", "product_name", "lead_days"), "product_id").join(demand, "product_id", "left")
    need = F.ceil(F.coalesce("demand", F.lit(0)) / F.lit(float(days)) * F.col("lead_days")) + F.col("reorder_point") - F.col("on_hand")
    return low.select("product_id", "product_name", "warehouse_id", "on_hand", "reorder_point", F.coalesce("demand", F.lit(0)).cast("bigint").alias("demand"), "lead_days", F.greatest(need, F.lit(0)).cast("bigint").alias("suggested"))


def audit_from_changes(before: DataFrame, after: DataFrame, key: str, table_name: str) -> DataFrame:
    """An audit row for each key of two images that differ: INSERT, DELETE or UPDATE."""
    columns = [c for c in before.columns if c != key]
    old = before.select(F.col(key).alias("_ok"), F.struct(*columns).alias("_old"))
    new = after.select(F.col(key).alias("_nk"), F.struct(*columns).alias("_new"))
    both = old.join(new, F.col("_ok") == F.col("_nk"), "full_outer").where("_ok IS NULL OR _nk IS NULL OR NOT (_old <=> _new)")
    operation = F.when(F.col("_ok").isNull(), "INSERT").when(F.col("_nk").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(F.lit(table_name).alias("table_name"), operation.alias("operation"), F.coalesce("_ok", "_nk").alias("record_id"))


def touch_modified(changes: DataFrame, as_of: str, column: str = "modified") -> DataFrame:
    """Updated rows without a modification time of their own get as_of."""
    return changes.withColumn(column, F.when(F.col("operation") == "UPDATE", F.coalesce(F.col(column), F.to_timestamp(F.lit(as_of)))).otherwise(F.col(column)))


def _moved(lines: DataFrame, t: dict[str, DataFrame], fullest: bool) -> DataFrame:
    places = t["employees"].select(F.col("employee_id").alias("warehouse_id"), "region_id")
    own = lines.groupBy("order_id", "line_no", "product_id").agg(F.sum("quantity").alias("quantity"))
    homes = own.join(t["orders"].select("order_id", "customer_id"), "order_id").join(t["customers"].select("customer_id", "region_id"), "customer_id")
    candidates = homes.select("order_id", "line_no", "product_id", "quantity", "region_id").join(t["stock"].join(places, "warehouse_id"), ["product_id", "region_id"])
    order = [F.desc("on_hand") if fullest else F.asc("on_hand"), F.asc("warehouse_id")]
    first = candidates.withColumn("rn", F.row_number().over(Window.partitionBy("order_id", "line_no", "product_id").orderBy(*order))).where("rn = 1")
    return first.groupBy("product_id", "warehouse_id").agg(F.sum("quantity").alias("moved"))


def decrement_inventory(t: dict[str, DataFrame], new_lines: DataFrame) -> DataFrame:
    """Stock after new lines: the fullest warehouse of the customer's region serves each line, and never falls below 0."""
    taken = _moved(new_lines, t, True)
    return t["stock"].join(taken, ["product_id", "warehouse_id"], "left").withColumn("on_hand", F.greatest(F.col("on_hand") - F.coalesce("moved", F.lit(0)), F.lit(0)).cast("bigint")).drop("moved")


def restock_inventory(t: dict[str, DataFrame], returned: DataFrame) -> DataFrame:
    """Stock after returns: the emptiest warehouse of the customer's region gets each line back."""
    back = _moved(returned, t, False)
    return t["stock"].join(back, ["product_id", "warehouse_id"], "left").withColumn("on_hand", (F.col("on_hand") + F.coalesce("moved", F.lit(0))).cast("bigint")).drop("moved")


def payments_by_order(t: dict[str, DataFrame]) -> DataFrame:
    """Net total of each order that isn't pending."""
    net = net_line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
    return t["lines"].join(t["orders"].where("status <> 'P'").select("order_id"), "order_id", "left_semi").groupBy("order_id").agg(F.sum(net).cast("double").alias("amount"))
