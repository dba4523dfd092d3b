"""Per-customer driver metrics: days to the second purchase and distinct
products bought.

The second purchase is the second line in date order (a multi-line first
invoice gives 0 days), taken with ``row_number() <= 2`` per customer. Spark
plans that filter as a ``WindowGroupLimit`` on both sides of the exchange, so
at most two rows per customer and map task cross the shuffle, however many
lines one customer has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.dates import floor_days
from ledgerlens.operators.visits import LINES, products
from ledgerlens.schema import require_columns


def second_purchase(clean: DataFrame, grain: str = "line") -> DataFrame:
    """CustomerID, first_purchase, second_purchase (null when only one).
    ``grain="invoice"`` counts each invoice once (its earliest line)."""
    require_columns(clean, ["CustomerID", "InvoiceDate"], "clean transactions")
    rows = clean.select("CustomerID", "InvoiceDate")
    if LINES in clean.columns:  # visits: the first two of a visit's lines can matter
        rows = clean.select("CustomerID", "InvoiceDate", F.explode(F.sequence(
            F.lit(1).cast("bigint"), F.least(F.col(LINES), F.lit(2).cast("bigint")))).alias("_l")).drop("_l")
    if grain == "invoice":
        rows = clean.groupBy("CustomerID", "InvoiceNo").agg(F.min("InvoiceDate").alias("InvoiceDate"))
    w = Window.partitionBy("CustomerID").orderBy("InvoiceDate")
    top2 = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    return top2.groupBy("CustomerID").agg(
        F.min("InvoiceDate").alias("first_purchase"),
        F.max(F.when(F.col("_rn") == 2, F.col("InvoiceDate"))).alias("second_purchase"))


def driver_metrics(clean: DataFrame, grain: str = "line", seen: DataFrame | None = None) -> DataFrame:
    """CustomerID, time_to_second_purchase (floor days, -1 when none),
    category_count (distinct StockCode, 0 when the column is absent).
    ``seen``: visits of the same lines, to take the purchase times from."""
    pair = second_purchase(clean if seen is None else seen, grain)
    days = floor_days(F.col("first_purchase"), F.col("second_purchase")).cast("double")
    out = pair.select("CustomerID", F.coalesce(days, F.lit(-1.0)).alias("time_to_second_purchase"))
    if "StockCode" in clean.columns:
        out = out.join(products(clean), "CustomerID", "left")
        return out.withColumn("category_count", F.coalesce(F.col("category_count"), F.lit(0)).cast("bigint"))
    return out.withColumn("category_count", F.lit(0).cast("bigint"))
