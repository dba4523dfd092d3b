"""Engineered customer features for the boosted-tree predictor (L1).

Time between purchases needs each purchase time's predecessor; that lag runs
over distinct (customer, timestamp) rows and is distributed (``lag_within``:
range partitions on (customer, timestamp), so a customer with a third of all
lines is split across tasks). The same rows carry the quantities, so all but
the invoice sums is one partial aggregate per customer over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.functions.dates import floor_days, plus_days
from ledgerlens.operators.ordered import lag_within, quantile_values
from ledgerlens.operators.rfm import order_value_spread
from ledgerlens.operators.visits import line_count, products
from ledgerlens.session import cut_lineage

ENGINEERED = ["MeanTimeBetweenPurchases", "StdTimeBetweenPurchases", "AvgOrderQuantity", "TotalQuantity",
              "UniqueProducts"]
EXTRA = ["PurchaseCountLast3Months", "AvgOrderValueStdDev", "CategoryDiversityIndex"]
IMPUTED = ["PurchaseCountLast3Months", "AvgOrderValueStdDev"]


LINE_BLOCK = 10_000


def purchase_gaps(clean: DataFrame, cfg: Config = DEFAULT, *also: Column) -> DataFrame:
    """One row per (customer, timestamp) with its line count ``c``, further
    aggregates ``also`` and the floor days since the customer's previous
    distinct timestamp (null for the first). Copies at one timestamp are
    combined map-side first, so the distributed lag runs over distinct
    purchase times, not lines."""
    ts = clean.groupBy("CustomerID", "InvoiceDate").agg(F.sum(line_count(clean)).cast("bigint").alias("c"), *also)
    lagged = lag_within(ts, "CustomerID", "InvoiceDate", "_prev", n=cfg.order_partitions)
    return lagged.withColumn("gap", floor_days(F.col("_prev"), F.col("InvoiceDate")).cast("double")).drop("_prev")


def time_between(clean: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per line: TimeDiff = floor days since the customer's previous line in
    date order, 0 for the first (W5). Of the c lines at one timestamp the
    first carries the gap and the others 0; the lines are regenerated from
    the counts by two generators: blocks of at most 10,000 lines, which are
    spread before each is filled, so a timestamp with any number of lines
    needs neither a long array nor one task."""
    g = purchase_gaps(clean, cfg)
    blocks = (g.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(c - 1) div {LINE_BLOCK}"))))
              .repartition("CustomerID", "InvoiceDate", "_b"))
    size = F.least(F.col("c") - F.col("_b") * LINE_BLOCK, F.lit(LINE_BLOCK))
    lines = blocks.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).withColumn(
        "_i", F.col("_b") * LINE_BLOCK + F.col("_k"))
    return lines.select("CustomerID", "InvoiceDate",
                        F.when(F.col("_i") == 1, F.coalesce(F.col("gap"), F.lit(0.0))).otherwise(F.lit(0.0))
                        .alias("TimeDiff"))


def _gap_sums() -> list[Column]:
    """Of the rows of ``purchase_gaps``: n = lines, s1 = sum gap, s2 = sum gap^2."""
    return [F.sum("c").alias("_n"), F.sum(F.coalesce("gap", F.lit(0.0))).alias("_s1"),
            F.sum(F.coalesce(F.col("gap") * F.col("gap"), F.lit(0.0))).alias("_s2")]


def _gap_stats() -> list[Column]:
    """Mean and sample std of TimeDiff over lines (std 0 for a single line)."""
    n, s1, s2 = F.col("_n").cast("double"), F.col("_s1"), F.col("_s2")
    var = F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0))
    return [(s1 / n).alias("MeanTimeBetweenPurchases"),
            F.when(n > 1, F.sqrt(var)).otherwise(F.lit(0.0)).alias("StdTimeBetweenPurchases")]


def time_between_stats(clean: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per customer: mean and sample std of TimeDiff over lines, from the gap sums."""
    return purchase_gaps(clean, cfg).groupBy("CustomerID").agg(*_gap_sums()).select("CustomerID", *_gap_stats())


def ml_features(rfm: DataFrame, clean: DataFrame, cfg: Config = DEFAULT, fill: str = "median",
                products_of: DataFrame | None = None, spread_of: DataFrame | None = None) -> DataFrame:
    """``clean``: the lines, or their visits with ``products_of`` (CustomerID,
    category_count) and ``spread_of`` (CustomerID, AvgOrderValueStdDev) from the customer base. RFM table plus engineered features; nulls of the imputed features take
    the column median (``fill="zero"``: 0). Numeric columns come out double,
    as after the reference's imputer."""
    if products_of is None and "StockCode" in clean.columns:
        products_of = products(clean)
    has_stock = products_of is not None
    max_date = clean.agg(F.max("InvoiceDate")).scalar()
    # distinct products and recent times are counted from grouped rows, so no
    # line is multiplied for a second distinct count
    times = purchase_gaps(clean, cfg, F.sum("Quantity").alias("_q"))
    per = times.groupBy("CustomerID").agg(
        (F.sum("_q") / F.sum("c")).alias("AvgOrderQuantity"), F.sum("_q").alias("TotalQuantity"),
        F.min("InvoiceDate").alias("FirstPurchase"), F.max("InvoiceDate").alias("LastPurchase"),
        *_gap_sums(),
        F.count_if(F.col("InvoiceDate") >= plus_days(max_date, -cfg.recent_days)).alias("_recent"))
    if has_stock:
        per = per.join(products_of.select("CustomerID", F.col("category_count").alias("UniqueProducts")), "CustomerID")
    else:
        per = per.withColumn("UniqueProducts", F.lit(0).cast("bigint"))
    per = per.select("*", *_gap_stats()).select(
        "CustomerID", *ENGINEERED, "FirstPurchase", "LastPurchase",
        floor_days(F.col("FirstPurchase"), max_date).alias("DaysSinceFirstPurchase"),
        floor_days(F.col("FirstPurchase"), F.col("LastPurchase")).alias("CustomerTenure"),
        F.when(F.col("_recent") > 0, F.col("_recent")).alias("PurchaseCountLast3Months"),
        (F.least(F.col("UniqueProducts") / F.col("_n"), F.lit(1.0)) if has_stock else F.lit(None))
        .alias("CategoryDiversityIndex"))
    if spread_of is None:
        inv = clean.groupBy("CustomerID", "InvoiceNo").agg(F.sum("TotalPrice").alias("_v"))
        spread_of = inv.groupBy("CustomerID").agg(order_value_spread())
    # materialised once: the median run reads it instead of
    # repeating the feature plan
    feats = cut_lineage(rfm.join(per, "CustomerID", "left").join(spread_of, "CustomerID", "left"))
    if fill == "median":
        for c, (median,) in quantile_values(feats, IMPUTED, [0.5]).items():
            feats = feats.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(median).cast("double")))
    else:
        feats = feats.fillna({c: 0.0 for c in IMPUTED})
    numeric = [f.name for f in feats.schema.fields
               if f.dataType.simpleString() in ("int", "bigint", "double", "float")]
    return feats.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in feats.columns])
