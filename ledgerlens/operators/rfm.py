"""Recency / frequency / monetary metrics, quintile scores and segments."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.functions.dates import floor_days
from ledgerlens.functions.numeric import round_half_up
from ledgerlens.functions.scoring import edge_count_score, edges_tied, rank_quantile_score
from ledgerlens.operators.clean import snapshot_date
from ledgerlens.operators.ordered import global_row_number
from ledgerlens.schema import require_columns

# Segment names of the two rule sets, in rule order.
SEGMENTS = (
    "Champions", "Loyal Customers", "New Customers", "Potential Loyalists",
    "At Risk", "Can't Lose Them", "Hibernating/Lost", "Needs Attention",
)
SEGMENTS_APPENDIX = (
    "Champions", "Loyal Customers", "Potential Loyalists", "New Customers",
    "At Risk", "Can't Lose Them", "Lost Customers", "Other",
)


SPREAD = "AvgOrderValueStdDev"


def order_value_spread() -> Column:
    """Sample deviation of the invoices' sums ``_v`` (one row per invoice)."""
    return F.stddev_samp("_v").alias(SPREAD)


def rfm_metrics(clean: DataFrame, snapshot: DataFrame | _dt.datetime | None = None, spread: bool = False) -> DataFrame:
    """Per customer (A5): Recency = floor days from the last purchase to the
    snapshot, Frequency = distinct invoices, Monetary = sum of TotalPrice;
    customers with Monetary <= 0 are dropped (F4). Two partial aggregates: by
    invoice, then by customer; ``spread`` adds the deviation of the invoices'
    sums from the same groups."""
    require_columns(clean, ["CustomerID", "InvoiceDate", "InvoiceNo", "TotalPrice"], "clean transactions")
    invoices = clean.groupBy("CustomerID", "InvoiceNo").agg(F.max("InvoiceDate").alias("_last"), F.sum("TotalPrice").alias("_v"))
    agg = invoices.groupBy("CustomerID").agg(
        F.max("_last").alias("_last"),
        F.count("InvoiceNo").alias("Frequency"),
        F.sum("_v").alias("Monetary"), *([order_value_spread()] if spread else []))
    if snapshot is None:
        snapshot = snapshot_date(clean)
    if isinstance(snapshot, DataFrame):
        snap_col = snapshot.select("snapshot_date").scalar()  # scalar subquery, no join
    else:
        snap_col = F.lit(snapshot).cast("timestamp_ntz")
    return (agg.select("CustomerID", floor_days(F.col("_last"), snap_col).alias("Recency"),
                       "Frequency", "Monetary", *([SPREAD] if spread else []))
            .filter(F.col("Monetary") > 0))


def _segment_rules(r: Column, f: Column, m: Column, q: int) -> Column:
    high, mid, low = q - 1, q // 2 + 1, 2
    s = SEGMENTS
    return (F.when((r >= high) & (f >= high) & (m >= high), s[0])
            .when((r >= mid) & (f >= mid) & (m >= mid), s[1])
            .when((r >= high) & (f >= 1) & (f <= low), s[2])
            .when((r >= mid) & (r <= high) & (f >= mid) & (f <= high), s[3])
            .when((r >= low) & (r <= mid) & (f >= low) & (m >= low), s[4])
            .when((r <= low) & (f >= high) & (m >= high), s[5])
            .when((r <= low) & (f <= low), s[6])
            .otherwise(s[7]))


def _segment_rules_appendix(r: Column, f: Column, m: Column) -> Column:
    s = SEGMENTS_APPENDIX
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), s[0])
            .when((r >= 2) & (f >= 3) & (m >= 3), s[1])
            .when((r >= 3) & (f <= 3) & (m <= 3), s[2])
            .when((r >= 4) & (f == 1), s[3])
            .when((r >= 2) & (r <= 3) & (f >= 2) & (m >= 2), s[4])
            .when((r == 1) & (f >= 4) & (m >= 4), s[5])
            .when((r == 1) & (f <= 2) & (m <= 2), s[6])
            .otherwise(s[7]))


def segment_of(r: Column, f: Column, m: Column, q: int = 5, rules: str = "code") -> Column:
    return _segment_rules_appendix(r, f, m) if rules == "appendix" else _segment_rules(r, f, m, q)


def rfm_scores(rfm: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """R, F, M scores 1..q (W2-W4) and the RFM_Score string.

    R: Recency against its exact q-quantiles (right-closed bins, reversed
    labels); the edges come from one aggregate used as a scalar subquery. F and M: quantile cut of the rank with ties broken by
    CustomerID, from a distributed global row number. Monetary is ranked after
    rounding to 6 decimals so float noise from summation order cannot reorder
    equal amounts.
    """
    q = cfg.rfm_quantiles
    ranked = global_row_number(rfm, [F.col("Frequency"), F.col("CustomerID")], "_rf",
                               n=cfg.order_partitions, total_name="_n")
    ranked = global_row_number(ranked, [round_half_up("Monetary", 6), F.col("CustomerID")], "_rm",
                               n=cfg.order_partitions)
    levels = F.array(*[F.lit(j / q) for j in range(1, q)])
    stats = ranked.agg(F.struct(
        F.percentile(F.col("Recency").cast("double"), levels).alias("edges"),
        F.min("Recency").alias("lo"), F.max("Recency").alias("hi")).alias("s")).scalar()
    r_score = edge_count_score(F.col("Recency"), stats["edges"], q)
    if cfg.recency_ties == "error":
        tied = edges_tied(stats["edges"], stats["lo"], stats["hi"], q)
        r_score = F.when(tied, F.raise_error(F.lit("Recency quantile edges are not unique"))
                         .cast("int")).otherwise(r_score)
    j = ranked
    scored = j.select(
        "CustomerID", "Recency", "Frequency", "Monetary",
        r_score.alias("R_Score"),
        rank_quantile_score(F.col("_rf"), F.col("_n"), q).alias("F_Score"),
        rank_quantile_score(F.col("_rm"), F.col("_n"), q).alias("M_Score"))
    return scored.withColumn("RFM_Score", F.concat(
        F.col("R_Score").cast("string"), F.col("F_Score").cast("string"), F.col("M_Score").cast("string")))


def rfm_segments(clean: DataFrame, snapshot=None, cfg: Config = DEFAULT, rules: str = "code") -> DataFrame:
    """``calculate_rfm`` (G1; ``rules="appendix"`` for G2): metrics, scores,
    segment by the first matching rule."""
    scored = rfm_scores(rfm_metrics(clean, snapshot), cfg)
    return scored.withColumn("Segment", segment_of(
        F.col("R_Score"), F.col("F_Score"), F.col("M_Score"), cfg.rfm_quantiles, rules))

