"""Repeat-purchase summary per customer, in day periods.

frequency       purchase days - 1 (repeat days)
recency         days from the first to the last purchase day
T               days from the first purchase day to the end of observation
monetary_value  mean spend per repeat day (first day excluded), 0 if none

Two partial aggregates: (customer, day) totals, then per customer. A hot
customer is collapsed map-side at both levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.schema import require_columns


def purchase_summary(clean: DataFrame, observation_end=None) -> DataFrame:
    require_columns(clean, ["CustomerID", "InvoiceDate", "TotalPrice"], "clean transactions")
    if observation_end is None:
        end_day = clean.agg(F.to_date(F.max("InvoiceDate"))).scalar()
        rows = clean
    else:
        end = observation_end if isinstance(observation_end, Column) else F.lit(observation_end).cast("timestamp_ntz")
        end_day = F.to_date(end)
        rows = clean.filter(F.to_date("InvoiceDate") <= end_day)  # whole days, as the holdout counts them
    daily = rows.groupBy("CustomerID", F.to_date("InvoiceDate").alias("_d")).agg(
        F.sum("TotalPrice").alias("_v"))
    per = daily.groupBy("CustomerID").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_first"), F.max("_d").alias("_last"),
        F.sum("_v").alias("_sum"), F.min_by("_v", "_d").alias("_v1"))
    repeat = F.col("_n") - 1
    return per.select(
        "CustomerID",
        repeat.cast("double").alias("frequency"),
        F.datediff("_last", "_first").cast("double").alias("recency"),
        F.datediff(end_day, F.col("_first")).cast("double").alias("T"),
        F.when(repeat > 0, (F.col("_sum") - F.col("_v1")) / repeat).otherwise(F.lit(0.0)).alias("monetary_value"))


def bgnbd_input(summary: DataFrame, fit_all: bool = False) -> DataFrame:
    """Rows the BG/NBD fit uses (F5): repeat customers, or all."""
    return summary if fit_all else summary.filter(F.col("frequency") > 0)


def gg_input(summary: DataFrame) -> DataFrame:
    """Rows the Gamma-Gamma fit uses."""
    return summary.filter((F.col("frequency") > 0) & (F.col("monetary_value") > 0))


def freq_monetary_corr(summary: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pearson correlation of frequency and monetary value on the
    Gamma-Gamma rows, with the assumption flag (A27); the fit goes on."""
    g = gg_input(summary)
    c = g.agg(F.count(F.lit(1)).alias("n"), F.corr("frequency", "monetary_value").alias("correlation"))
    return c.select("n", "correlation",
                    (F.abs(F.col("correlation")) > cfg.gg_corr_threshold).alias("exceeds_threshold"))
