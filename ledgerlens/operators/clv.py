"""Discounted customer lifetime value and the combined customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, BGNBDParams, Config, GammaGammaParams
from ledgerlens.operators.bgnbd import expected_purchases_many, prob_alive
from ledgerlens.operators.gammagamma import expected_average_value


def _with_expected(df: DataFrame, x, t, T, bg: BGNBDParams, periods, prefix: str) -> DataFrame:
    """One column per horizon; all series come from one UDF call."""
    return expected_purchases_many(df, [h for _, h in periods], x, t, T, bg, [f"{prefix}{i}" for i, _ in periods])


def _discounted(value, prefix: str, months: int, discount: float):
    """sum_{i=1..months} value * (X_i - X_{i-1}) / (1+d)^i with X_0 = 0."""
    total = F.lit(0.0)
    for i in range(1, months + 1):
        prev = F.col(f"{prefix}{i - 1}") if i > 1 else F.lit(0.0)
        total = total + value * (F.col(f"{prefix}{i}") - prev) / float((1.0 + discount) ** i)
    return total


def predict_clv(summary: DataFrame, bg: BGNBDParams, gg: GammaGammaParams | None,
                cfg: Config = DEFAULT, months: int | None = None, discount: float | None = None) -> DataFrame:
    """Adds ``predicted_clv`` (M4): sum over months i of E[M] times the
    expected purchases in month i (30-day months, day-unit summary),
    discounted monthly; clipped at 0, null (no spend) -> 0; all 0 without a
    spend model. The series behind it raises rather than return NaN."""
    months = cfg.clv_months if months is None else months
    discount = cfg.monthly_discount if discount is None else discount
    if gg is None:
        return summary.withColumn("predicted_clv", F.lit(0.0))
    x, t, T, m = F.col("frequency"), F.col("recency"), F.col("T"), F.col("monetary_value")
    period = float(cfg.days_per_month)
    df = _with_expected(summary, x, t, T, bg, [(i, i * period) for i in range(1, months + 1)], "_ex")
    clv = _discounted(expected_average_value(x, m, gg), "_ex", months, discount)
    if cfg.zero_freq_clv not in ("population", "zero"):
        raise ValueError(f"unknown zero_freq_clv {cfg.zero_freq_clv!r}")
    if cfg.zero_freq_clv == "zero":
        clv = F.when(x > 0, clv)
    clv = F.coalesce(clv, F.lit(0.0))
    return df.withColumn("predicted_clv", F.greatest(clv, F.lit(0.0))) \
        .drop(*[f"_ex{i}" for i in range(1, months + 1)])


def clv_scores(summary: DataFrame, bg: BGNBDParams | None, gg: GammaGammaParams | None,
               cfg: Config = DEFAULT) -> DataFrame:
    """CustomerID, predicted_clv, prob_alive, avg_transaction_value; zeros
    when either model is missing (P8)."""
    if bg is None or gg is None:
        return summary.select("CustomerID", F.lit(0.0).alias("predicted_clv"),
                              F.lit(0.0).alias("prob_alive"), F.lit(0.0).alias("avg_transaction_value"))
    scored = predict_clv(summary, bg, gg, cfg)
    return scored.select(
        "CustomerID", "predicted_clv",
        prob_alive(F.col("frequency"), F.col("recency"), F.col("T"), bg).alias("prob_alive"),
        F.col("monetary_value").alias("avg_transaction_value"))


def customer_table(rfm: DataFrame, clv: DataFrame, drivers: DataFrame,
                   snapshot: DataFrame | None = None) -> DataFrame:
    """RFM left-joined with the CLV columns and the driver metrics (J3, J4),
    missing values filled: 0.0 / 0.0 / 0.0 / -1 / 0."""
    out = (rfm.join(clv, "CustomerID", "left").join(drivers, "CustomerID", "left")
           .fillna({"predicted_clv": 0.0, "prob_alive": 0.0, "avg_transaction_value": 0.0,
                    "time_to_second_purchase": -1.0})
           .withColumn("category_count", F.coalesce(F.col("category_count"), F.lit(0)).cast("bigint")))
    if snapshot is not None:
        out = out.withColumn("snapshot_date", snapshot.select("snapshot_date").scalar())
    return out


def clv_horizons(summary: DataFrame, segments: DataFrame, bg: BGNBDParams, gg: GammaGammaParams,
                 cfg: Config = DEFAULT) -> DataFrame:
    """Appendix variant (M5-M7, J7) in month units (recency/30, T/30, alpha
    rescaled to months): expected purchases at 3/6/12 months, P(alive),
    expected spend, and CLV at each horizon times the margin at a 10 % yearly
    rate; inner joined with the segment."""
    unit = float(cfg.days_per_month)
    x, t, T, m = F.col("frequency"), F.col("recency") / unit, F.col("T") / unit, F.col("monetary_value")
    bgm = BGNBDParams(bg.r, bg.alpha / unit, bg.a, bg.b)
    top = max(cfg.appendix_horizons)
    df = _with_expected(summary, x, t, T, bgm, [(i, float(i)) for i in range(1, top + 1)], "_mx")
    value = expected_average_value(x, m, gg)
    cols = [F.col("CustomerID"), prob_alive(x, t, T, bgm).alias("prob_alive"), value.alias("predicted_avg_value")]
    for h in cfg.appendix_horizons:
        cols.append(F.col(f"_mx{h}").alias(f"predicted_purch_{h}m"))
        cols.append((_discounted(value, "_mx", h, cfg.appendix_discount) * cfg.appendix_margin)
                    .alias(f"CLV_{h}months"))
    out = df.select(*cols)
    return out.join(segments.select("CustomerID", "Segment"), "CustomerID", "inner")
