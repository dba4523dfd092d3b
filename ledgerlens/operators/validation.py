"""Model checks the reference describes: calibration/holdout comparison of
predicted and actual purchases (M8) and the distribution of days between
purchase days (M10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, BGNBDParams, Config
from ledgerlens.functions.dates import plus_days
from ledgerlens.operators.bgnbd import bgnbd_fit, expected_purchases
from ledgerlens.operators.ordered import lag_within
from ledgerlens.operators.summary import purchase_summary
from ledgerlens.session import cut_lineage


def calibration_holdout(clean: DataFrame, bg: BGNBDParams | None = None, holdout_days: int = 90,
                        cfg: Config = DEFAULT) -> DataFrame:
    """Summary on lines up to the day ``holdout_days`` before the last; the
    model is fitted on it unless parameters are given; expected
    repeat purchase days over the holdout vs the purchase days observed in
    it; MAE, MSE and correlation over the calibration customers."""
    last = clean.agg(F.max("InvoiceDate")).scalar()
    cal_end = plus_days(last, -holdout_days)
    cal_end_day = F.to_date(cal_end)
    end_day = F.to_date(last)
    summ = purchase_summary(clean, observation_end=cal_end)
    if bg is None:
        summ = cut_lineage(summ)
        bg = bgnbd_fit(summ, cfg)
    actual = (clean.filter(F.to_date("InvoiceDate") > cal_end_day)
              .groupBy("CustomerID").agg(F.count_distinct(F.to_date("InvoiceDate")).alias("actual")))
    h = F.datediff(end_day, cal_end_day).cast("double")
    pred = summ.select("CustomerID", expected_purchases(h, F.col("frequency"), F.col("recency"), F.col("T"), bg)
                       .alias("predicted"))
    j = pred.join(actual, "CustomerID", "left").fillna({"actual": 0})
    e = F.col("predicted") - F.col("actual")
    return j.agg(F.count(F.lit(1)).alias("customers"), F.sum("actual").alias("actual_total"),
                 F.sum("predicted").alias("predicted_total"), F.avg(F.abs(e)).alias("mae"),
                 F.avg(e * e).alias("mse"), F.corr("predicted", F.col("actual").cast("double")).alias("correlation"))


def purchase_probabilities(age: Column, p: BGNBDParams, n: int) -> Column:
    """P(0), ..., P(n - 1) repeat purchases in ``age`` periods under BG/NBD, as
    an array: each count's terms follow from the one before (the purchase rate
    while active, and the chance to have left just then)."""
    r, alpha, a, b = (F.lit(float(v)) for v in (p.r, p.alpha, p.a, p.b))
    stay, z = alpha / (alpha + age), age / (alpha + age)
    start = F.struct(F.pow(stay, r).alias("rate"), F.lit(0.0).alias("below"), F.lit(1.0).alias("active"), F.lit(0.0).alias("left"),
                     F.array().cast("array<double>").alias("probs"))

    def step(s, i):
        prob = s["active"] * s["rate"] + s["left"] * (1 - s["below"])
        return F.struct((s["rate"] * (r + i) / (i + 1) * z).alias("rate"), (s["below"] + s["rate"]).alias("below"),
                        (s["active"] * (b + i) / (a + b + i)).alias("active"),
                        F.when(i == 0, a / (a + b)).otherwise(s["left"] * (b + i - 1) / (a + b + i)).alias("left"),
                        F.concat(s["probs"], F.array(prob)).alias("probs"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step, lambda s: s["probs"])


def purchase_count_check(summary: DataFrame, p: BGNBDParams, most: int = 12) -> DataFrame:
    """(purchases, is_tail, observed, expected): customers by their number of
    repeat purchases, against the model's expectation over the customers' ages
    (M10); the last row has all counts from ``most`` on. Customers meet by age
    first, so the recursion runs once per distinct age."""
    ages = summary.groupBy("T").agg(F.count(F.lit(1)).alias("n")).withColumn("probs", purchase_probabilities(F.col("T"), p, most))
    rest = 1 - F.aggregate("probs", F.lit(0.0), lambda x, y: x + y)
    expected = ages.select("n", F.posexplode(F.concat("probs", F.array(rest))).alias("purchases", "prob")).groupBy("purchases").agg(
        F.sum(F.col("n") * F.col("prob")).alias("expected"))
    observed = summary.groupBy(F.least(F.col("frequency"), F.lit(float(most))).cast("int").alias("purchases")).agg(
        F.count(F.lit(1)).alias("observed"))
    return expected.join(observed, "purchases", "left").select(
        "purchases", (F.col("purchases") == most).alias("is_tail"), F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), "expected")


def interpurchase_distribution(clean: DataFrame, bin_days: int = 30, n: int | None = None) -> DataFrame:
    """Days between consecutive purchase days of a customer, counted in
    ``bin_days`` bins, with the share of all gaps."""
    days = clean.groupBy("CustomerID", F.to_date("InvoiceDate").alias("day")).agg(F.count(F.lit(1)).alias("_n"))
    lagged = lag_within(days.select("CustomerID", "day"), "CustomerID", "day", "_prev", n=n)
    gaps = lagged.filter(F.col("_prev").isNotNull()).select(F.datediff("day", "_prev").alias("gap"))
    b = gaps.groupBy((F.floor(F.col("gap") / bin_days) * bin_days).cast("int").alias("gap_from")).agg(
        F.count(F.lit(1)).alias("gaps"), F.avg("gap").alias("mean_gap"))
    tot = F.sum("gaps").over(Window.partitionBy())  # over the bins
    return b.select("gap_from", (F.col("gap_from") + bin_days - 1).alias("gap_to"), "gaps", "mean_gap",
                    (F.col("gaps") / tot * 100).alias("share_pct"))
