"""Aggregated views over the customer table (one row per customer).

Every view is a grouped aggregate with map-side partial aggregation, so a
segment holding most customers never lands whole in one task. Shares over a
total use a window over the already aggregated rows (one per segment) or a
scalar subquery; quantiles come from ``exact_quantiles`` (distributed ranks),
never from gathering a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.functions.binning import bin_label, bin_order
from ledgerlens.functions.numeric import safe_ratio
from ledgerlens.operators.ordered import few, global_cumsum, global_row_number, quantile_columns, quantile_values
from ledgerlens.schema import require_columns


def _share(col: str, name: str) -> Column:
    total = F.sum(col).over(Window.partitionBy())  # over the few aggregated rows
    return F.when(total > 0, F.col(col) / total * 100).otherwise(F.lit(0.0)).alias(name)


def segment_distribution(customers: DataFrame) -> DataFrame:
    """Customers per segment and percent of all customers."""
    require_columns(customers, ["Segment"], "customer table")
    counts = customers.groupBy("Segment").agg(F.count(F.lit(1)).alias("Count"))
    return counts.select("Segment", "Count", _share("Count", "Percent"))


def segment_rfm_means(customers: DataFrame) -> DataFrame:
    """Mean Recency, Frequency, Monetary per segment."""
    return customers.groupBy("Segment").agg(
        F.avg("Recency").alias("Recency"), F.avg("Frequency").alias("Frequency"),
        F.avg("Monetary").alias("Monetary"))


def segment_clv_mean(customers: DataFrame) -> DataFrame:
    """Mean predicted CLV per segment."""
    return customers.groupBy("Segment").agg(F.avg("predicted_clv").alias("predicted_clv"))


def segment_clv_sum(customers: DataFrame) -> DataFrame:
    """Sum of predicted CLV per segment plus the grand total (A10): the
    rollup row has Segment = null and is_total = true."""
    r = customers.rollup("Segment").agg(F.sum("predicted_clv").alias("predicted_clv"),
                                        F.grouping("Segment").alias("_g"))
    return r.select("Segment", "predicted_clv", (F.col("_g") == 1).alias("is_total"))


def segment_value_share(customers: DataFrame, value: str = "predicted_clv") -> DataFrame:
    """CLV sum per segment and percent of the total, 0 when the total is not
    positive (A11, X7)."""
    sums = customers.groupBy("Segment").agg(F.sum(value).alias("predicted_clv"))
    return sums.select("Segment", "predicted_clv", _share("predicted_clv", "percent"))


def kpis(customers: DataFrame) -> DataFrame:
    """Total CLV, mean CLV where positive, customers (one row each), mean P(alive)
    where positive; 0 when there is none (A12, F9, F10)."""
    pos_clv = F.when(F.col("predicted_clv") > 0, F.col("predicted_clv"))
    pos_p = F.when(F.col("prob_alive") > 0, F.col("prob_alive"))
    return customers.agg(
        F.coalesce(F.sum("predicted_clv"), F.lit(0.0)).alias("total_clv"),
        F.coalesce(F.avg(pos_clv), F.lit(0.0)).alias("avg_clv_positive"),
        F.count("CustomerID").alias("customers"),
        F.coalesce(F.avg(pos_p), F.lit(0.0)).alias("avg_prob_alive_positive"))


def top_segment(customers: DataFrame) -> DataFrame:
    """Segment with the largest CLV sum and its percent of the total (A13,
    O3); ties go to the alphabetically first segment. A top-1 over the
    per-segment sums."""
    sums = customers.groupBy("Segment").agg(F.sum("predicted_clv").alias("_s"))
    total = sums.agg(F.sum("_s")).scalar()
    best = sums.orderBy(F.col("_s").desc(), F.col("Segment").asc()).limit(1)
    return best.select(F.col("Segment").alias("top_segment"), F.col("_s").alias("top_segment_clv"),
                       F.when(total > 0, F.col("_s") / total * 100).otherwise(F.lit(0.0)).alias("top_segment_pct"))


def at_risk_value(customers: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """At Risk CLV sum, percent of total, mean, and the value recovered at
    the recovery rate (A14)."""
    risk = F.col("Segment") == "At Risk"
    a = customers.agg(
        F.coalesce(F.sum(F.when(risk, F.col("predicted_clv"))), F.lit(0.0)).alias("at_risk_clv"),
        F.coalesce(F.sum("predicted_clv"), F.lit(0.0)).alias("_total"),
        F.count_if(risk).alias("at_risk_customers"))
    return a.select(
        "at_risk_clv",
        safe_ratio(F.col("at_risk_clv") * 100, F.col("_total")).alias("at_risk_pct"),
        "at_risk_customers",
        safe_ratio(F.col("at_risk_clv"), F.col("at_risk_customers").cast("double")).alias("avg_at_risk_clv"),
        (F.col("at_risk_clv") * cfg.recovery_rate).alias("recovery_value"))


def driver_effects(customers: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Mean CLV of early (0..cutoff days) vs late second purchasers and the
    lift; mean CLV with >= threshold categories vs fewer and the lift (A15)."""
    cutoff = cfg.second_purchase_bins[1] if len(cfg.second_purchase_bins) > 1 else 30
    t2 = F.col("time_to_second_purchase")
    early = (t2 <= cutoff) & (t2 >= 0)
    late = t2 > cutoff
    diverse = F.col("category_count") >= cfg.diversity_threshold
    limited = F.col("category_count") < cfg.diversity_threshold
    clv = F.col("predicted_clv")
    a = customers.agg(
        F.coalesce(F.avg(F.when(early, clv)), F.lit(0.0)).alias("early_avg_clv"),
        F.coalesce(F.avg(F.when(late, clv)), F.lit(0.0)).alias("late_avg_clv"),
        F.coalesce(F.avg(F.when(diverse, clv)), F.lit(0.0)).alias("diverse_avg_clv"),
        F.coalesce(F.avg(F.when(limited, clv)), F.lit(0.0)).alias("limited_avg_clv"))
    return a.select(
        "early_avg_clv", "late_avg_clv",
        safe_ratio((F.col("early_avg_clv") - F.col("late_avg_clv")) * 100, F.col("late_avg_clv"))
        .alias("early_impact_pct"),
        "diverse_avg_clv", "limited_avg_clv",
        safe_ratio((F.col("diverse_avg_clv") - F.col("limited_avg_clv")) * 100, F.col("limited_avg_clv"))
        .alias("diversity_impact_pct"))


def second_purchase_rate(customers: DataFrame) -> DataFrame:
    """repeat / (new + repeat) * 100 with repeat = Frequency > 1 and new = the
    New Customers segment; the sets overlap, as in the reference (A16)."""
    a = customers.agg(F.count_if(F.col("Segment") == "New Customers").alias("new_customers"),
                      F.count_if(F.col("Frequency") > 1).alias("repeat_customers"))
    both = F.col("new_customers") + F.col("repeat_customers")
    return a.select("new_customers", "repeat_customers",
                    safe_ratio(F.col("repeat_customers") * 100.0, both).alias("second_purchase_rate"))


def segment_profile(customers: DataFrame) -> DataFrame:
    """Mean scores, CLV and P(alive) per segment; CLV_Score = 1 + 4 clv/max
    (1 when max <= 0) and Active_Score = 1 + 4 p (A17)."""
    means = customers.groupBy("Segment").agg(
        F.avg("R_Score").alias("R_Score"), F.avg("F_Score").alias("F_Score"), F.avg("M_Score").alias("M_Score"),
        F.avg("predicted_clv").alias("predicted_clv"), F.avg("prob_alive").alias("prob_alive"))
    mx = F.max("predicted_clv").over(Window.partitionBy())  # over the segment rows
    return means.select(
        "*", F.when(mx > 0, 1 + 4 * (F.col("predicted_clv") / mx)).otherwise(F.lit(1.0)).alias("CLV_Score"),
        (1 + 4 * F.col("prob_alive")).alias("Active_Score"))


def segment_prob_active(customers: DataFrame) -> DataFrame:
    """Mean P(alive) per segment."""
    return customers.groupBy("Segment").agg(F.avg("prob_alive").alias("prob_alive"))


def positive_clv(customers: DataFrame) -> DataFrame:
    """Customers with positive predicted CLV."""
    return customers.filter(F.col("predicted_clv") > 0)


def clv_histogram(customers: DataFrame, bins: int = 50) -> DataFrame:
    """Counts of positive CLV in ``bins`` equal-width bins between min and
    max, per segment (A19); the last bin is closed."""
    pos = positive_clv(customers)
    rng = pos.agg(F.struct(F.min("predicted_clv").alias("lo"), F.max("predicted_clv").alias("hi"))).scalar()
    width = (rng["hi"] - rng["lo"]) / bins
    idx = F.when(width > 0, F.least(F.floor((F.col("predicted_clv") - rng["lo"]) / width), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    h = pos.groupBy(idx.alias("bin"), "Segment").agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", "Segment", "count",
                    (rng["lo"] + F.col("bin") * width).alias("bin_start"),
                    (rng["lo"] + (F.col("bin") + 1) * width).alias("bin_end"))


def clv_histogram_rounded(customers: DataFrame, target: int = 50) -> DataFrame:
    """Counts of positive CLV per segment in bins of a round width (A19): 1, 2
    or 5 times a power of ten, the least that needs at most ``target`` bins for
    the range; bins start at multiples of the width, which may add one. One
    value makes bins of width one."""
    pos = positive_clv(customers)
    rng = pos.agg(F.struct(F.min("predicted_clv").alias("lo"), F.max("predicted_clv").alias("hi"))).scalar()
    raw = (rng["hi"] - rng["lo"]) / target
    tens = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    width = F.when(raw <= 0, 1.0).when(raw <= tens, tens).when(raw <= 2 * tens, 2 * tens).when(raw <= 5 * tens, 5 * tens).otherwise(10 * tens)
    binned = pos.select("Segment", "predicted_clv", width.alias("width"))
    h = binned.groupBy(F.floor(F.col("predicted_clv") / F.col("width")).alias("bin"), "width", "Segment").agg(F.count(F.lit(1)).alias("count"))
    return h.select((F.col("bin") * F.col("width")).alias("bin_start"), ((F.col("bin") + 1) * F.col("width")).alias("bin_end"), "Segment", "count")


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Box-plot statistics per group: quartiles (linear), Tukey fences,
    whiskers (extreme values inside the fences), outlier count (A20, A21)."""
    q = quantile_columns(df, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"], group)
    q = q.withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = df.select(group, F.col(value).alias("_x")).join(few(q), group, "inner")
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    return j.groupBy(group, "q1", "median", "q3", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def segment_clv_box(customers: DataFrame) -> DataFrame:
    """Box statistics of positive CLV per segment."""
    return box_stats(positive_clv(customers), "predicted_clv", "Segment")


def driver_bins(customers: DataFrame, driver: str, cfg: Config = DEFAULT, binned: bool = True) -> DataFrame:
    """Positive-CLV customers with the driver binned (B1, B2): left-closed
    bins with an open last bin; for time_to_second_purchase, -1 is
    ``First Purchase Only``. ``binned=False``: the raw value as text, in its
    own order (B3)."""
    pos = positive_clv(customers)
    x = F.col(driver)
    if not binned:
        return pos.select("CustomerID", driver, "predicted_clv", x.cast("string").alias(f"{driver}_binned"),
                          x.alias("bin_order"))
    if driver == "time_to_second_purchase":
        edges = list(cfg.second_purchase_bins)
        label = F.when(x == -1, F.lit("First Purchase Only")).otherwise(bin_label(x, edges, "days"))
        order = F.when(x == -1, F.lit(len(edges))).otherwise(bin_order(x, edges))
    else:
        edges = list(cfg.category_bins)
        label, order = bin_label(x, edges), bin_order(x, edges)
    return pos.select("CustomerID", driver, "predicted_clv",
                      label.alias(f"{driver}_binned"), order.alias("bin_order"))


def driver_clv_box(customers: DataFrame, driver: str, cfg: Config = DEFAULT, binned: bool = True) -> DataFrame:
    """Box statistics of positive CLV per driver bin (A21, B4), or per raw
    value of the driver (B3)."""
    b = driver_bins(customers, driver, cfg, binned)
    return box_stats(b, "predicted_clv", f"{driver}_binned")


def segment_drilldown(customers: DataFrame, segment: str | None) -> DataFrame:
    """Rows of one segment; no filter for none / ``All Segments`` (F8)."""
    if not segment or segment == "All Segments":
        return customers
    return customers.filter(F.col("Segment") == segment)


DETAIL_COLUMNS = ("CustomerID", "Segment", "Recency", "Frequency", "Monetary", "R_Score", "F_Score",
                  "M_Score", "predicted_clv", "prob_alive", "category_count", "time_to_second_purchase")


def customer_detail(customers: DataFrame) -> DataFrame:
    """The 12-column customer detail projection."""
    return customers.select(*DETAIL_COLUMNS)


def page_after(customers: DataFrame, last=None, size: int = 15) -> DataFrame:
    """The next ``size`` customers by falling CLV, then recency and id, after
    the one whose (predicted_clv, Recency, CustomerID) is ``last`` (O5, F18):
    the position is a filter that the scan takes, so the millionth page costs
    as much as the first; each task keeps ``size`` rows."""
    if last is not None:
        value, recency, customer = last
        clv, days, name = F.col("predicted_clv"), F.col("Recency"), F.col("CustomerID")
        customers = customers.filter((clv <= value) & ((clv < value) | (days > recency) | ((days == recency) & (name > customer))))
    return customers.orderBy(F.col("predicted_clv").desc(), F.col("Recency"), F.col("CustomerID")).limit(size)


def customer_table_query(customers: DataFrame, where: str | None = None, sort=(("predicted_clv", False),),
                         page: int = 0, page_size: int = 15) -> DataFrame:
    """User filter, multi-column sort (CustomerID breaks ties) and one page
    (F18, O5): a top-k, not a full sort."""
    df = customer_detail(customers)
    if where:
        df = df.filter(F.expr(where))
    order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in sort] + [F.col("CustomerID").asc()]
    return df.orderBy(*order).offset(page * page_size).limit(page_size)


def rfm_scatter(customers: DataFrame, segment: str | None = None) -> DataFrame:
    """Scatter columns with highlight opacity and size."""
    base = customers.select("CustomerID", "Recency", "Frequency", "Monetary", "Segment", "predicted_clv")
    if segment:
        hit = F.col("Segment") == segment
        return base.withColumn("opacity", F.when(hit, 1.0).otherwise(0.3)) \
            .withColumn("size", F.when(hit, 10).otherwise(6))
    return base.withColumn("opacity", F.lit(1.0)).withColumn("size", F.lit(8))


def rfm_describe(rfm: DataFrame, cols=("Recency", "Frequency", "Monetary")) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (exact, linear), max per
    column (A6), one row per statistic column."""
    quartiles = quantile_values(rfm, cols, [0.25, 0.5, 0.75])
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                      F.min(c).cast("double").alias("min"),
                      *[F.lit(q).cast("double").alias(name) for q, name in zip(quartiles[c], ("p25", "p50", "p75"))],
                      F.max(c).cast("double").alias("max")) for c in cols]
    return rfm.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def clv_cumulative(clv: DataFrame, value: str = "CLV_12months") -> DataFrame:
    """Customers by CLV descending with the cumulative share of the total
    (W6): a distributed running sum, no single-partition window."""
    total = clv.agg(F.sum(value)).scalar()
    c = global_cumsum(clv.select("CustomerID", value), [F.col(value).desc(), F.col("CustomerID")], value, "_cum")
    return c.select("CustomerID", value, safe_ratio(F.col("_cum"), total).alias("cum_pct"))


def value_concentration(df: DataFrame, value: str, shares=(0.01, 0.1, 0.2, 0.5)) -> DataFrame:
    """Share of the total held by the top 1/10/20/50 % of rows by ``value``
    (position < n*p, positions from a distributed rank) and the bottom 50 %
    (W7, E15)."""
    r = global_row_number(df.select("CustomerID", value), [F.col(value).desc(), F.col("CustomerID")],
                          "_rn", total_name="_n")
    pos = F.col("_rn") - 1
    cols = [F.sum(F.when(pos < F.col("_n") * p, F.col(value))).alias(f"_t{i}") for i, p in enumerate(shares)]
    a = r.agg(F.sum(value).alias("_total"), *cols)
    out = []
    for i, p in enumerate(shares):
        out.append(F.coalesce(safe_ratio(F.col(f"_t{i}"), F.col("_total")), F.lit(0.0)).alias(f"top_{int(p * 100)}_pct"))
    last = len(shares) - 1
    out.append((1 - F.coalesce(safe_ratio(F.col(f"_t{last}"), F.col("_total")), F.lit(0.0)))
               .alias(f"bottom_{100 - int(shares[last] * 100)}_pct"))
    return a.select(*out)
