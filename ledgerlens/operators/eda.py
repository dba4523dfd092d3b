"""Exploratory metrics the reference reports in prose (E1-E19). Each is a
grouped aggregate (partial aggregation before the shuffle); per-customer
order positions use ``row_number() <= k`` so Spark plans a two-sided
``WindowGroupLimit`` and a heavy customer sends at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.functions.dates import floor_days, plus_days
from ledgerlens.functions.numeric import round_half_up
from ledgerlens.operators.clean import snapshot_date, tx_normalized
from ledgerlens.operators.ordered import global_row_number, quantile_columns
from ledgerlens.operators.rfm import rfm_segments
from ledgerlens.operators.views import value_concentration


def _share_of(col: str, name: str) -> F.Column:
    total = F.sum(col).over(Window.partitionBy())  # over the few aggregated rows
    return F.when(total > 0, F.col(col) / total * 100).otherwise(F.lit(0.0)).alias(name)


def dataset_profile(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Date span, customers, invoices, countries, lines per invoice, value per
    invoice on clean lines; return rate and missing-customer rate on raw
    lines (E1)."""
    r = tx_normalized(raw).agg(F.struct(
        (F.count_if(F.col("Quantity") < 0) / F.count(F.lit(1)) * 100).alias("return_rate"),
        (F.count_if(F.col("CustomerID").isNull()) / F.count(F.lit(1)) * 100).alias("missing_customer_pct"))).scalar()
    cols = [F.min("InvoiceDate").alias("first_date"), F.max("InvoiceDate").alias("last_date"),
            F.count_distinct("CustomerID").alias("customers"), F.count_distinct("InvoiceNo").alias("invoices"),
            F.count(F.lit(1)).alias("lines"), F.sum("TotalPrice").alias("_rev")]
    if "Country" in clean.columns:
        cols.append(F.count_distinct("Country").alias("countries"))
    a = clean.agg(*cols)
    out = a.select(
        "first_date", "last_date", floor_days(F.col("first_date"), F.col("last_date")).alias("span_days"),
        "customers", "invoices", "lines", *(["countries"] if "Country" in clean.columns else []),
        (F.col("lines") / F.col("invoices")).alias("lines_per_invoice"),
        (F.col("_rev") / F.col("invoices")).alias("value_per_invoice"),
        r["return_rate"].alias("return_rate"), r["missing_customer_pct"].alias("missing_customer_pct"))
    return out


def sales_by_weekday(clean: DataFrame) -> DataFrame:
    """Lines, invoices and revenue by day of week, 1 = Sunday."""
    g = clean.groupBy(F.dayofweek("InvoiceDate").alias("weekday"),
                      F.date_format("InvoiceDate", "EEEE").alias("weekday_name")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("InvoiceNo").alias("invoices"),
        F.sum("TotalPrice").alias("revenue"))
    return g.select("*", _share_of("revenue", "revenue_share"))


def sales_by_month(clean: DataFrame) -> DataFrame:
    """Revenue, invoices and customers per calendar month with the change on
    the previous month (E3). The lag runs over the monthly rows (one per
    month), not over transactions."""
    g = clean.groupBy(F.to_date(F.date_trunc("month", "InvoiceDate")).alias("month")).agg(
        F.sum("TotalPrice").alias("revenue"), F.count_distinct("InvoiceNo").alias("invoices"),
        F.count_distinct("CustomerID").alias("customers"))
    prev = F.lag("revenue").over(Window.orderBy("month"))
    return g.select("month", "revenue", "invoices", "customers",
                    F.when(prev > 0, (F.col("revenue") - prev) / prev * 100).alias("revenue_change_pct"))


def sales_by_quarter(clean: DataFrame) -> DataFrame:
    """Revenue, invoices and lines per calendar quarter with the change on
    the previous quarter (E3, quarter over quarter); the lag runs over the
    quarterly rows."""
    g = clean.groupBy(F.to_date(F.date_trunc("quarter", "InvoiceDate")).alias("quarter")).agg(
        F.sum("TotalPrice").alias("revenue"), F.count_distinct("InvoiceNo").alias("invoices"),
        F.count(F.lit(1)).alias("lines"))
    w = Window.orderBy("quarter")
    prev_rev, prev_inv = F.lag("revenue").over(w), F.lag("invoices").over(w)
    return g.select("quarter", "revenue", "invoices", "lines",
                    F.when(prev_rev > 0, (F.col("revenue") - prev_rev) / prev_rev * 100).alias("revenue_change_pct"),
                    F.when(prev_inv > 0, (F.col("invoices") - prev_inv) / prev_inv * 100).alias("invoice_change_pct"))


def country_share(clean: DataFrame) -> DataFrame:
    """Customers per country and percent of all customers."""
    total = clean.agg(F.count_distinct("CustomerID")).scalar()
    g = clean.groupBy("Country").agg(F.count_distinct("CustomerID").alias("customers"))
    return g.select("Country", "customers", (F.col("customers") / total * 100).alias("percent"))


def _banded(df: DataFrame, label: F.Column) -> DataFrame:
    g = df.groupBy(label.alias("band")).agg(F.count(F.lit(1)).alias("customers"))
    return g.select("band", "customers", _share_of("customers", "percent"))


def recency_bands(rfm: DataFrame) -> DataFrame:
    """Customers within 30, 31-90 and over 90 days of the snapshot (E5)."""
    r = F.col("Recency")
    return _banded(rfm, F.when(r <= 30, "0-30 days").when(r <= 90, "31-90 days").otherwise("90+ days"))


def frequency_bands(rfm: DataFrame) -> DataFrame:
    """Customers with 1, 2-5, 6-12 and 13+ invoices."""
    f = F.col("Frequency")
    return _banded(rfm, F.when(f <= 1, "1").when(f <= 5, "2-5").when(f <= 12, "6-12").otherwise("13+"))


def monetary_quantiles(rfm: DataFrame) -> DataFrame:
    """Median spend and the top-10 % and top-1 % thresholds (E7), exact."""
    return quantile_columns(rfm, "Monetary", [0.5, 0.9, 0.99], ["median", "top_10_pct_threshold",
                                                                "top_1_pct_threshold"])


def freq_vs_value_corr(rfm: DataFrame) -> DataFrame:
    """corr(Frequency, Monetary) and corr(Frequency, Monetary / Frequency)."""
    return rfm.agg(F.corr(F.col("Frequency").cast("double"), "Monetary").alias("corr_frequency_monetary"),
                   F.corr(F.col("Frequency").cast("double"), F.col("Monetary") / F.col("Frequency"))
                   .alias("corr_frequency_order_value"))


def customer_profile(clean: DataFrame) -> DataFrame:
    """Per customer: purchase days, average invoice value, days since the last
    and since the first purchase at the snapshot (E9)."""
    snap = snapshot_date(clean).select("snapshot_date").scalar()
    g = clean.groupBy("CustomerID").agg(
        F.count_distinct(F.to_date("InvoiceDate")).alias("PurchaseFrequency"),
        (F.sum("TotalPrice") / F.count_distinct("InvoiceNo")).alias("AverageOrderValue"),
        F.max("InvoiceDate").alias("_last"), F.min("InvoiceDate").alias("_first"))
    return g.select("CustomerID", "PurchaseFrequency", "AverageOrderValue",
                    floor_days(F.col("_last"), snap).alias("PurchaseRecency"),
                    floor_days(F.col("_first"), snap).alias("DaysSinceFirstPurchase"))


def segment_revenue_share(customers: DataFrame) -> DataFrame:
    """Per segment: share of customers and of revenue, mean invoices, revenue
    per invoice, mean recency (E10)."""
    g = customers.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("Monetary").alias("revenue"),
        F.avg("Frequency").alias("avg_frequency"), (F.sum("Monetary") / F.sum("Frequency")).alias("avg_order_value"),
        F.avg("Recency").alias("avg_recency"))
    return g.select("Segment", "customers", _share_of("customers", "pct_customers"), "revenue",
                    _share_of("revenue", "pct_revenue"), "avg_frequency", "avg_order_value", "avg_recency")


def segment_transitions(clean: DataFrame, now: DataFrame | None = None, cfg: Config = DEFAULT,
                        days_back: int = 90) -> DataFrame:
    """``clean``: lines or visits; ``now``: today's segments where they are
    known already. Segment at a snapshot ``days_back`` earlier vs now, for customers in
    both; count and share of the earlier segment moving to each segment (E11)."""
    cutoff = clean.agg(F.max("InvoiceDate")).scalar()
    early = clean.filter(F.col("InvoiceDate") <= plus_days(cutoff, -days_back))
    before = rfm_segments(early, cfg=cfg).select("CustomerID", F.col("Segment").alias("from_segment"))
    after = (rfm_segments(clean, cfg=cfg) if now is None else now).select("CustomerID", F.col("Segment").alias("to_segment"))
    g = before.join(after, "CustomerID", "inner").groupBy("from_segment", "to_segment").agg(
        F.count(F.lit(1)).alias("customers"))
    tot = F.sum("customers").over(Window.partitionBy("from_segment"))  # over the segment pairs
    return g.select("from_segment", "to_segment", "customers", (F.col("customers") / tot * 100).alias("share_pct"))


def first_purchases(clean: DataFrame) -> DataFrame:
    return clean.groupBy("CustomerID").agg(F.min("InvoiceDate").alias("first_purchase"))


def acquisition_season(customers: DataFrame, clean: DataFrame, months=(9, 10, 11)) -> DataFrame:
    """Mean CLV of customers first buying in September-November vs the rest."""
    fp = first_purchases(clean)
    j = customers.select("CustomerID", "predicted_clv").join(fp, "CustomerID", "inner")
    season = F.when(F.month("first_purchase").isin(*months), "Sep-Nov").otherwise("Other")
    return j.groupBy(season.alias("acquisition_season")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("predicted_clv").alias("avg_clv"))


def _invoice_totals(clean: DataFrame) -> DataFrame:
    return clean.groupBy("CustomerID", "InvoiceNo").agg(F.min("InvoiceDate").alias("InvoiceDate"),
                                                       F.sum("TotalPrice").alias("order_value"))


def order_size_progression(clean: DataFrame) -> DataFrame:
    """Mean first order value vs mean value of orders 3 to 5."""
    inv = _invoice_totals(clean)
    w = Window.partitionBy("CustomerID").orderBy("InvoiceDate", "InvoiceNo")
    top5 = inv.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 5)
    a = top5.agg(F.avg(F.when(F.col("_rn") == 1, F.col("order_value"))).alias("avg_first_order"),
                 F.avg(F.when(F.col("_rn").between(3, 5), F.col("order_value"))).alias("avg_orders_3_to_5"))
    return a.select("*", (F.col("avg_orders_3_to_5") / F.col("avg_first_order")).alias("growth_ratio"))


def return_rate_driver(raw: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of a customer's lines that are returns, banded, vs mean CLV."""
    lines = tx_normalized(raw).filter(F.col("CustomerID").isNotNull())
    rate = lines.groupBy("CustomerID").agg(
        (F.count_if(F.col("Quantity") < 0) / F.count(F.lit(1)) * 100).alias("return_rate"))
    r = F.col("return_rate")
    band = F.when(r == 0, "0%").when(r < 5, "0-5%").when(r <= 15, "5-15%").otherwise("15%+")
    j = customers.select("CustomerID", "predicted_clv").join(rate, "CustomerID", "inner")
    return j.groupBy(band.alias("return_band")).agg(F.count(F.lit(1)).alias("customers"),
                                                    F.avg("predicted_clv").alias("avg_clv"))


def revenue_concentration(rfm: DataFrame) -> DataFrame:
    """Revenue share of the top 1/10/20/50 % of customers and the bottom 50 %."""
    return value_concentration(rfm, "Monetary")


def clv_to_cac(customers: DataFrame, cac: float = 30.0) -> DataFrame:
    """Mean CLV per segment over an acquisition cost."""
    g = customers.groupBy("Segment").agg(F.avg("predicted_clv").alias("avg_clv"))
    return g.select("Segment", "avg_clv", (F.col("avg_clv") / cac).alias("clv_to_cac"))


def gateway_products(clean: DataFrame, customers: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Every product bought on a customer's first purchase date, ranked by the
    mean CLV of those customers (E17). ``seen``: visits of the same lines, to
    take the first dates from. Lines are first
    collapsed to (customer, date, product) so a heavy customer is combined
    map-side before the join."""
    fp = first_purchases(clean if seen is None else seen)
    items = clean.groupBy("CustomerID", "InvoiceDate", "StockCode").agg(F.count(F.lit(1)).alias("_n"))
    firsts = items.join(fp, (items.CustomerID == fp.CustomerID) & (items.InvoiceDate == fp.first_purchase),
                        "inner").select(items.CustomerID, "StockCode")
    j = firsts.join(customers.select("CustomerID", "predicted_clv"), "CustomerID", "inner")
    g = j.groupBy("StockCode").agg(F.count(F.lit(1)).alias("customers"), F.avg("predicted_clv").alias("avg_clv"))
    # ranked in cents, so float noise in the means cannot reorder equal values
    g = g.withColumn("_cents", -round_half_up("avg_clv", 2))
    return global_row_number(g, [F.col("_cents"), F.col("StockCode")], "rank").drop("_cents")


def _month_index(c: F.Column) -> F.Column:
    return F.year(c) * 12 + F.month(c)


def cohort_retention(clean: DataFrame) -> DataFrame:
    """Customers active n months after their first-purchase month, per
    cohort, and the share of the cohort (E18)."""
    act = clean.groupBy("CustomerID", _month_index(F.col("InvoiceDate")).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    first = act.groupBy("CustomerID").agg(F.min("_m").alias("_c"))
    j = act.join(first, "CustomerID", "inner")
    g = j.groupBy("_c", (F.col("_m") - F.col("_c")).alias("months_since")).agg(
        F.count(F.lit(1)).alias("active_customers"))
    size = F.max(F.when(F.col("months_since") == 0, F.col("active_customers"))).over(Window.partitionBy("_c"))
    year = F.floor((F.col("_c") - 1) / 12).cast("int")
    month = ((F.col("_c") - 1) % 12 + 1).cast("int")
    return g.select(F.make_date(year, month, F.lit(1)).alias("cohort"), "months_since", "active_customers",
                    size.alias("cohort_size"), (F.col("active_customers") / size * 100).alias("retention_pct"))


def cancellation_patterns(raw: DataFrame, customers: DataFrame) -> DataFrame:
    """Per customer: invoices, cancelled invoices and their share, with the
    customer's segment and P(alive) (E19)."""
    lines = tx_normalized(raw).filter(F.col("CustomerID").isNotNull())
    cancelled = F.col("InvoiceNo").startswith("C")
    g = lines.groupBy("CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("invoices"),
        F.count_distinct(F.when(cancelled, F.col("InvoiceNo"))).alias("cancelled_invoices"))
    g = g.withColumn("cancellation_rate", F.col("cancelled_invoices") / F.col("invoices") * 100)
    return g.join(customers.select("CustomerID", "Segment", "prob_alive"), "CustomerID", "left")

