"""Registered cleaning diagnostics, appendix variants, exploratory metrics,
model fits, the boosted-tree predictor and model checks."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import functions as F

from ledgerlens.config import FIXED_BGNBD, FIXED_GAMMA_GAMMA
from ledgerlens.operators import clean as C
from ledgerlens.operators import clv as CL
from ledgerlens.operators import eda as E
from ledgerlens.operators import features as FE
from ledgerlens.operators import ml as ML
from ledgerlens.operators import rfm as RF
from ledgerlens.operators import validation as VA
from ledgerlens.operators import views as V
from ledgerlens.operators.ordered import group_medians
from ledgerlens.plans.common import InputCache, clean_tx, customer_plan, raw_tx, rounded
from ledgerlens.plans.registry import CUSTOMER_MONEY, CUSTOMER_RATIO, register
from ledgerlens.session import partitions_for

# --- cleaning diagnostics -------------------------------------------------------


@register("tx_normalized")
def q_tx_normalized(spark, sf_dir):
    return rounded(C.tx_normalized(raw_tx(spark, sf_dir, dirty=True)), money=["UnitPrice", "TotalPrice"])


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return C.null_counts(raw_tx(spark, sf_dir, dirty=True))


@register("cleaning_audit")
def q_cleaning_audit(spark, sf_dir):
    return C.cleaning_audit(raw_tx(spark, sf_dir, dirty=True))


@register("returns_lines")
def q_returns_lines(spark, sf_dir):
    return C.returns_lines(raw_tx(spark, sf_dir))


@register("zero_price_lines")
def q_zero_price_lines(spark, sf_dir):
    return C.zero_price_lines(raw_tx(spark, sf_dir, dirty=True))


@register("cancelled_lines")
def q_cancelled_lines(spark, sf_dir):
    return C.cancelled_lines(raw_tx(spark, sf_dir))


@register("duplicate_count")
def q_duplicate_count(spark, sf_dir):
    return C.duplicate_count(raw_tx(spark, sf_dir, dirty=True))


@register("iqr_outliers")
def q_iqr_outliers(spark, sf_dir):
    return rounded(C.iqr_summary(raw_tx(spark, sf_dir)),
                   ratio=["quantity_lower", "quantity_upper", "price_lower", "price_upper"])


@register("iqr_price_outlier_lines")
def q_iqr_price_outlier_lines(spark, sf_dir):
    return rounded(C.iqr_outliers(raw_tx(spark, sf_dir), "UnitPrice"),
                   money=["UnitPrice", "TotalPrice"], ratio=["lower_bound", "upper_bound"])


@register("bulk_and_pricey")
def q_bulk_and_pricey(spark, sf_dir):
    return rounded(C.bulk_and_pricey(raw_tx(spark, sf_dir)), money=["UnitPrice", "TotalPrice"])


@register("distinct_customers")
def q_distinct_customers(spark, sf_dir):
    return C.distinct_customers(clean_tx(spark, sf_dir, dirty=True))


@register("tx_clean_appendix")
def q_tx_clean_appendix(spark, sf_dir):
    return rounded(C.tx_clean_appendix(raw_tx(spark, sf_dir, dirty=True)), money=["UnitPrice", "TotalPrice"])


# --- appendix variants ------------------------------------------------------------

def _v2(spark, sf_dir):
    """Appendix segments: same scores, the appendix rule set."""
    seg = customer_plan(spark, sf_dir).segments
    return seg.withColumn("Segment", RF.segment_of(F.col("R_Score"), F.col("F_Score"), F.col("M_Score"),
                                                   5, "appendix"))


@register("rfm_segments_v2")
def q_rfm_segments_v2(spark, sf_dir):
    return rounded(_v2(spark, sf_dir), money=["Monetary"])


@register("segment_stats")
def q_segment_stats(spark, sf_dir):
    seg = _v2(spark, sf_dir)
    means = seg.groupBy("Segment").agg(
        F.avg("Recency").alias("Recency_mean"), F.avg("Frequency").alias("Frequency_mean"),
        F.avg("Monetary").alias("Monetary_mean"), F.count(F.lit(1)).alias("count"))
    out = means.join(group_medians(seg, ("Recency", "Frequency", "Monetary"), "Segment"), "Segment", "left")
    cols = [c for c in out.columns if c not in ("Segment", "count")]
    return rounded(out, ratio=cols)


_HORIZONS = InputCache()


def _horizons(spark, sf_dir):
    """Appendix CLV horizons, materialised once per session like the
    customer table they derive from."""
    from ledgerlens.session import cut_lineage
    return _HORIZONS.get(spark, sf_dir, (), lambda: cut_lineage(CL.clv_horizons(
        customer_plan(spark, sf_dir).summary, _v2(spark, sf_dir), FIXED_BGNBD, FIXED_GAMMA_GAMMA)))


# expected spend of cent amounts can sit on a half cent: four decimals
HORIZON_MONEY = ["CLV_3months", "CLV_6months", "CLV_12months"]
HORIZON_RATIO = ["prob_alive", "predicted_purch_3m", "predicted_purch_6m", "predicted_purch_12m"]


@register("clv_horizons")
def q_clv_horizons(spark, sf_dir):
    out = rounded(_horizons(spark, sf_dir), money=HORIZON_MONEY, ratio=HORIZON_RATIO)
    return rounded(out, money=["predicted_avg_value"], digits_money=4)


@register("segment_clv_horizons")
def q_segment_clv_horizons(spark, sf_dir):
    h = _horizons(spark, sf_dir)
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in ("CLV_3months", "CLV_6months", "CLV_12months"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sum(c).alias(f"{c}_sum")]
    aggs.append(F.avg("prob_alive").alias("prob_alive_mean"))
    out = h.groupBy("Segment").agg(*aggs)
    out = out.join(group_medians(h, ("CLV_3months", "CLV_6months", "CLV_12months", "prob_alive"), "Segment"), "Segment", "left")
    money = [c for c in out.columns if c.startswith("CLV_")]
    return rounded(out, money=money, ratio=["prob_alive_mean", "prob_alive_median"])


@register("customer_avg_line_value")
def q_customer_avg_line_value(spark, sf_dir):
    app = C.tx_clean_appendix(raw_tx(spark, sf_dir))
    # a mean of cent amounts over 2^k lines ends in 5 at decimal 2 + k: round at 7
    return rounded(app.groupBy("CustomerID").agg(F.avg("TotalPrice").alias("avg_transaction_value")),
                   ratio=["avg_transaction_value"], digits_ratio=7)


@register("clv_total_12m")
def q_clv_total_12m(spark, sf_dir):
    return rounded(_horizons(spark, sf_dir).agg(F.sum("CLV_12months").alias("total_12m_value")),
                   money=["total_12m_value"])


@register("customer_age")
def q_customer_age(spark, sf_dir):
    """First purchase (appendix cleaning) and T = floor days to the snapshot
    taken over all lines with a customer (A36)."""
    from ledgerlens.functions.dates import floor_days, plus_days
    raw = C.tx_normalized(raw_tx(spark, sf_dir)).filter(F.col("CustomerID").isNotNull())
    snap = plus_days(raw.agg(F.max("InvoiceDate")).scalar(), 1)
    app = C.tx_clean_appendix(raw_tx(spark, sf_dir))
    first = app.groupBy("CustomerID").agg(F.min("InvoiceDate").alias("FirstPurchaseDate"))
    return first.select("CustomerID", "FirstPurchaseDate", floor_days(F.col("FirstPurchaseDate"), snap).alias("T"))


@register("clv_cumulative")
def q_clv_cumulative(spark, sf_dir):
    return rounded(V.clv_cumulative(_horizons(spark, sf_dir)), money=["CLV_12months"], ratio=["cum_pct"])


@register("value_concentration")
def q_value_concentration(spark, sf_dir):
    out = V.value_concentration(_horizons(spark, sf_dir), "CLV_12months")
    return rounded(out, ratio=out.columns)


# --- exploratory metrics ------------------------------------------------------------

def _cust(spark, sf_dir):
    return customer_plan(spark, sf_dir).customers


def _rfm(spark, sf_dir):
    return customer_plan(spark, sf_dir).segments


@register("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    out = E.dataset_profile(raw_tx(spark, sf_dir, dirty=True), clean_tx(spark, sf_dir, with_country=True, dirty=True))
    return rounded(out, ratio=["lines_per_invoice", "value_per_invoice", "return_rate", "missing_customer_pct"])


@register("sales_by_weekday")
def q_sales_by_weekday(spark, sf_dir):
    return rounded(E.sales_by_weekday(clean_tx(spark, sf_dir)), money=["revenue"], ratio=["revenue_share"])


@register("sales_by_month")
def q_sales_by_month(spark, sf_dir):
    return rounded(E.sales_by_month(clean_tx(spark, sf_dir)), money=["revenue"], ratio=["revenue_change_pct"])


@register("sales_by_quarter")
def q_sales_by_quarter(spark, sf_dir):
    return rounded(E.sales_by_quarter(clean_tx(spark, sf_dir)), money=["revenue"],
                   ratio=["revenue_change_pct", "invoice_change_pct"])


@register("distinct_sketch_check")
def q_distinct_sketch_check(spark, sf_dir):
    from ledgerlens.operators.sketches import monthly_sketches, sketch_check
    from ledgerlens.session import cut_lineage
    clean = clean_tx(spark, sf_dir)
    return sketch_check(clean, cut_lineage(monthly_sketches(clean)))


@register("country_share")
def q_country_share(spark, sf_dir):
    return rounded(E.country_share(clean_tx(spark, sf_dir, with_country=True)), ratio=["percent"])


@register("recency_bands")
def q_recency_bands(spark, sf_dir):
    return rounded(E.recency_bands(_rfm(spark, sf_dir)), ratio=["percent"])


@register("frequency_bands")
def q_frequency_bands(spark, sf_dir):
    return rounded(E.frequency_bands(_rfm(spark, sf_dir)), ratio=["percent"])


@register("monetary_quantiles")
def q_monetary_quantiles(spark, sf_dir):
    return rounded(E.monetary_quantiles(_rfm(spark, sf_dir)),
                   ratio=["median", "top_10_pct_threshold", "top_1_pct_threshold"])


@register("freq_vs_value_corr")
def q_freq_vs_value_corr(spark, sf_dir):
    return rounded(E.freq_vs_value_corr(_rfm(spark, sf_dir)),
                   ratio=["corr_frequency_monetary", "corr_frequency_order_value"])


@register("customer_profile")
def q_customer_profile(spark, sf_dir):
    return rounded(E.customer_profile(clean_tx(spark, sf_dir)), ratio=["AverageOrderValue"])


@register("segment_revenue_share")
def q_segment_revenue_share(spark, sf_dir):
    return rounded(E.segment_revenue_share(_cust(spark, sf_dir)), money=["revenue"],
                   ratio=["pct_customers", "pct_revenue", "avg_frequency", "avg_order_value", "avg_recency"])


@register("segment_transitions")
def q_segment_transitions(spark, sf_dir):
    plan = customer_plan(spark, sf_dir)
    with partitions_for(plan.visits):
        return rounded(E.segment_transitions(plan.visits, plan.segments), ratio=["share_pct"])


@register("acquisition_season")
def q_acquisition_season(spark, sf_dir):
    return rounded(E.acquisition_season(_cust(spark, sf_dir), clean_tx(spark, sf_dir)), money=["avg_clv"])


@register("order_size_progression")
def q_order_size_progression(spark, sf_dir):
    return rounded(E.order_size_progression(clean_tx(spark, sf_dir)),
                   ratio=["avg_first_order", "avg_orders_3_to_5", "growth_ratio"])


@register("return_rate_driver")
def q_return_rate_driver(spark, sf_dir):
    return rounded(E.return_rate_driver(raw_tx(spark, sf_dir), _cust(spark, sf_dir)), money=["avg_clv"])


@register("revenue_concentration")
def q_revenue_concentration(spark, sf_dir):
    out = E.revenue_concentration(_rfm(spark, sf_dir))
    return rounded(out, ratio=out.columns)


@register("clv_to_cac")
def q_clv_to_cac(spark, sf_dir):
    return rounded(E.clv_to_cac(_cust(spark, sf_dir)), money=["avg_clv"], ratio=["clv_to_cac"])


@register("gateway_products")
def q_gateway_products(spark, sf_dir):
    return rounded(E.gateway_products(clean_tx(spark, sf_dir), _cust(spark, sf_dir), customer_plan(spark, sf_dir).visits), money=["avg_clv"])


@register("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return rounded(E.cohort_retention(clean_tx(spark, sf_dir)), ratio=["retention_pct"])


@register("cancellation_patterns")
def q_cancellation_patterns(spark, sf_dir):
    return rounded(E.cancellation_patterns(raw_tx(spark, sf_dir), _cust(spark, sf_dir)),
                   ratio=["cancellation_rate", "prob_alive"])


# --- model checks ------------------------------------------------------------------

@register("calibration_holdout")
def q_calibration_holdout(spark, sf_dir):
    out = VA.calibration_holdout(clean_tx(spark, sf_dir), FIXED_BGNBD)
    return rounded(out, ratio=["predicted_total", "mae", "mse", "correlation"])


@register("calibration_holdout_fitted")
def q_calibration_holdout_fitted(spark, sf_dir):
    """The same check of the model fitted on the calibration part."""
    seen = customer_plan(spark, sf_dir).visits
    with partitions_for(seen):
        out = VA.calibration_holdout(seen)
    return rounded(out, ratio=["predicted_total", "mae", "mse", "correlation"])


@register("event_calibration_holdout")
def q_event_calibration_holdout(spark, sf_dir):
    out = VA.calibration_holdout(_event_clean(spark, sf_dir), FIXED_BGNBD)
    return rounded(out, ratio=["predicted_total", "mae", "mse", "correlation"])


@register("interpurchase_distribution")
def q_interpurchase_distribution(spark, sf_dir):
    return rounded(VA.interpurchase_distribution(clean_tx(spark, sf_dir)), ratio=["mean_gap", "share_pct"])


@register("purchase_count_check")
def q_purchase_count_check(spark, sf_dir):
    return rounded(VA.purchase_count_check(customer_plan(spark, sf_dir).summary, FIXED_BGNBD), ratio=["expected"])


@register("time_between")
def q_time_between(spark, sf_dir):
    return FE.time_between(clean_tx(spark, sf_dir)).select("CustomerID", "InvoiceDate", "TimeDiff")


# --- engineered features and the boosted-tree predictor -----------------------------

_FEATURES = InputCache()


def _features(spark, sf_dir):
    """Engineered features, built and materialised once per input."""
    from ledgerlens.session import cut_lineage

    def build():
        plan = customer_plan(spark, sf_dir)
        with partitions_for(plan.visits):
            return cut_lineage(FE.ml_features(_rfm(spark, sf_dir), plan.visits, products_of=plan.drivers,
                                              spread_of=plan.order_spread))

    return _FEATURES.get(spark, sf_dir, (), build)


FEATURE_MONEY = ["Monetary"]
FEATURE_RATIO = ["MeanTimeBetweenPurchases", "StdTimeBetweenPurchases", "AvgOrderQuantity", "TotalQuantity",
                 "PurchaseCountLast3Months", "AvgOrderValueStdDev", "CategoryDiversityIndex"]


@register("ml_features")
def q_ml_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir), money=FEATURE_MONEY, ratio=FEATURE_RATIO)


@register("ml_dataset")
def q_ml_dataset(spark, sf_dir):
    data = ML.ml_dataset(_features(spark, sf_dir), _cust(spark, sf_dir))
    return rounded(data, money=["Monetary", "predicted_clv"],
                   ratio=[c for c in FEATURE_RATIO if c in data.columns])


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    data = ML.ml_dataset(_features(spark, sf_dir), _cust(spark, sf_dir))
    train, test = ML.train_test_split(data)
    return train.select("CustomerID", F.lit("train").alias("split")).unionByName(
        test.select("CustomerID", F.lit("test").alias("split")))


@register("baseline_metrics")
def q_baseline_metrics(spark, sf_dir):
    train, test = ML.train_test_split(ML.ml_dataset(_features(spark, sf_dir), _cust(spark, sf_dir)))
    return rounded(ML.baseline_metrics(test, train), money=["baseline_mae", "baseline_rmse"])


_MODELS = InputCache()


def _trained(spark, sf_dir, loss="squared"):
    """Train once per application, data and loss; the metrics and importance
    queries share the model."""
    from ledgerlens.session import cut_lineage

    def train_once():
        data = cut_lineage(ML.ml_dataset(_features(spark, sf_dir), _cust(spark, sf_dir)))
        feats = ML.feature_list(data)
        train, test = ML.train_test_split(data)
        return ML.gbt_fit(train, feats, loss), train, test, feats

    return _MODELS.get(spark, sf_dir, (loss,), train_once)


@register("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    model, train, test, _ = _trained(spark, sf_dir)
    return ML.regression_metrics(model, test, train)


@register("regression_metrics_absolute")
def q_regression_metrics_absolute(spark, sf_dir):
    model, train, test, _ = _trained(spark, sf_dir, "absolute")
    return ML.regression_metrics(model, test, train)


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    model, _, _, feats = _trained(spark, sf_dir)
    return ML.feature_importance(spark, model, feats)


def _boosted(spark, sf_dir, loss="squared"):
    """The learners as configured (second order with columns drawn per tree;
    leaf-wise on the absolute loss), each fitted once per application and data
    with a validation share of the training rows for early stopping."""
    from ledgerlens.operators import boosting as BO
    from ledgerlens.session import cut_lineage

    def train_once():
        data = cut_lineage(ML.ml_dataset(_features(spark, sf_dir), _cust(spark, sf_dir)))
        feats = ML.feature_list(data)
        train, test = ML.train_test_split(data)
        cfg = BO.SECOND_ORDER if loss == "squared" else BO.LEAF_WISE
        return BO.fit(train, feats, ML.TARGET, cfg, validation=ML.validation_rows()), train, test

    return _MODELS.get(spark, sf_dir, ("boosting", loss), train_once)


@register("boosted_rounds")
def q_boosted_rounds(spark, sf_dir):
    from ledgerlens.operators.boosting import rounds_table
    return rounds_table(spark, _boosted(spark, sf_dir)[0])


@register("boosted_metrics")
def q_boosted_metrics(spark, sf_dir):
    model, train, test = _boosted(spark, sf_dir)
    return ML.metrics_of(test.withColumn("prediction", model.predict()), train)


@register("boosted_importance")
def q_boosted_importance(spark, sf_dir):
    model = _boosted(spark, sf_dir)[0]
    rows = spark.createDataFrame(list(zip(model.features, model.importances())), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(10)


@register("leafwise_rounds")
def q_leafwise_rounds(spark, sf_dir):
    from ledgerlens.operators.boosting import rounds_table
    return rounds_table(spark, _boosted(spark, sf_dir, "absolute")[0])


@register("leafwise_metrics")
def q_leafwise_metrics(spark, sf_dir):
    model, train, test = _boosted(spark, sf_dir, "absolute")
    return ML.metrics_of(test.withColumn("prediction", model.predict()), train)


# --- model fits (parameter rows; no SQL twin) ----------------------------------------

@register("bgnbd_objective")
def q_bgnbd_objective(spark, sf_dir):
    """Likelihood and penalised objective at the fixed parameters: what the
    fit minimises, checked by SQL."""
    from ledgerlens.operators import bgnbd
    return rounded(bgnbd.objective(customer_plan(spark, sf_dir).summary, FIXED_BGNBD),
                   ratio=["mean_log_likelihood", "objective"])


@register("gg_objective")
def q_gg_objective(spark, sf_dir):
    from ledgerlens.operators import gammagamma
    return rounded(gammagamma.objective(customer_plan(spark, sf_dir).summary, FIXED_GAMMA_GAMMA),
                   ratio=["mean_log_likelihood", "objective"])


REPORT = "converged boolean, at_bound boolean, iterations int, objective double, gradient_norm double"


@register("bgnbd_fit")
def q_bgnbd_fit(spark, sf_dir):
    from ledgerlens.plans.common import fitted_params
    p = fitted_params(spark, sf_dir)[0]
    return spark.createDataFrame([(p.r, p.alpha, p.a, p.b, *astuple(p.report))],
                                 f"r double, alpha double, a double, b double, {REPORT}")


@register("gg_fit")
def q_gg_fit(spark, sf_dir):
    from ledgerlens.plans.common import fitted_params
    p = fitted_params(spark, sf_dir)[1]
    if p is None:
        return spark.createDataFrame([], f"p double, q double, v double, {REPORT}")
    return spark.createDataFrame([(p.p, p.q, p.v, *astuple(p.report))], f"p double, q double, v double, {REPORT}")


@register("customer_table_fitted")
def q_customer_table_fitted(spark, sf_dir):
    """The whole pipeline with both models fitted on this data."""
    plan = customer_plan(spark, sf_dir, params="fit")
    return rounded(plan.customers, money=CUSTOMER_MONEY, ratio=CUSTOMER_RATIO)


# --- purchase events: the supplied source with a time of day --------------------------

def _event_clean(spark, sf_dir):
    from ledgerlens.sources.tables import event_transactions
    return C.tx_clean(event_transactions(spark, sf_dir))


@register("event_rfm_metrics")
def q_event_rfm_metrics(spark, sf_dir):
    """Recency in floored 24-hour periods on timestamps with a time of day."""
    from ledgerlens.operators import rfm as RFM
    return rounded(RFM.rfm_metrics(_event_clean(spark, sf_dir)), money=["Monetary"])


@register("event_purchase_summary")
def q_event_purchase_summary(spark, sf_dir):
    from ledgerlens.operators.summary import purchase_summary
    return rounded(purchase_summary(_event_clean(spark, sf_dir)), ratio=["monetary_value"])
