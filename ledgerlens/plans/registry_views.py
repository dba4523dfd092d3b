"""Registered views over the customer table, scenario and insight queries."""

from __future__ import annotations

from ledgerlens.operators import insights as IN
from ledgerlens.operators import scenario as SC
from ledgerlens.operators import views as V
from ledgerlens.plans.common import customer_plan, rounded
from ledgerlens.plans.registry import CUSTOMER_MONEY, CUSTOMER_RATIO, register

BOX_MONEY = ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"]


def _c(spark, sf_dir):
    return customer_plan(spark, sf_dir).customers


@register("segment_rfm_means")
def q_segment_rfm_means(spark, sf_dir):
    return rounded(V.segment_rfm_means(_c(spark, sf_dir)), ratio=["Recency", "Frequency", "Monetary"])


@register("segment_clv_mean")
def q_segment_clv_mean(spark, sf_dir):
    return rounded(V.segment_clv_mean(_c(spark, sf_dir)), money=["predicted_clv"])


@register("segment_clv_sum")
def q_segment_clv_sum(spark, sf_dir):
    return rounded(V.segment_clv_sum(_c(spark, sf_dir)), money=["predicted_clv"])


@register("segment_value_share")
def q_segment_value_share(spark, sf_dir):
    return rounded(V.segment_value_share(_c(spark, sf_dir)), money=["predicted_clv"], ratio=["percent"])


@register("kpis")
def q_kpis(spark, sf_dir):
    return rounded(V.kpis(_c(spark, sf_dir)), money=["total_clv", "avg_clv_positive"],
                   ratio=["avg_prob_alive_positive"])


@register("top_segment")
def q_top_segment(spark, sf_dir):
    return rounded(V.top_segment(_c(spark, sf_dir)), money=["top_segment_clv"], ratio=["top_segment_pct"])


@register("at_risk_value")
def q_at_risk_value(spark, sf_dir):
    return rounded(V.at_risk_value(_c(spark, sf_dir)), money=["at_risk_clv", "avg_at_risk_clv", "recovery_value"],
                   ratio=["at_risk_pct"])


@register("driver_effects")
def q_driver_effects(spark, sf_dir):
    return rounded(V.driver_effects(_c(spark, sf_dir)),
                   money=["early_avg_clv", "late_avg_clv", "diverse_avg_clv", "limited_avg_clv"],
                   ratio=["early_impact_pct", "diversity_impact_pct"], digits_ratio=3)


@register("second_purchase_rate")
def q_second_purchase_rate(spark, sf_dir):
    return rounded(V.second_purchase_rate(_c(spark, sf_dir)), ratio=["second_purchase_rate"])


@register("segment_profile")
def q_segment_profile(spark, sf_dir):
    return rounded(V.segment_profile(_c(spark, sf_dir)), money=["predicted_clv"],
                   ratio=["R_Score", "F_Score", "M_Score", "prob_alive", "CLV_Score", "Active_Score"])


@register("segment_prob_active")
def q_segment_prob_active(spark, sf_dir):
    return rounded(V.segment_prob_active(_c(spark, sf_dir)), ratio=["prob_alive"])


@register("positive_clv")
def q_positive_clv(spark, sf_dir):
    return rounded(V.positive_clv(_c(spark, sf_dir)), money=CUSTOMER_MONEY, ratio=CUSTOMER_RATIO)


@register("clv_histogram")
def q_clv_histogram(spark, sf_dir):
    return rounded(V.clv_histogram(_c(spark, sf_dir)), money=["bin_start", "bin_end"])


@register("clv_histogram_rounded")
def q_clv_histogram_rounded(spark, sf_dir):
    return rounded(V.clv_histogram_rounded(_c(spark, sf_dir)), money=["bin_start", "bin_end"])


@register("segment_clv_box")
def q_segment_clv_box(spark, sf_dir):
    return rounded(V.segment_clv_box(_c(spark, sf_dir)), money=BOX_MONEY)


@register("driver_bins_second_purchase")
def q_driver_bins_second_purchase(spark, sf_dir):
    return rounded(V.driver_bins(_c(spark, sf_dir), "time_to_second_purchase"), money=["predicted_clv"])


@register("driver_bins_category")
def q_driver_bins_category(spark, sf_dir):
    return rounded(V.driver_bins(_c(spark, sf_dir), "category_count"), money=["predicted_clv"])


@register("driver_values_category")
def q_driver_values_category(spark, sf_dir):
    return rounded(V.driver_bins(_c(spark, sf_dir), "category_count", binned=False), money=["predicted_clv"])


@register("driver_comparison")
def q_driver_comparison(spark, sf_dir):
    """B4 / A21 for time to second purchase."""
    return rounded(V.driver_clv_box(_c(spark, sf_dir), "time_to_second_purchase"), money=BOX_MONEY)


@register("driver_clv_box")
def q_driver_clv_box(spark, sf_dir):
    """A21 for category count."""
    return rounded(V.driver_clv_box(_c(spark, sf_dir), "category_count"), money=BOX_MONEY)


@register("segment_drilldown")
def q_segment_drilldown(spark, sf_dir):
    return rounded(V.segment_drilldown(_c(spark, sf_dir), "At Risk"), money=CUSTOMER_MONEY, ratio=CUSTOMER_RATIO)


@register("customer_detail")
def q_customer_detail(spark, sf_dir):
    return rounded(V.customer_detail(_c(spark, sf_dir)), money=["Monetary", "predicted_clv"], ratio=["prob_alive"])


@register("customer_table_query")
def q_customer_table_query(spark, sf_dir):
    q = V.customer_table_query(_c(spark, sf_dir), where="Frequency >= 2",
                               sort=(("predicted_clv", False), ("Recency", True)))
    return rounded(q, money=["Monetary", "predicted_clv"], ratio=["prob_alive"])


@register("rfm_scatter")
def q_rfm_scatter(spark, sf_dir):
    return rounded(V.rfm_scatter(_c(spark, sf_dir), "Champions"), money=["Monetary", "predicted_clv"])


@register("rfm_describe")
def q_rfm_describe(spark, sf_dir):
    return rounded(V.rfm_describe(customer_plan(spark, sf_dir).segments),
                   ratio=["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("clv_describe")
def q_clv_describe(spark, sf_dir):
    return rounded(V.rfm_describe(_c(spark, sf_dir), cols=("predicted_clv",)),
                   money=["mean", "std", "min", "p25", "p50", "p75", "max"])


@register("rfm_projection")
def q_rfm_projection(spark, sf_dir):
    from ledgerlens.sources.files import rfm_projection
    return rounded(rfm_projection(_c(spark, sf_dir)), money=["Monetary"])


@register("segment_strategies")
def q_segment_strategies(spark, sf_dir):
    return rounded(IN.segment_strategies(spark, _c(spark, sf_dir)), money=["predicted_clv"])


@register("executive_summary")
def q_executive_summary(spark, sf_dir):
    return IN.executive_summary(_c(spark, sf_dir))


def _sim(spark, sf_dir):
    return SC.scenario_clv(_c(spark, sf_dir))


@register("scenario_clv")
def q_scenario_clv(spark, sf_dir):
    return rounded(_sim(spark, sf_dir), money=["predicted_clv", "simulated_clv"],
                   ratio=["prob_alive", "sim_prob_alive", "prob_alive_factor", "value_factor"])


@register("scenario_totals")
def q_scenario_totals(spark, sf_dir):
    return rounded(SC.scenario_totals(_sim(spark, sf_dir)), money=["original_total", "simulated_total"],
                   ratio=["change_pct"])


@register("scenario_segment_share")
def q_scenario_segment_share(spark, sf_dir):
    return rounded(SC.scenario_segment_share(_sim(spark, sf_dir)), money=["predicted_clv"], ratio=["percent"])


@register("scenario_grid")
def q_scenario_grid(spark, sf_dir):
    out = SC.scenario_grid(_c(spark, sf_dir), SC.slider_grid())
    return rounded(out, money=["original_total", "simulated_total"], ratio=["change_pct"])


@register("schema_info")
def q_schema_info(spark, sf_dir):
    from ledgerlens.plans.common import clean_tx
    from ledgerlens.sources.files import schema_info
    return schema_info(clean_tx(spark, sf_dir, with_country=True))



@register("load_customer_table")
def q_load_customer_table(spark, sf_dir):
    """The customer table written as Parquet under the shared
    checkpoint folder, keyed by the state of its input files and the
    configuration, then read back through the validating loader. A user keeps
    it across applications with a folder of their own (``save_customer_table``
    and ``load_customer_table`` take any path)."""
    import hashlib
    import os

    from ledgerlens.config import DEFAULT
    from ledgerlens.session import ensure_checkpoint_dir
    from ledgerlens.sources.files import load_customer_table
    from ledgerlens.sources.tables import input_state

    key = hashlib.sha1(f"{input_state(spark, sf_dir)}|{DEFAULT}".encode()).hexdigest()[:16]
    path = os.path.join(ensure_checkpoint_dir(spark), "customer_table", key)
    df = load_customer_table(spark, path, compute=lambda: _c(spark, sf_dir))
    return rounded(df, money=CUSTOMER_MONEY, ratio=CUSTOMER_RATIO)
