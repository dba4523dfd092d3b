"""Named queries: ``(spark, sf_dir) -> DataFrame`` for every operator of the
inventory. Outputs round doubles (money 2 decimals, ratios 6) exactly as the
oracle SQL does; the operators themselves return unrounded values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.config import FIXED_BGNBD, FIXED_GAMMA_GAMMA
from ledgerlens.operators import bgnbd as BG
from ledgerlens.operators import clean as C
from ledgerlens.operators import drivers as DR
from ledgerlens.operators import gammagamma as GG
from ledgerlens.operators import summary as SU
from ledgerlens.operators import views as V
from ledgerlens.plans.common import clean_tx, customer_plan, rounded

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _plan(spark, sf_dir):
    """The customer pipeline of ``sf_dir``, built once per session; the RFM,
    summary, driver and CLV queries are projections of it."""
    return customer_plan(spark, sf_dir)


def _segments(spark, sf_dir):
    return _plan(spark, sf_dir).segments


@register("tx_clean")
def q_tx_clean(spark, sf_dir):
    return rounded(clean_tx(spark, sf_dir, with_country=True, dirty=True), money=["UnitPrice", "TotalPrice"])


@register("rfm_metrics")
def q_rfm_metrics(spark, sf_dir):
    return rounded(_segments(spark, sf_dir).select("CustomerID", "Recency", "Frequency", "Monetary"),
                   money=["Monetary"])


@register("rfm_scores")
def q_rfm_scores(spark, sf_dir):
    return rounded(_segments(spark, sf_dir).drop("Segment"), money=["Monetary"])


@register("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return rounded(_segments(spark, sf_dir), money=["Monetary"])


@register("segment_distribution")
def q_segment_distribution(spark, sf_dir):
    return rounded(V.segment_distribution(_segments(spark, sf_dir)), ratio=["Percent"])


@register("snapshot_date")
def q_snapshot_date(spark, sf_dir):
    return C.snapshot_date(clean_tx(spark, sf_dir))


def _summary(spark, sf_dir):
    return _plan(spark, sf_dir).summary


@register("purchase_summary")
def q_purchase_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), ratio=["monetary_value"])


@register("second_purchase")
def q_second_purchase(spark, sf_dir):
    return DR.second_purchase(clean_tx(spark, sf_dir))


@register("driver_metrics")
def q_driver_metrics(spark, sf_dir):
    return _plan(spark, sf_dir).drivers


@register("bgnbd_input")
def q_bgnbd_input(spark, sf_dir):
    return rounded(SU.bgnbd_input(_summary(spark, sf_dir)), ratio=["monetary_value"])


@register("gg_input")
def q_gg_input(spark, sf_dir):
    return rounded(SU.gg_input(_summary(spark, sf_dir)), ratio=["monetary_value"])


@register("freq_monetary_corr")
def q_freq_monetary_corr(spark, sf_dir):
    return rounded(SU.freq_monetary_corr(_summary(spark, sf_dir)), ratio=["correlation"])


@register("bgnbd_prob_alive")
def q_bgnbd_prob_alive(spark, sf_dir):
    s = _summary(spark, sf_dir)
    x, t, T = F.col("frequency"), F.col("recency"), F.col("T")
    return rounded(s.select("CustomerID", BG.prob_alive(x, t, T, FIXED_BGNBD).alias("prob_alive")),
                   ratio=["prob_alive"])


@register("bgnbd_expected_purchases")
def q_bgnbd_expected_purchases(spark, sf_dir):
    horizons = (30, 90, 180, 360)
    s = BG.expected_purchases_table(_summary(spark, sf_dir), horizons, FIXED_BGNBD)
    cols = [f"expected_purchases_{h}" for h in horizons]
    return rounded(s.select("CustomerID", *cols), ratio=cols)


@register("gg_expected_value")
def q_gg_expected_value(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return rounded(s.select("CustomerID", GG.expected_average_value(
        F.col("frequency"), F.col("monetary_value"), FIXED_GAMMA_GAMMA).alias("expected_average_value")),
        money=["expected_average_value"])


@register("predict_clv")
def q_predict_clv(spark, sf_dir):
    return rounded(_plan(spark, sf_dir).clv, money=["predicted_clv"], ratio=["prob_alive", "avg_transaction_value"])


# sums of money round to cents; means of money can sit exactly on a half
# cent, so they round to 6 decimals like ratios
CUSTOMER_MONEY = ["Monetary", "predicted_clv"]
CUSTOMER_RATIO = ["prob_alive", "avg_transaction_value"]


def _customers(spark, sf_dir):
    return customer_plan(spark, sf_dir).customers


@register("customer_table")
def q_customer_table(spark, sf_dir):
    return rounded(_customers(spark, sf_dir), money=CUSTOMER_MONEY, ratio=CUSTOMER_RATIO)


def queries() -> dict[str, Query]:
    # the other registration modules add themselves to REGISTRY on import
    from ledgerlens.plans import registry_more, registry_views  # noqa: F401
    return dict(REGISTRY)
