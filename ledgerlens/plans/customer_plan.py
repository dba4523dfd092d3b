"""End-to-end plans: transactions -> customer table.

The deduplicated lines are read twice: once for the visits (a row per
customer, invoice and time), written once, and once for the distinct products.
RFM metrics, purchase times, the repeat-purchase summary and the engineered
features are aggregates over the visits; their join on CustomerID is written
as the per-customer base. Ranking, model scoring and every view then work on
one row per customer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, FIXED_BGNBD, FIXED_GAMMA_GAMMA, BGNBDParams, Config, GammaGammaParams
from ledgerlens.operators import bgnbd, clv as clvmod, drivers, gammagamma, rfm, summary
from ledgerlens.operators.clean import snapshot_date
from ledgerlens.operators.visits import visits
from ledgerlens.session import cut_lineage


@dataclass
class CustomerPlan:
    """Segments, CLV and the customer table are made when first asked for, so
    that a query that needs the base alone does not rank or score."""
    base: DataFrame          # one row per customer: summary + drivers + RFM metrics + order spread
    visits: DataFrame        # one row per customer, invoice and time
    cfg: Config
    bg: BGNBDParams | None
    gg: GammaGammaParams | None
    rules: str = "code"
    keep: Callable[[DataFrame], DataFrame] = lambda df: df  # how the customer table is kept

    @property
    def summary(self) -> DataFrame:
        """Repeat-purchase summary."""
        return self.base.select("CustomerID", *SUMMARY_COLS)

    @property
    def drivers(self) -> DataFrame:
        return self.base.select("CustomerID", *DRIVER_COLS)

    @property
    def order_spread(self) -> DataFrame:
        """Deviation of the invoices' sums (customers with Monetary > 0)."""
        return self.base.select("CustomerID", rfm.SPREAD)

    @cached_property
    def segments(self) -> DataFrame:
        """RFM scores and segment (customers with Monetary > 0)."""
        metrics = self.base.filter(F.col("rfm_Monetary").isNotNull()).select(
            "CustomerID", *[F.col(f"rfm_{c}").alias(c) for c in RFM_COLS])
        return rfm.rfm_scores(metrics, self.cfg).withColumn("Segment", rfm.segment_of(
            F.col("R_Score"), F.col("F_Score"), F.col("M_Score"), self.cfg.rfm_quantiles, self.rules))

    @property
    def clv(self) -> DataFrame:
        """predicted_clv, prob_alive, avg_transaction_value."""
        return clvmod.clv_scores(self.summary, self.bg, self.gg, self.cfg)

    @cached_property
    def customers(self) -> DataFrame:
        """The combined customer table."""
        return self.keep(clvmod.customer_table(self.segments, self.clv, self.drivers).withColumn(
            "snapshot_date", self.base.agg(F.max("snapshot_date")).scalar()))

    def scored(self, bg: BGNBDParams | None, gg: GammaGammaParams | None) -> CustomerPlan:
        """The same customers and segments under other parameters."""
        out = replace(self, bg=bg, gg=gg)
        out.segments = self.segments
        return out


SUMMARY_COLS = ["frequency", "recency", "T", "monetary_value"]
DRIVER_COLS = ["time_to_second_purchase", "category_count"]
RFM_COLS = ["Recency", "Frequency", "Monetary"]


def customer_base(clean: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per customer from the visits, already written, and the distinct
    products of the lines."""
    snap = snapshot_date(seen)
    base = (summary.purchase_summary(seen)
            .join(drivers.driver_metrics(clean, seen=seen), "CustomerID", "inner")
            # Spark resolves names case-insensitively: Frequency would clash
            # with the summary's frequency inside one table
            .join(rfm.rfm_metrics(seen, snap, spread=True).select(
                "CustomerID", *[F.col(c).alias(f"rfm_{c}") for c in RFM_COLS], rfm.SPREAD), "CustomerID", "left")
            .withColumn("snapshot_date", snap.select("snapshot_date").scalar()))
    return cut_lineage(base)


def build_customer_plan(clean: DataFrame, cfg: Config = DEFAULT, params: str = "fixed",
                        bg: BGNBDParams | None = None, gg: GammaGammaParams | None = None,
                        rules: str = "code", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> CustomerPlan:
    """``params="fixed"`` scores with the parameters passed, or the fixed
    published ones when none are; ``params="fit"`` fits both models on this
    data first. A missing spend model (gg None) gives CLV 0, as in the
    reference."""
    seen = cut_lineage(visits(clean))
    base = customer_base(clean, seen)
    if params == "fit":
        summ = base.select("CustomerID", *SUMMARY_COLS)
        bg, gg = bgnbd.bgnbd_fit(summ, cfg), gammagamma.gg_fit(summ, cfg)
    elif bg is None and gg is None:
        bg, gg = FIXED_BGNBD, FIXED_GAMMA_GAMMA
    return CustomerPlan(base, seen, cfg, bg, gg, rules, keep)
