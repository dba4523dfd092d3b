"""What-if re-scoring of the customer table (X1-X8) as a DataFrame transform.

Scales each customer's CLV by the change in P(alive) and in average
transaction value; no model is re-run. Row-local arithmetic plus one
aggregate for the totals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config
from ledgerlens.operators.views import segment_value_share


@dataclass(frozen=True)
class Scenario:
    reactivation_pct: float = DEFAULT.reactivation_pct       # At Risk: P(alive) up
    churn_reduction_pct: float = DEFAULT.churn_reduction_pct  # Champions: gap to 1 closed
    new_conversion_pct: float = DEFAULT.new_conversion_pct    # New Customers: CLV up
    value_boost_pct: float = DEFAULT.value_boost_pct          # Champions, At Risk: value up

    def validate(self) -> "Scenario":
        """Ranges of the reference's controls: 0-50, 0-50, 0-50, 0-20."""
        for name, hi in (("reactivation_pct", 50), ("churn_reduction_pct", 50),
                         ("new_conversion_pct", 50), ("value_boost_pct", 20)):
            v = getattr(self, name)
            if not 0 <= v <= hi:
                raise ValueError(f"{name} must be within 0..{hi}, got {v}")
        return self


def _scaled(sc: Scenario, cfg: Config):
    """(p', p factor, v factor, simulated CLV) as Column expressions."""
    seg, p, v, clv = F.col("Segment"), F.col("prob_alive"), F.col("avg_transaction_value"), F.col("predicted_clv")
    risk, champ, new = seg == "At Risk", seg == "Champions", seg == "New Customers"
    p2 = (F.when(risk, F.least(p * (1 + sc.reactivation_pct / 100.0), F.lit(cfg.at_risk_alive_cap)))
          .when(champ, F.least(p + (1 - p) * (sc.churn_reduction_pct / 100.0), F.lit(cfg.champions_alive_cap)))
          .otherwise(p))
    v2 = F.when(risk | champ, v * (1 + sc.value_boost_pct / 100.0)).otherwise(v)
    eps = cfg.epsilon
    p_factor = p2 / (p + eps)
    v_factor = v2 / (v + eps)
    sim = clv * p_factor * v_factor
    sim = F.when(new, sim * (1 + sc.new_conversion_pct / 100.0)).otherwise(sim)
    return p2, p_factor, v_factor, F.greatest(sim, F.lit(0.0))


def scenario_clv(customers: DataFrame, sc: Scenario = Scenario(), cfg: Config = DEFAULT) -> DataFrame:
    """Per customer: simulated P(alive), the scale factors and simulated CLV.

    At Risk: p' = min(p (1 + react), 0.95) (lowers p above 0.95, kept).
    Champions: p' = min(p + (1 - p) churn, 1).
    Champions and At Risk: v' = v (1 + boost).
    All rows: sim = clv * p'/(p + eps) * v'/(v + eps), so v = 0 gives 0.
    New Customers: sim * (1 + conv); then clipped at 0.
    """
    sc.validate()
    p2, p_factor, v_factor, sim = _scaled(sc, cfg)
    return customers.select(
        "CustomerID", "Segment", "predicted_clv", "prob_alive", p2.alias("sim_prob_alive"),
        p_factor.alias("prob_alive_factor"), v_factor.alias("value_factor"), sim.alias("simulated_clv"))


def scenario_totals(sim: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Original and simulated totals, percent change with epsilon, and the
    direction flag (up > 0.1, down < -0.1) (X6, A31)."""
    a = sim.agg(F.sum("predicted_clv").alias("original_total"), F.sum("simulated_clv").alias("simulated_total"))
    change = (F.col("simulated_total") - F.col("original_total")) / (F.col("original_total") + cfg.epsilon) * 100
    return a.select("original_total", "simulated_total", change.alias("change_pct")).withColumn(
        "direction", F.when(F.col("change_pct") > 0.1, "up").when(F.col("change_pct") < -0.1, "down")
        .otherwise("flat"))


def scenario_segment_share(sim: DataFrame) -> DataFrame:
    """Segment share of the simulated total."""
    return segment_value_share(sim, "simulated_clv")


def slider_grid(step: int = 10, boost_step: int = 5) -> list[Scenario]:
    """Each control swept over its range (0-50, 0-50, 0-50, 0-20) with the
    others at their defaults (X8)."""
    d = Scenario()
    out = []
    for v in range(0, 51, step):
        out.append(Scenario(v, d.churn_reduction_pct, d.new_conversion_pct, d.value_boost_pct))
    for v in range(0, 51, step):
        out.append(Scenario(d.reactivation_pct, v, d.new_conversion_pct, d.value_boost_pct))
    for v in range(0, 51, step):
        out.append(Scenario(d.reactivation_pct, d.churn_reduction_pct, v, d.value_boost_pct))
    for v in range(0, 21, boost_step):
        out.append(Scenario(d.reactivation_pct, d.churn_reduction_pct, d.new_conversion_pct, v))
    return [s.validate() for s in dict.fromkeys(out)]  # the defaults recur in the sweeps


def scenario_grid(customers: DataFrame, scenarios: list[Scenario], cfg: Config = DEFAULT) -> DataFrame:
    """Totals for many scenarios in one pass (X8): each scenario's simulated
    CLV is a column of one projection, summed by one aggregate and stacked
    into one row per scenario - no join of customers with scenarios."""
    for sc in scenarios:
        sc.validate()
    sims = [_scaled(sc, cfg)[3].alias(f"_s{i}") for i, sc in enumerate(scenarios)]
    agg = customers.select("predicted_clv", *sims).agg(
        F.sum("predicted_clv").alias("_orig"), *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(scenarios))])
    parts = ", ".join(f"{float(sc.reactivation_pct)}D, {float(sc.churn_reduction_pct)}D, "
                      f"{float(sc.new_conversion_pct)}D, {float(sc.value_boost_pct)}D, _s{i}"
                      for i, sc in enumerate(scenarios))
    stacked = agg.selectExpr("_orig", f"stack({len(scenarios)}, {parts}) AS (reactivation_pct, churn_reduction_pct, "
                                      "new_conversion_pct, value_boost_pct, simulated_total)")
    change = (F.col("simulated_total") - F.col("_orig")) / (F.col("_orig") + cfg.epsilon) * 100
    return stacked.select("reactivation_pct", "churn_reduction_pct", "new_conversion_pct", "value_boost_pct",
                          F.col("_orig").alias("original_total"), "simulated_total", change.alias("change_pct"))
