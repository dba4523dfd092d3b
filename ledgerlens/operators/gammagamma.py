"""Gamma-Gamma model of spend per transaction (Fader & Hardie 2013)."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, Config, GammaGammaParams
from ledgerlens.functions.special import digamma, lgamma
from ledgerlens.operators.optimize import batch_objective, minimize_batched
from ledgerlens.operators.summary import gg_input
from ledgerlens.session import cut_lineage

log = logging.getLogger(__name__)


def expected_average_value(x: Column, m: Column, p: GammaGammaParams) -> Column:
    """E[M | x, m] = p (v + x m) / (p x + q - 1) (M6); the population mean
    p v / (q - 1) when x = 0."""
    return F.lit(p.p) * (F.lit(p.v) + x * m) / (F.lit(p.p) * x + F.lit(p.q - 1.0))


def _gamma_terms(x: Column, c: dict) -> Column:
    """Terms that depend on x alone, summed once per distinct x."""
    p, q = c["p"], c["q"]
    px = p * x
    return lgamma(px + q) - lgamma(px) - c["lg_q"] + q * c["log_v"] + px * F.log(x)


def _row_terms(x: Column, m: Column, c: dict) -> Column:
    p, q, v = c["p"], c["q"], c["v"]
    px = p * x
    return (px - 1.0) * F.log(m) - (px + q) * F.log(x * m + v)


def _gamma_slopes(x: Column, c: dict) -> list[Column]:
    """``_gamma_terms`` derived by p, q and v."""
    p, q, v = c["p"], c["q"], c["v"]
    both = digamma(p * x + q)
    return [x * (both - digamma(p * x) + F.log(x)), both - c["dg_q"] + c["log_v"], q / v]


def _row_slopes(x: Column, m: Column, c: dict) -> list[Column]:
    """``_row_terms`` derived by p, q and v."""
    p, q, v = c["p"], c["q"], c["v"]
    spend = x * m + v
    return [x * (F.log(m) - F.log(spend)), -F.log(spend), -(p * x + q) / spend]


def _constants(p: dict) -> dict:
    return {"lg_q": math.lgamma(p["q"]), "dg_q": digamma(p["q"]), "log_v": math.log(p["v"])}


def likelihood(per_x: DataFrame, rows: DataFrame, total: float, penalizer: float = 0.0):
    """Penalised negative mean log-likelihood of weighted rows (x, m, w) with
    its gradient, at (log p, log q, log v); ``per_x`` has the weights by x."""
    x, m = F.col("x"), F.col("m")
    return batch_objective([(per_x, lambda c: [_gamma_terms(x, c), *_gamma_slopes(x, c)]),
                            (rows, lambda c: [_row_terms(x, m, c), *_row_slopes(x, m, c)])],
                           ["p", "q", "v"], _constants, total, penalizer)


def objective(summary: DataFrame, p: GammaGammaParams, cfg: Config = DEFAULT) -> DataFrame:
    """One row: customers, mean log-likelihood and penalised objective (M2)
    of given parameters on the rows that the fit uses, in the data's own
    money."""
    given = {k: getattr(p, k) for k in ("p", "q", "v")}
    c = {k: F.lit(v) for k, v in {**given, **_constants(given)}.items()}
    x, m = F.col("x"), F.col("m")
    rows = gg_input(summary).select(F.col("frequency").alias("x"), F.col("monetary_value").alias("m"))
    out = rows.agg(F.count(F.lit(1)).alias("customers"),
                   F.avg(_gamma_terms(x, c) + _row_terms(x, m, c)).alias("mean_log_likelihood"))
    penalty = cfg.gg_penalizer * sum(v * v for v in given.values())
    return out.withColumn("objective", F.lit(penalty) - F.col("mean_log_likelihood"))


def gg_fit(summary: DataFrame, cfg: Config = DEFAULT, penalizer: float | None = None,
           max_iter: int = 60) -> GammaGammaParams | None:
    """Penalised maximum likelihood (M2) on customers with repeat purchases
    and positive spend; None when there are none. Spend is divided by its
    mean before fitting and v scaled back; q <= 1 (undefined population mean)
    is logged."""
    lam = cfg.gg_penalizer if penalizer is None else penalizer
    rows = gg_input(summary)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("monetary_value").alias("mean")).first()
    if not stats["n"]:
        log.warning("no customers with repeat purchases and positive spend: no Gamma-Gamma model")
        return None
    scale = 1.0 / stats["mean"]
    comp = rows.groupBy(F.col("frequency").alias("x"), (F.col("monetary_value") * scale).alias("m")).agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    comp = cut_lineage(comp)
    per_x = cut_lineage(comp.groupBy("x").agg(F.sum("w").alias("w")))
    th, report = minimize_batched(likelihood(per_x, comp, float(stats["n"]), lam), np.log([1.0, 1.0, 1.0]), max_iter=max_iter)
    p, q, v = np.exp(th)
    if q <= 1.0:
        log.warning("Gamma-Gamma q = %.4f <= 1: population mean spend is undefined", q)
    if report.at_bound or not report.converged:
        log.warning("Gamma-Gamma fit is no interior optimum: %s", report)
    return GammaGammaParams(float(p), float(q), float(v / scale), report)
