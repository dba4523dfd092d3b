"""BG/NBD model (Fader, Hardie & Lee 2005): probability of being active,
expected purchases, and the penalised maximum-likelihood fit.

Scoring is pure Column arithmetic except the Gauss hypergeometric series.
The expectation uses Euler's transformation of 2F1, which turns
((a+T)/(a+T+h))^(r+x) * 2F1(r+x, b+x; a+b+x-1; z) into
(1-z)^(a-1) * 2F1(a+b-1-r, a-1; a+b+x-1; z), z = h / (alpha+T+h): the upper
parameters no longer grow with x, so the series converges fast for heavy
buyers.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT, BGNBDParams, Config
from ledgerlens.functions.special import digamma, hyp2f1, hyp2f1_horizons, lgamma
from ledgerlens.operators.optimize import batch_objective, minimize_batched
from ledgerlens.operators.summary import bgnbd_input
from ledgerlens.session import cut_lineage

log = logging.getLogger(__name__)


def _nudged(p: BGNBDParams) -> BGNBDParams:
    # a = 1 is a removable singularity of the expectation
    if abs(p.a - 1.0) < 1e-7:
        return BGNBDParams(p.r, p.alpha, 1.0 + 1e-7, p.b)
    return p


def prob_alive(x: Column, t: Column, T: Column, p: BGNBDParams) -> Column:
    """P(alive | x, t, T) (M3); 1 for customers without repeat purchases."""
    log_div = (F.lit(p.r) + x) * F.log((F.lit(p.alpha) + T) / (F.lit(p.alpha) + t)) + F.log(
        F.lit(p.a) / (F.lit(p.b) + F.greatest(x, F.lit(1.0)) - 1.0))
    return F.when(x == 0, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(log_div)))


def expected_purchases(h, x: Column, t: Column, T: Column, p: BGNBDParams) -> Column:
    """E[purchases in the next h periods | x, t, T] (M5)."""
    p = _nudged(p)
    h = F.lit(float(h)) if not isinstance(h, Column) else h
    z = h / (F.lit(p.alpha) + T + h)
    c = F.lit(p.a + p.b - 1.0) + x
    hyp = hyp2f1(F.lit(p.a + p.b - 1.0 - p.r), F.lit(p.a - 1.0), c, z)
    first = c / (p.a - 1.0)
    second = 1.0 - F.pow(1.0 - z, F.lit(p.a - 1.0)) * hyp
    return F.when(h == 0, F.lit(0.0)).otherwise(first * second * prob_alive(x, t, T, p))


def expected_purchases_many(df: DataFrame, horizons, x: Column, t: Column, T: Column, p: BGNBDParams,
                            names) -> DataFrame:
    """``expected_purchases`` for several fixed horizons, the series of all
    of them computed in one UDF call; adds one column per name."""
    p = _nudged(p)
    base = F.lit(p.alpha) + T
    c = F.lit(p.a + p.b - 1.0) + x
    out = df.withColumn("_hyp", hyp2f1_horizons(F.lit(p.a + p.b - 1.0 - p.r), F.lit(p.a - 1.0), c, base, horizons))
    alive = prob_alive(x, t, T, p)
    for i, (h, name) in enumerate(zip(horizons, names)):
        z = F.lit(float(h)) / (base + float(h))
        val = c / (p.a - 1.0) * (1.0 - F.pow(1.0 - z, F.lit(p.a - 1.0)) * F.element_at("_hyp", i + 1)) * alive
        out = out.withColumn(name, F.lit(0.0) if h == 0 else val)
    return out.drop("_hyp")


def expected_purchases_table(summary: DataFrame, horizons, p: BGNBDParams,
                             unit: float = 1.0, suffix: str = "") -> DataFrame:
    """One column ``expected_purchases_<h>`` per horizon (in periods of
    ``unit`` summary days)."""
    x, t, T = F.col("frequency"), F.col("recency") / unit, F.col("T") / unit
    return expected_purchases_many(summary, horizons, x, t, T, p,
                                   [f"expected_purchases_{h}{suffix}" for h in horizons])


# --- fitting -------------------------------------------------------------------

def _gamma_terms(x: Column, c: dict) -> Column:
    """The log-likelihood terms that depend on x alone (log-gammas), summed
    once per distinct x. Parameter columns ``c``: r, a, b and the constants
    lg_r, lg_b, lg_ab, log_alpha."""
    r, a, b = c["r"], c["a"], c["b"]
    return (lgamma(r + x) - c["lg_r"] + r * c["log_alpha"]
            + c["lg_ab"] + lgamma(b + x) - c["lg_b"] - lgamma(a + b + x))


def _gamma_slopes(x: Column, c: dict) -> list[Column]:
    """``_gamma_terms`` derived by r, alpha, a and b."""
    r, alpha, a, b = c["r"], c["alpha"], c["a"], c["b"]
    dropped = c["dg_ab"] - digamma(a + b + x)
    return [digamma(r + x) - c["dg_r"] + c["log_alpha"], r / alpha, dropped, dropped + digamma(b + x) - c["dg_b"]]


def _active_and_dropped(x: Column, t: Column, T: Column, c: dict) -> tuple[Column, Column]:
    """Log-likelihoods of still being active and of having dropped out after
    the last purchase (null without repeat purchases)."""
    r, alpha, b = c["r"], c["alpha"], c["b"]
    return -(r + x) * F.log(alpha + T), F.when(x > 0, c["log_a"] - F.log(b + x - 1.0) - (r + x) * F.log(alpha + t))


def _row_terms(x: Column, t: Column, T: Column, c: dict) -> Column:
    """The terms that need (x, t, T): logs and exps only."""
    A3, A4 = _active_and_dropped(x, t, T, c)
    m = F.greatest(A3, F.coalesce(A4, A3))
    return m + F.log(F.exp(A3 - m) + F.coalesce(F.exp(A4 - m), F.lit(0.0)))


def _row_slopes(x: Column, t: Column, T: Column, c: dict) -> list[Column]:
    """``_row_terms`` derived by r, alpha, a and b: both cases weighted by
    their shares of the likelihood."""
    r, alpha, a, b = c["r"], c["alpha"], c["a"], c["b"]
    A3, A4 = _active_and_dropped(x, t, T, c)
    gone = F.coalesce(1.0 / (1.0 + F.exp(A3 - A4)), F.lit(0.0))
    return [-(1.0 - gone) * F.log(alpha + T) - gone * F.log(alpha + t),
            -(r + x) * ((1.0 - gone) / (alpha + T) + gone / (alpha + t)),
            gone / a,
            F.when(x > 0, -gone / (b + x - 1.0)).otherwise(F.lit(0.0))]


def _constants(p: dict) -> dict:
    return {"lg_r": math.lgamma(p["r"]), "lg_b": math.lgamma(p["b"]), "lg_ab": math.lgamma(p["a"] + p["b"]),
            "dg_r": digamma(p["r"]), "dg_b": digamma(p["b"]), "dg_ab": digamma(p["a"] + p["b"]),
            "log_alpha": math.log(p["alpha"]), "log_a": math.log(p["a"])}


def likelihood(per_x: DataFrame, rows: DataFrame, total: float, penalizer: float = 0.0):
    """Penalised negative mean log-likelihood of weighted rows (fx, ft, fage,
    w) with its gradient, at (log r, log alpha, log a, log b); ``per_x`` has
    the weights by fx alone."""
    x, t, T = F.col("fx"), F.col("ft"), F.col("fage")
    return batch_objective([(per_x, lambda c: [_gamma_terms(x, c), *_gamma_slopes(x, c)]),
                            (rows, lambda c: [_row_terms(x, t, T, c), *_row_slopes(x, t, T, c)])],
                           ["r", "alpha", "a", "b"], _constants, total, penalizer)


def objective(summary: DataFrame, p: BGNBDParams, cfg: Config = DEFAULT) -> DataFrame:
    """One row: customers, mean log-likelihood and penalised objective (M1)
    of given parameters on the rows that the fit uses, in the data's own days."""
    given = {k: getattr(p, k) for k in ("r", "alpha", "a", "b")}
    c = {k: F.lit(v) for k, v in {**given, **_constants(given)}.items()}
    x, t, T = F.col("x"), F.col("t"), F.col("age")
    rows = bgnbd_input(summary, cfg.fit_all).select(
        F.col("frequency").alias("x"), F.col("recency").alias("t"), F.col("T").alias("age"))
    out = rows.agg(F.count(F.lit(1)).alias("customers"),
                   F.avg(_gamma_terms(x, c) + _row_terms(x, t, T, c)).alias("mean_log_likelihood"))
    penalty = cfg.bgnbd_penalizer * sum(v * v for v in given.values())
    return out.withColumn("objective", F.lit(penalty) - F.col("mean_log_likelihood"))


def bgnbd_fit(summary: DataFrame, cfg: Config = DEFAULT, penalizer: float | None = None,
              fit_all: bool | None = None, max_iter: int = 60) -> BGNBDParams:
    """Penalised maximum likelihood (M1): minimise -mean(LL) + lambda * sum(theta^2)
    over log-parameters, with T rescaled to max 10 (alpha scaled back).
    Customers sharing (x, t, T) are one weighted row; the log-gamma terms are
    evaluated once per distinct x; gradients are exact."""
    lam = cfg.bgnbd_penalizer if penalizer is None else penalizer
    rows = bgnbd_input(summary, cfg.fit_all if fit_all is None else fit_all)
    t_max = rows.agg(F.max("T")).first()[0]
    if t_max is None:
        raise ValueError("no customers to fit the BG/NBD model on")
    scale = 10.0 / t_max if t_max > 0 else 1.0
    # names differ beyond case: Spark resolves t and T to the same column
    comp = rows.groupBy(
        F.col("frequency").alias("fx"), (F.col("recency") * scale).alias("ft"), (F.col("T") * scale).alias("fage")
    ).agg(F.count(F.lit(1)).cast("double").alias("w"))
    comp = cut_lineage(comp)
    per_x = cut_lineage(comp.groupBy("fx").agg(F.sum("w").alias("w")))
    n = comp.agg(F.sum("w")).first()[0]
    th, report = minimize_batched(likelihood(per_x, comp, n, lam), np.log([1.0, 1.0, 1.0, 1.0]), max_iter=max_iter)
    r, al, a, b = np.exp(th)
    if report.at_bound or not report.converged:
        log.warning("BG/NBD fit is no interior optimum: %s", report)
    return BGNBDParams(float(r), float(al / scale), float(a), float(b), report)
