"""Minimise an objective whose evaluation is one distributed aggregate.

``evaluate(points) -> (values, gradients)`` evaluates many parameter vectors
in a single Spark job, so each step of the loop costs one pass over the
(compressed) data. Only the parameter vectors, values and gradients (a few
dozen floats) live on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from ledgerlens.config import FitReport

STEPS = (16.0, 4.0, 2.0, 1.0, 0.5, 0.1, 0.01)  # line-search step sizes, all in one job


def minimize_batched(evaluate: Callable[[Sequence[np.ndarray]], tuple[np.ndarray, np.ndarray]], x0,
                     max_iter: int = 60, gtol: float = 1e-6, ftol: float = 1e-11,
                     bounds: tuple[float, float] = (-25.0, 12.0)):
    """Quasi-Newton (BFGS) descent inside a box. All steps of a line search
    are evaluated with their gradients in one call, so an iteration is one
    pass. A slope that points out of the box counts as none. Returns
    (x, FitReport)."""
    lo, hi = bounds
    x = np.clip(np.asarray(x0, dtype=float), lo, hi)
    k = x.size

    def inner(x, g):
        """The gradient without what the box does not let down."""
        return np.where(((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0)), 0.0, g)

    values, gradients = evaluate([x])
    f, g = values[0], inner(x, gradients[0])
    H, fresh, short = np.eye(k), True, 1.0
    it, converged = 0, False
    for it in range(1, max_iter + 1):
        if not np.all(np.isfinite(g)):
            break
        if np.linalg.norm(g, np.inf) < gtol:
            converged = True
            break
        d = -H @ g
        if g @ d >= 0:  # not a descent direction: reset the curvature
            H, fresh = np.eye(k), True
            d = -g
        points = [np.clip(x + short * step * d, lo, hi) for step in STEPS]
        values, gradients = evaluate(points)
        usable = np.isfinite(values) & np.isfinite(gradients).all(axis=1)
        best = int(np.argmin(np.where(usable, values, np.inf)))
        if not usable[best] or values[best] >= f:
            if not fresh:
                H, fresh = np.eye(k), True
                continue
            # a steep slope: shorter steps, until they no longer move x
            short *= STEPS[-1] / STEPS[0]
            if short * np.linalg.norm(d, np.inf) < 1e-13:
                converged = True
                break
            continue
        x_new, f_new, g_new = points[best], values[best], inner(points[best], gradients[best])
        s, y, short = x_new - x, g_new - g, 1.0
        sy = s @ y
        if sy > 1e-14:
            if fresh:  # the size of the first curvature
                H = np.eye(k) * (sy / (y @ y))
            eye = np.eye(k)
            H = (eye - np.outer(s, y) / sy) @ H @ (eye - np.outer(y, s) / sy) + np.outer(s, s) / sy
            fresh = False
        done = abs(f - f_new) <= ftol * max(1.0, abs(f))
        x, f, g = x_new, f_new, g_new
        if done:
            converged = True
            break
    at_bound = bool(np.any((x <= lo + 1e-9) | (x >= hi - 1e-9)))
    return x, FitReport(converged, at_bound, it, float(f), float(np.linalg.norm(g, np.inf)))


def batch_objective(parts, names, constants, total: float, penalizer: float = 0.0):
    """``evaluate`` for ``minimize_batched``: the penalised negative mean
    log-likelihood, and its gradient, at log-parameters. ``parts`` is a list
    of ``(table, terms)``: ``terms(c)`` gives the log-likelihood of a row of
    the table (weight column ``w``) and its derivative by each of ``names``.
    All are summed per candidate in one aggregate; the parts are unioned and
    summed in the same query and divided by ``total``.

    The candidates (at most one per step size: seven) travel as a broadcast
    table of that many rows. Parameters are data, not literals, so the
    generated code is the same at every step and compiles once.
    ``constants(params) -> dict`` adds per-candidate scalars computed on the
    driver (e.g. log-gamma of a parameter); ``terms`` builds the per-row
    Columns from parameter and constant columns. A candidate without a finite
    sum has the value infinity."""
    from pyspark.sql import functions as F

    spark = parts[0][0].sparkSession
    sums = ["_value", *[f"_d_{n}" for n in names]]
    built: dict = {}  # the per-row Columns name parameters only: build them once

    def evaluate(points):
        rows, cols = [], None
        for i, th in enumerate(points):
            vals = dict(zip(names, (float(v) for v in np.exp(th))))
            vals.update(constants(vals))
            cols = list(vals)
            rows.append((i, *[float(vals[c]) for c in cols]))
        if not built:
            built["schema"] = ", ".join(["_k int"] + [f"{c} double" for c in cols])
            built["aggs"] = [[F.sum(F.col("w") * term).alias(s) for term, s in zip(terms({c: F.col(c) for c in cols}), sums, strict=True)]
                             for _, terms in parts]
        params = F.broadcast(spark.createDataFrame(rows, built["schema"]))
        both = None
        for (table, _), aggs in zip(parts, built["aggs"]):
            # one row per candidate vector (at most seven) against every table row
            part = table.crossJoin(params).groupBy("_k").agg(*aggs)
            both = part if both is None else both.unionByName(part)
        got = {r["_k"]: r for r in both.groupBy("_k").agg(*[F.sum(s).alias(s) for s in sums]).collect()}
        values, gradients = np.full(len(points), np.inf), np.zeros((len(points), len(names)))
        for i, th in enumerate(points):
            ll = np.array([np.nan if i not in got or got[i][s] is None else got[i][s] for s in sums]) / total
            size = np.exp(th)
            value = penalizer * float(size @ size) - ll[0]
            if np.isfinite(value):  # d/d(log p) = p d/dp
                values[i], gradients[i] = value, size * (2.0 * penalizer * size - ll[1:])
        return values, gradients
    return evaluate
