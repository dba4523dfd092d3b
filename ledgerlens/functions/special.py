"""Special functions the model formulas need.

``lgamma``: log-gamma as a Column expression (Spark has no built-in), by the
Lanczos approximation (g = 7, 9 terms, relative error ~1e-15) applied at
x + 1 with lgamma(x) = lgamma(x + 1) - ln x; stays in codegen.

``digamma``: its derivative, as a Column or of a number.

``hyp2f1``: Gauss hypergeometric series 2F1(a, b; c; z) for 0 <= z < 1, as an
Arrow-batched pandas UDF. The term count depends on z, so the loop runs until
every row of the batch has converged; rows drop out of the working set as
they finish. Only this series runs in Python.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDFs below travel to the Python workers by value: executors need numpy
# and pandas, not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lanczos coefficients for g = 7 (published constants).
LANCZOS_G = 7.0
LANCZOS_COEF = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _lanczos(x: Column) -> Column:
    xm = x - 1.0
    series = F.lit(LANCZOS_COEF[0])
    for i, c in enumerate(LANCZOS_COEF[1:], start=1):
        series = series + F.lit(c) / (xm + float(i))
    t = xm + LANCZOS_G + 0.5
    return F.lit(HALF_LOG_2PI) + (xm + 0.5) * F.log(t) - t + F.log(series)


def lgamma(x: Column) -> Column:
    """ln Γ(x) for x > 0, as ln Γ(x + 1) - ln x: one branch, and the Lanczos
    sum always sees an argument >= 1. Pass a column reference, not a large
    expression: the argument appears in every term."""
    return _lanczos(x + 1.0) - F.log(x)


# B(2k) / 2k of the Bernoulli numbers, k = 1 to 7.
DIGAMMA_COEF = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)
DIGAMMA_SHIFT = 10


def digamma(x):
    """d/dx ln Γ(x) for x > 0: the asymptotic series at x + 10, where seven
    terms leave under 1e-15, and ψ(x) = ψ(x + 1) - 1/x back to x. ``x`` is a
    number or a Column; of Columns pass a reference or a short expression, as
    it appears in every term."""
    y = x + float(DIGAMMA_SHIFT)
    inverse = 1.0 / (y * y)
    series = DIGAMMA_COEF[-1] * inverse
    for c in DIGAMMA_COEF[-2::-1]:
        series = (series + c) * inverse
    out = (F.log(y) if isinstance(y, Column) else math.log(y)) - 0.5 / y - series
    for i in range(DIGAMMA_SHIFT):
        out = out - 1.0 / (x + float(i))
    return out


HYP_TOL = 1e-16
HALF = 0.5


def _series(a, b, c, z) -> np.ndarray:
    """Power series at 0 for 0 <= z <= 1/2: terms end up falling by z, so it
    ends for any parameters."""
    total, term = np.ones_like(z), np.ones_like(z)
    k = 0
    active = np.flatnonzero(z != 0.0)
    while active.size:
        aa, bb, cc, zz = a[active], b[active], c[active], z[active]
        term[active] *= (aa + k) * (bb + k) / ((cc + k) * (k + 1.0)) * zz
        total[active] += term[active]
        k += 1
        falling = np.abs((aa + k) * (bb + k) / ((cc + k) * (k + 1.0)) * zz) < 0.75
        done = (falling & (np.abs(term[active]) <= HYP_TOL * np.abs(total[active]))) | (term[active] == 0.0)
        done |= ~np.isfinite(total[active])
        active = active[~done]
    return total


def _step(a, b, c, at, w, dw, t) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope at ``at + t`` of the solution of the hypergeometric
    equation with value w and slope dw at ``at`` >= 1/2, by its Taylor series:
    t is at most half the way to 1, the nearest singular point, so terms end
    up falling by half."""
    p0, p1, q0 = at * (1 - at), 1 - 2 * at, c - (a + b + 1) * at
    # scaled coefficients u_n t^n
    u, v = w.copy(), dw * t
    value, slope = u + v, v.copy()
    n = 0
    active = np.arange(len(w))
    while active.size:
        i = active
        nxt = -((n + 1) * (p1[i] * n + q0[i]) * v[i] * t[i] - (n + a[i]) * (n + b[i]) * u[i] * t[i] ** 2) \
            / (p0[i] * (n + 2.0) * (n + 1.0))
        u[i], v[i] = v[i], nxt
        value[i] += nxt
        slope[i] += (n + 2) * nxt
        n += 1
        size = np.abs(nxt) * (n + 2) + np.abs(u[i]) * (n + 1)
        done = (size <= HYP_TOL * (np.abs(value[i]) + np.abs(slope[i]))) | ~np.isfinite(value[i])
        active = active[~done] if n > 4 else active
    return value, slope / t


def hyp2f1_numpy(a, b, c, z) -> np.ndarray:
    """2F1(a, b; c; z) for 0 <= z < 1 and c > 0. Up to 1/2 by the power
    series; beyond, the solution is carried from 1/2 towards 1 in steps of
    at most half the way, so the work grows with log(1 / (1 - z)) and the size
    of the parameters and needs no cap.
    A value outside the domain or the range of doubles is an error."""
    a, b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, c, z))
    if not np.all((z >= 0) & (z < 1)):
        raise ValueError("2F1 is evaluated for 0 <= z < 1")
    total = _series(a, b, c, np.minimum(z, HALF))
    far = np.flatnonzero(z > HALF)
    if far.size:
        at = np.full(far.size, HALF)
        w = total[far]
        dw = a[far] * b[far] / c[far] * _series(a[far] + 1, b[far] + 1, c[far] + 1, at)
        todo = np.arange(far.size)
        while todo.size:
            i = far[todo]
            x = at[todo]
            # also short against the equation's own scales, so that no term
            # outgrows the value and cancels
            pull = np.abs(c[i] - (a[i] + b[i] + 1) * x) / (x * (1 - x))
            bend = np.sqrt(np.abs(a[i] * b[i]) / (x * (1 - x)))
            t = np.minimum(np.minimum(z[i] - x, (1 - x) / 2), 3 / np.maximum(np.maximum(pull, bend), 1e-9))
            w[todo], dw[todo] = _step(a[i], b[i], c[i], at[todo], w[todo], dw[todo], t)
            last = t >= z[i] - at[todo]
            at[todo] += t
            todo = todo[~last]
        total[far] = w
    if not np.all(np.isfinite(total)):
        raise ArithmeticError("2F1 is not finite for some rows")
    return total


@F.pandas_udf(T.DoubleType())
def _hyp2f1_udf(a: pd.Series, b: pd.Series, c: pd.Series, z: pd.Series) -> pd.Series:
    return pd.Series(hyp2f1_numpy(a.to_numpy(), b.to_numpy(), c.to_numpy(), z.to_numpy()))


def hyp2f1(a: Column, b: Column, c: Column, z: Column) -> Column:
    return _hyp2f1_udf(a.cast("double"), b.cast("double"), c.cast("double"), z.cast("double"))


_HORIZON_UDFS: dict = {}


def hyp2f1_horizons(a: Column, b: Column, c: Column, base: Column, horizons) -> Column:
    """array of 2F1(a, b; c; h / (base + h)) for each fixed horizon h, from
    one UDF call (one Arrow round trip instead of one per horizon)."""
    hs = tuple(float(h) for h in horizons)
    fn = _HORIZON_UDFS.get(hs)
    if fn is None:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fn(a_: pd.Series, b_: pd.Series, c_: pd.Series, base_: pd.Series) -> pd.Series:
            av, bv, cv, basev = (s_.to_numpy(dtype=float) for s_ in (a_, b_, c_, base_))
            cols = [hyp2f1_numpy(av, bv, cv, h / (basev + h)) for h in hs]
            return pd.Series(list(np.column_stack(cols)))
        _HORIZON_UDFS[hs] = fn
    return fn(a.cast("double"), b.cast("double"), c.cast("double"), base.cast("double"))
