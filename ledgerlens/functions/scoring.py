"""Quantile scores as closed-form Column expressions (no per-row Python).

``rank_quantile_score``: the label of rank ``rn`` (1..n, distinct) when the
ranks are cut into ``q`` equal-frequency bins with right-closed edges at the
linear-interpolation quantiles of 1..n. Those edges are 1 + (n-1)·j/q, so the
label is 1 + #{j : (n-1)·j/q < rn-1} = max(1, ceil((rn-1)·q/(n-1))). This is
not ``ntile``: ntile deals remainders to the first buckets, the quantile cut
spreads them.

``edge_count_score``: reversed label of ``x`` against precomputed inner edges,
q - #{edges < x}; tied edges simply count once each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_quantile_score(rn: Column, n: Column, q: int) -> Column:
    # (rn-1)*q and n-1 are integers far below 2**53, so the double quotient is
    # correctly rounded and its ceiling is the exact integer ceiling.
    ceil_div = F.ceil(((rn - 1) * F.lit(q)) / (n - 1))
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), ceil_div)).cast("int")


def edge_count_score(x: Column, edges: Column, q: int, digits: int = 9) -> Column:
    """``edges`` is an array<double> of the q-1 inner quantiles, compared after
    rounding so float noise in the interpolation cannot flip an integer tie."""
    below = F.lit(0)
    for j in range(q - 1):  # unrolled: q is static and edges may be a subquery
        below = below + F.when(F.round(edges[j], digits) < x, 1).otherwise(0)
    return (F.lit(q) - below).cast("int")


def edges_tied(edges: Column, lo: Column, hi: Column, q: int, digits: int = 9) -> Column:
    """True when the full edge list [min, inner..., max] repeats a value
    (the reference raises in that case). Edges are sorted, so a repeat is an
    equal neighbour."""
    full = [lo.cast("double")] + [edges[j] for j in range(q - 1)] + [hi.cast("double")]
    tied = F.lit(False)
    for a, b in zip(full, full[1:]):
        tied = tied | (F.round(a, digits) == F.round(b, digits))
    return tied
