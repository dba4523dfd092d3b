"""Fixed-edge binning of a driver column into labelled, ordered bins.

Bins are left-closed ``[e_i, e_{i+1})`` with an open-ended last bin, so a
value above the last edge always has a bin (the reference adds ``max + 1`` as
the last edge and falls back to raw values when that breaks monotonicity).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_labels(edges, unit: str = "") -> list[str]:
    suffix = f" {unit}" if unit else ""
    labels = [f"{edges[i]}-{edges[i + 1] - 1}{suffix}" for i in range(len(edges) - 1)]
    return labels + [f">= {edges[-1]}{suffix}"]


def bin_label(x: Column, edges, unit: str = "", below_label: str | None = None) -> Column:
    """Label column; values below the first edge get ``below_label`` (null if None)."""
    labels = bin_labels(edges, unit)
    expr = F.when(x < edges[0], F.lit(below_label))
    for i in range(len(edges) - 1):
        expr = expr.when(x < edges[i + 1], F.lit(labels[i]))
    return expr.otherwise(F.lit(labels[-1]))


def bin_order(x: Column, edges) -> Column:
    """Bin index 0..len(edges)-1; -1 below the first edge."""
    expr = F.when(x < edges[0], F.lit(-1))
    for i in range(len(edges) - 1):
        expr = expr.when(x < edges[i + 1], F.lit(i))
    return expr.otherwise(F.lit(len(edges) - 1))

