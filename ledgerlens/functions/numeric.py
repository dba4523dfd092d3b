"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column | str, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same IEEE operations in every engine,
    so two engines given the same double round it the same way."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return (F.floor(col * scale + 0.5) / scale).cast("double")


def safe_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den when den > 0, else ``default``."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))
