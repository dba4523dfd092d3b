"""The pre-aggregate that the customer base and the engineered features share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = "lines"
ORDER = "_order"  # key of the invoice that lines may carry, and that they lie by


def visits(clean: DataFrame) -> DataFrame:
    """One row per (customer, invoice, time) with the sums of TotalPrice and
    Quantity and the number of lines. Summary, RFM, first purchases, gaps and
    invoice totals are the same on these rows as on the lines."""
    keys = [c for c in ("CustomerID", "InvoiceNo", "InvoiceDate", ORDER) if c in clean.columns]
    return clean.groupBy(*keys).agg(
        F.sum("TotalPrice").alias("TotalPrice"), F.sum("Quantity").alias("Quantity"), F.count(F.lit(1)).alias(LINES)).drop(ORDER)


def line_count(rows: DataFrame) -> Column:
    """Lines that a row stands for: of visits, or 1 of lines themselves."""
    return F.col(LINES) if LINES in rows.columns else F.lit(1)


def products(clean: DataFrame) -> DataFrame:
    """Distinct products per customer, counted from distinct rows."""
    pairs = clean.select("CustomerID", "StockCode").distinct()
    return pairs.groupBy("CustomerID").agg(F.count("StockCode").alias("category_count"))
