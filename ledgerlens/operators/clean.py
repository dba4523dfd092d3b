"""Normalisation, cleaning rules, deduplication and cleaning diagnostics.

All of these are single-pass filters or aggregates with map-side partial
aggregation, so a hot customer or a hot group of copies never lands whole in
one task: ``dropDuplicates`` combines copies inside each map task before the
exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import plus_days
from pyspark.sql.types import NumericType

from ledgerlens.schema import require_columns


def tx_normalized(df: DataFrame) -> DataFrame:
    """InvoiceDate as timestamp (P1), CustomerID as text without a float
    suffix (P3), TotalPrice = Quantity * UnitPrice (P2)."""
    require_columns(df, ["InvoiceNo", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"], "transactions")
    types = dict(df.dtypes)
    out = df
    if types["InvoiceDate"] == "string":
        out = out.withColumn("InvoiceDate", F.to_timestamp_ntz(F.col("InvoiceDate")))
    if isinstance(df.schema["CustomerID"].dataType, NumericType):
        out = out.withColumn("CustomerID", F.col("CustomerID").cast("bigint").cast("string"))
    return out.withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice"))


def _rules(df: DataFrame):
    has_customer = F.col("CustomerID").isNotNull()
    positive_qty = F.col("Quantity") > 0
    positive_price = F.col("UnitPrice") > 0
    return has_customer, positive_qty, positive_price


def tx_filtered(df: DataFrame) -> DataFrame:
    """F1-F3 without the dedupe."""
    n = tx_normalized(df)
    c, q, p = _rules(n)
    return n.filter(c & q & p)


def tx_clean(df: DataFrame) -> DataFrame:
    """Known customer (F1), positive quantity (F2), positive price (F3), then
    exact duplicates dropped over every column (D1)."""
    return tx_filtered(df).dropDuplicates()


def snapshot_date(clean: DataFrame) -> DataFrame:
    """One row: max(InvoiceDate) + 1 day (A4), and the max itself."""
    return clean.agg(F.max("InvoiceDate").alias("max_date")).select(
        plus_days(F.col("max_date"), 1).alias("snapshot_date"), "max_date")


def cleaning_audit(df: DataFrame) -> DataFrame:
    """Row counts after each cleaning step and rows removed (D4), as one row.
    One scan: equal rows are counted together (combined map-side), then the
    counts are summed by condition."""
    n = tx_normalized(df)
    once = n.groupBy(*n.columns).agg(F.count(F.lit(1)).alias("_copies"))
    c, q, p = _rules(once)
    copies = F.col("_copies")
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, copies)), F.lit(0).cast("bigint"))
    out = once.agg(
        F.coalesce(F.sum(copies), F.lit(0).cast("bigint")).alias("raw_rows"),
        rows(c).alias("rows_with_customer"),
        rows(c & q).alias("rows_positive_quantity"),
        rows(c & q & p).alias("rows_positive_price"),
        F.count_if(c & q & p).alias("clean_rows"),
    )
    return out.select(
        "raw_rows", "rows_with_customer", "rows_positive_quantity", "rows_positive_price", "clean_rows",
        (F.col("raw_rows") - F.col("rows_with_customer")).alias("removed_missing_customer"),
        (F.col("rows_with_customer") - F.col("rows_positive_quantity")).alias("removed_nonpositive_quantity"),
        (F.col("rows_positive_quantity") - F.col("rows_positive_price")).alias("removed_nonpositive_price"),
        (F.col("rows_positive_price") - F.col("clean_rows")).alias("removed_duplicates"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column (A29) as (column, null_count), one pass."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return agg.selectExpr(f"stack({len(df.columns)}, {stacked}) AS (column, null_count)")


def _with_customer(df: DataFrame) -> DataFrame:
    return tx_normalized(df).filter(F.col("CustomerID").isNotNull())


def returns_lines(df: DataFrame) -> DataFrame:
    """Lines with negative quantity among lines with a customer."""
    return _with_customer(df).agg(F.count_if(F.col("Quantity") < 0).alias("return_lines"))


def zero_price_lines(df: DataFrame) -> DataFrame:
    """Lines with zero unit price among lines with a customer."""
    return _with_customer(df).agg(F.count_if(F.col("UnitPrice") == 0).alias("zero_price_lines"))


def cancelled_lines(df: DataFrame) -> DataFrame:
    """Lines of cancelled invoices (``C`` prefix) among lines with a customer
    (F15), and distinct cancelled invoices."""
    w = _with_customer(df)
    cancelled = F.col("InvoiceNo").startswith("C")
    return w.agg(F.count_if(cancelled).alias("cancelled_lines"),
                 F.count_distinct(F.when(cancelled, F.col("InvoiceNo"))).alias("cancelled_invoices"))


def tx_clean_appendix(df: DataFrame) -> DataFrame:
    """Appendix cleaning: known customer, positive quantity, not a cancelled
    invoice; no price rule and no dedupe (F15 negation)."""
    w = _with_customer(df)
    return w.filter((F.col("Quantity") > 0) & ~F.col("InvoiceNo").startswith("C"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row, over all columns (D3):
    sum over distinct rows of (copies - 1), with partial aggregation."""
    w = _with_customer(df)
    copies = w.groupBy(*w.columns).count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def _fences(w: DataFrame, columns) -> dict:
    """Tukey fences (lo, hi) of each column from exact quartiles: one stacked
    run of distributed ranks, two numbers a column; null without values."""
    from ledgerlens.operators.ordered import quantile_values

    def bound(quartiles):
        if None in quartiles:
            return F.lit(None).cast("double"), F.lit(None).cast("double")
        q1, q3 = quartiles
        return F.lit(q1 - 1.5 * (q3 - q1)), F.lit(q3 + 1.5 * (q3 - q1))
    return {c: bound(q) for c, q in quantile_values(w, columns, [0.25, 0.75]).items()}


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows outside the Tukey fences of ``column`` (F16), with the bounds."""
    w = _with_customer(df)
    lo, hi = _fences(w, [column])[column]
    return w.withColumn("lower_bound", lo).withColumn("upper_bound", hi) \
        .filter((F.col(column) < lo) | (F.col(column) > hi))


def iqr_summary(df: DataFrame) -> DataFrame:
    """Fences and outlier counts for Quantity and UnitPrice in one row."""
    w = _with_customer(df)
    fences = _fences(w, ["Quantity", "UnitPrice"])
    (q_lo, q_hi), (p_lo, p_hi) = fences["Quantity"], fences["UnitPrice"]
    counts = w.agg(F.count_if((F.col("Quantity") < q_lo) | (F.col("Quantity") > q_hi)).alias("quantity_outliers"),
                   F.count_if((F.col("UnitPrice") < p_lo) | (F.col("UnitPrice") > p_hi)).alias("price_outliers"))
    return counts.select(q_lo.alias("quantity_lower"), q_hi.alias("quantity_upper"),
                         p_lo.alias("price_lower"), p_hi.alias("price_upper"),
                         "quantity_outliers", "price_outliers")


def bulk_and_pricey(df: DataFrame, max_quantity: float = 10_000, max_price: float = 500) -> DataFrame:
    """Flag (not remove) bulk lines and very expensive items."""
    return tx_normalized(df).withColumn("is_bulk", F.col("Quantity") > max_quantity) \
        .withColumn("is_pricey", F.col("UnitPrice") > max_price)


def distinct_customers(clean: DataFrame) -> DataFrame:
    """Distinct customers (D2), exact."""
    return clean.agg(F.count_distinct("CustomerID").alias("customers"))

