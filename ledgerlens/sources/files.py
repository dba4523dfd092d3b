"""File sources and sinks: raw transactions in, the customer table out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import CUSTOMER_REQUIRED, RAW_TX, RFM_COLUMNS


def load_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema=RAW_TX, **options) -> DataFrame:
    """Read raw invoice lines (S1). No spreadsheet reader exists in Spark:
    convert outside and read Parquet or CSV with an explicit schema."""
    reader = spark.read.options(**options)
    try:
        if fmt == "csv":
            df = reader.schema(schema).option("header", options.get("header", "true")).csv(path)
        elif fmt == "parquet":
            df = reader.parquet(path)
        else:
            df = reader.format(fmt).load(path)
        df.schema  # resolve now so a missing path fails here
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"Data file not found at {path}") from e
        raise
    return df


def save_customer_table(df: DataFrame, path: str) -> None:
    """Write the customer table (S3/S4). The snapshot date travels as a
    column of the table instead of a side file."""
    df.write.mode("overwrite").parquet(path)


def load_customer_table(spark: SparkSession, path: str,
                        compute: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Cached read with validation (S5): non-empty, snapshot present, required
    columns present; otherwise recompute, write, and re-read."""
    try:
        df = spark.read.parquet(path)
        ok = all(c in df.columns for c in CUSTOMER_REQUIRED + ["snapshot_date"]) and not df.isEmpty()
    except AnalysisException:
        ok = False
    if ok:
        return df
    if compute is None:
        raise FileNotFoundError(f"no valid customer table at {path}")
    save_customer_table(compute(), path)
    return spark.read.parquet(path)


def rfm_projection(df: DataFrame) -> DataFrame:
    """The RFM columns that exist."""
    return df.select(*[c for c in RFM_COLUMNS if c in df.columns])


def segment_rows(df: DataFrame, segment: str | None = None) -> DataFrame:
    """Every row (of one segment) as a JSON object in the column ``json``
    (S9); the caller writes it or pages through it by key."""
    rows = df if segment is None else df.filter(F.col("Segment") == segment)
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def schema_info(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count (S11), in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = counts.selectExpr(f"stack({len(df.columns)}, {stacked}) AS (column, non_null)")
    type_map = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return out.select("column", type_map[F.col("column")].alias("dtype"),
                      F.col("non_null").cast("bigint").alias("non_null"))
