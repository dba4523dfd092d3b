"""Explicit schemas of the tables the operators exchange, and boundary checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RAW_TX = T.StructType([
    T.StructField("InvoiceNo", T.StringType(), False),
    T.StructField("StockCode", T.StringType(), True),
    T.StructField("Description", T.StringType(), True),
    T.StructField("Quantity", T.DoubleType(), False),
    T.StructField("InvoiceDate", T.TimestampNTZType(), False),
    T.StructField("UnitPrice", T.DoubleType(), False),
    T.StructField("CustomerID", T.StringType(), True),
    T.StructField("Country", T.StringType(), True),
])

DRIVERS = T.StructType([
    T.StructField("CustomerID", T.StringType(), False),
    T.StructField("time_to_second_purchase", T.DoubleType(), False),
    T.StructField("category_count", T.LongType(), False),
])

RFM = T.StructType([
    T.StructField("CustomerID", T.StringType(), False),
    T.StructField("Recency", T.LongType(), False),
    T.StructField("Frequency", T.LongType(), False),
    T.StructField("Monetary", T.DoubleType(), False),
    T.StructField("R_Score", T.IntegerType(), False),
    T.StructField("F_Score", T.IntegerType(), False),
    T.StructField("M_Score", T.IntegerType(), False),
    T.StructField("RFM_Score", T.StringType(), False),
    T.StructField("Segment", T.StringType(), False),
])

SUMMARY = T.StructType([
    T.StructField("CustomerID", T.StringType(), False),
    T.StructField("frequency", T.DoubleType(), False),
    T.StructField("recency", T.DoubleType(), False),
    T.StructField("T", T.DoubleType(), False),
    T.StructField("monetary_value", T.DoubleType(), False),
])

RFM_COLUMNS = [f.name for f in RFM.fields]

CUSTOMER_REQUIRED = ["CustomerID", "Segment", "predicted_clv"]


def require_columns(df: DataFrame, cols, what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns {missing}; has {df.columns}")


def has_column(df: DataFrame, col: str) -> bool:
    return col in df.columns


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
