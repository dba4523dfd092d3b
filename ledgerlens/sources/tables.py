"""Map the supplied star-schema tables onto the invoice-line model.

InvoiceNo   order key as text, ``C`` prefix for returned lines
StockCode   part key as text
Quantity    line quantity, negated for returned lines
InvoiceDate order date
UnitPrice   extended price / quantity
CustomerID  customer key as text
Country     nation name (optional: costs a join on the customer key)

``dirty=True`` perturbs the mapping deterministically so that every cleaning
rule has work to do; no row is dropped: missing customer when
``o_orderkey % 10 = 3``, zero price when ``l_partkey % 97 = 0`` and a second
copy of each line with ``o_orderkey % 50 = 7``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.visits import ORDER


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


LINES_PER_PART = 1_000_000
TX_TABLES = ("lineitem", "orders", "customer", "nation", "part", "events")


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, modification time, bytes and number of files of every table that
    the transactions come from: what a cached result is valid for."""
    found = []
    for name in TX_TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(sf_dir, f"{name}.parquet"))
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            held = fs.getContentSummary(path)
            found.append((name, fs.getFileStatus(path).getModificationTime(), held.getLength(), held.getFileCount()))
    return (sf_dir, *found)


def _orders_side(spark: SparkSession, sf_dir: str, with_country: bool) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if not with_country:
        return orders
    # Enrich orders (a quarter of the line count) rather than lines, so the
    # extra shuffle on the customer key moves the smaller table. The planner
    # broadcasts the small dimension by its size.
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust_nation = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    return (orders.join(cust_nation, orders.o_custkey == cust_nation.c_custkey, "left")
            .select("o_orderkey", "o_custkey", "o_orderdate", F.col("n_name").alias("Country")))


def transactions(spark: SparkSession, sf_dir: str, dirty: bool = True,
                 with_country: bool = False, with_description: bool = False, with_order: bool = False) -> DataFrame:
    """``with_order`` keeps the order key as ``ORDER``: all that is equal in
    InvoiceNo is equal in it, and the join has put the rows by it."""
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = _orders_side(spark, sf_dir, with_country)
    if with_order:  # copies and visits are built in the join's partitions: as many as the lines need
        n = int(-(-lines.count() // LINES_PER_PART))
        if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
            lines, orders = lines.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")
    j = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "inner")
    if with_description:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
        j = j.join(part, j.l_partkey == part.p_partkey, "left")

    returned = F.col("l_returnflag") == "R"
    order_txt = F.col("o_orderkey").cast("string")
    cust = F.col("o_custkey").cast("string")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    if dirty:
        cust = F.when(F.col("o_orderkey") % 10 == 3, F.lit(None).cast("string")).otherwise(cust)
        price = F.when(F.col("l_partkey") % 97 == 0, F.lit(0.0)).otherwise(price)
        # one or two copies of the line; a generator, not a second join
        j = j.withColumn("_copy", F.explode(F.sequence(
            F.lit(1), F.when(F.col("o_orderkey") % 50 == 7, F.lit(2)).otherwise(F.lit(1)))))

    cols = [
        F.when(returned, F.concat(F.lit("C"), order_txt)).otherwise(order_txt).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
    ]
    if with_description:
        cols.append(F.col("p_name").alias("Description"))
    cols += [
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        price.alias("UnitPrice"),
        cust.alias("CustomerID"),
    ]
    if with_country:
        cols.append(F.col("Country"))
    if with_order:
        cols.append(F.col("o_orderkey").alias(ORDER))
    return j.select(*cols)


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as a second line source; the only one with a time of
    day. It has no StockCode, so category metrics fall back to 0."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.lit(1.0).alias("Quantity"),
        F.col("ts").alias("InvoiceDate"),
        F.col("value").alias("UnitPrice"),
        F.col("user_id").cast("string").alias("CustomerID"),
    )
