"""Shared pieces of the training-data operators."""

from __future__ import annotations

import sys
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir

# white space that separates words: space and tab .. carriage return. Python's
# bytes.split() splits on exactly these; SQL uses the pattern.
SPACE = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship the module's functions with the task, so that executors need the
    listed libraries but not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder: written once, read by
    every later step, and still there when an executor is lost. The shuffle
    files behind it are of no more use; Spark deletes them when the driver
    collects its garbage, so a collection is asked for."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    time.sleep(0.2)  # the listeners let go of the finished plan
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound(expr: Column, body) -> Column:
    """``body(x)`` with x bound to ``expr``, which is evaluated once per row
    however often the body (or a lambda in it) refers to x."""
    return F.transform(F.array(expr), body)[0]
