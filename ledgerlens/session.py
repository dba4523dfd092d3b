"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int = 8,
                app: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, build your own
    session; every operator only needs the one it is handed."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``;
    only when nothing is configured (local tests) fall back to a scratch
    folder of our own."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote session has no local context
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return _owned(spark, current)
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return _owned(spark, sc.getCheckpointDir())


_OWNED: set = set()


def _owned(spark: SparkSession, folder: str) -> str:
    """Remove the application's own folder under the shared one when the
    driver ends; the files are only for its running queries."""
    if folder not in _OWNED:
        _OWNED.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

        def drop() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                fs.delete(path, True)

        atexit.register(drop)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder that
    ``spark.checkpoint.dir`` names and read them from there, so a lost
    executor re-reads files instead of replaying the plan."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROWS_PER_PART = 1_000_000
_PARTS = "spark.sql.shuffle.partitions"


@contextlib.contextmanager
def partitions_for(rows: DataFrame):
    """Jobs started inside shuffle into one partition per million of ``rows``,
    where the session has fewer, so that a task's share does not grow with the
    input. ``rows``: a table whose count is read from its files."""
    conf = rows.sparkSession.conf
    had = conf.get(_PARTS)
    n = int(-(-rows.count() // ROWS_PER_PART))
    if n <= int(had):
        yield
        return
    conf.set(_PARTS, str(n))
    try:
        yield
    finally:
        conf.set(_PARTS, had)


def session_key(spark: SparkSession) -> str:
    """Identity of the running application, for per-session caches."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - a remote session has no local context
        return f"session-{id(spark)}"
