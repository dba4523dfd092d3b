"""Global orderings without a single-partition window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task. Instead:

1. ``repartitionByRange(n, keys)`` + ``sortWithinPartitions(keys)``: balanced
   partitions, globally ordered by partition index (keys are made unique with
   a tiebreaker, so the order and the result are deterministic);
2. the partition index and the position inside the partition are written as
   columns (``monotonically_increasing_id`` is ``partition << 33 | row``) with
   the rows in the shared folder, so every later read sees the same tags, also
   after an executor loss;
3. per-partition counts (or sums, or boundary rows) - one row per partition
   of millions of rows - are prefix-summed on the driver and joined back on
   the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

_PID = "_ll_pid"
_POS = "_ll_pos"


ROWS_PER_RANGE = 4_000_000  # some 128-256 MB of the narrow rows that are ranked here
FEW = 10_000  # rows of a per-partition or per-group table that is broadcast


def few(df: DataFrame) -> DataFrame:
    """A table with one row per group, for a join: read once (at most FEW + 1
    rows of it) and broadcast if it is checked to be small; a large one is
    written and joined by the planner's choice."""
    rows = df.limit(FEW + 1).toArrow()
    if rows.num_rows <= FEW:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return cut_lineage(df)


def ranged(df: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """Range-partitioned, sorted, tagged with (_ll_pid, _ll_pos) and written.
    The number of ranges follows the rows, with the session's shuffle
    partitions as the least. The tags are written with the rows, so every
    later read agrees with them. The input is held only meanwhile."""
    spark = df.sparkSession
    df = df.persist()
    try:
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        n = int(n) if n else max(least, -(-df.count() // ROWS_PER_RANGE))
        return cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                           .withColumn(_PID, F.spark_partition_id())
                           .withColumn(_POS, F.monotonically_increasing_id()
                                       - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    finally:
        df.unpersist()


def _per_partition(r: DataFrame, *aggs: Column) -> list:
    """One row per non-empty partition, ordered by partition index."""
    return sorted(r.groupBy(_PID).agg(*aggs).collect(), key=lambda row: row[_PID])


def _attach(r: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join per-partition values (pid first) to the rows of the partition."""
    values = r.sparkSession.createDataFrame(rows, f"{_PID} int, {schema}")
    return r.join(F.broadcast(values) if len(rows) <= FEW else values, _PID, "left")


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      n: int | None = None, total_name: str | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row in ``order`` over the whole
    frame; optionally ``total_name`` = row count of the frame."""
    r = ranged(df, order, n)
    offsets, run = [], 0
    for row in _per_partition(r, F.count(F.lit(1)).alias("c")):
        offsets.append((row[_PID], run))
        run += row["c"]
    out = _attach(r, offsets, "_ll_off bigint").withColumn(name, F.col("_ll_off") + F.col(_POS) + 1)
    if total_name:
        out = out.withColumn(total_name, F.lit(run).cast("bigint"))
    return out.drop(_PID, _POS, "_ll_off")


def global_cumsum(df: DataFrame, order: list[Column], value: str, name: str = "cum",
                  n: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order`` over the whole frame. Inside a
    range partition the running sum is a window over that partition
    (balanced by construction); partition totals are prefix-summed."""
    r = ranged(df, order, n)
    vtype = "bigint" if dict(df.dtypes)[value] in ("int", "bigint", "smallint", "tinyint") else "double"
    zero = 0 if vtype == "bigint" else 0.0
    offsets, run = [], zero
    for row in _per_partition(r, F.sum(value).alias("s")):
        offsets.append((row[_PID], run))
        run += (int if vtype == "bigint" else float)(row["s"] or zero)
    local = Window.partitionBy(_PID).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(r.withColumn("_ll_run", F.sum(value).over(local)), offsets, f"_ll_off {vtype}")
    return out.withColumn(name, F.col("_ll_off") + F.col("_ll_run")).drop(_PID, _POS, "_ll_off", "_ll_run")


def lag_within(df: DataFrame, group: str, ts: str, name: str = "prev", n: int | None = None) -> DataFrame:
    """Previous ``ts`` of the same ``group`` in ``ts`` order (null for the
    first), for data where one group may hold a large share of all rows.

    The frame is range-partitioned on (group, ts), so a hot group is split
    across partitions. Inside a partition the lag is a window on
    (partition, group); the first row of a partition takes the last row of
    the nearest non-empty earlier partition when that row is the same group.
    """
    r = ranged(df, [F.col(group), F.col(ts)], n)
    gtype = dict(r.dtypes)[group]
    ttype = dict(r.dtypes)[ts]
    # timestamps cross the driver as text so no time zone touches them
    as_text = ttype.startswith("timestamp")
    t_out = F.col(ts).cast("string") if as_text else F.col(ts)
    lasts = _per_partition(r, F.max_by(F.struct(F.col(group).alias("g"), t_out.alias("t")),
                                       F.col(_POS)).alias("last"))
    befores, before = [], None
    for row in lasts:
        if before is not None:
            befores.append((row[_PID], before["g"], before["t"]))
        before = row["last"]
    local = Window.partitionBy(_PID, group).orderBy(_POS)
    out = _attach(r.withColumn("_ll_lag", F.lag(ts).over(local)), befores,
                  f"_ll_g {gtype}, _ll_t {'string' if as_text else ttype}")
    carried = F.when((F.col(_POS) == 0) & (F.col("_ll_g") == F.col(group)), F.col("_ll_t").cast(ttype))
    return out.withColumn(name, F.coalesce("_ll_lag", carried)).drop(_PID, _POS, "_ll_lag", "_ll_g", "_ll_t")


def exact_quantiles(df: DataFrame, value: str, probs, group: str | None = None,
                    n: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles (type 7, as ``percentile`` /
    ``quantile_cont``) of ``value`` for each ``group``, without holding a
    group's values - or the copies of one hot value - in one task:

    1. distinct (group, value) rows with their count (partial aggregate: a
       value held by a third of all rows becomes one row);
    2. a distributed running sum of the counts in (group, value) order, over
       unique keys, so range partitions stay balanced;
    3. each distinct value covers positions [a, b] of its group; the two
       neighbours of quantile p are the values covering floor and ceil of
       p (n - 1) + 1, found by flags, not by a range join.

    Returns (group, p, quantile)."""
    keys = [group] if group else []
    return _quantiles(df.select(*keys, F.col(value).cast("double").alias("_v")), keys, probs, n)


def stacked_quantiles(df: DataFrame, values, probs, group: str | None = None, n: int | None = None) -> DataFrame:
    """``exact_quantiles`` of several columns in one run: the rows are stacked
    as (group, column, value), so all columns share one count, one order and
    one running sum. Returns (group, column, p, quantile); a column with no
    value in a group has no row."""
    keys = [group] if group else []
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in values]))
    base = df.select(*keys, cells.alias("_cell")).select(*keys, "_cell.column", "_cell._v")
    return _quantiles(base, [*keys, "column"], probs, n)


def quantile_values(df: DataFrame, values, probs, n: int | None = None) -> dict[str, list[float | None]]:
    """Quantiles of whole columns as numbers (columns x probabilities of them,
    whatever the rows), for use as literals that a scan's filter can take; None
    for a column without values."""
    got = {(r["column"], r["p"]): r["quantile"] for r in stacked_quantiles(df, values, probs, n=n).collect()}
    return {c: [got.get((c, float(p))) for p in probs] for c in values}


def group_medians(df: DataFrame, values, group: str, n: int | None = None) -> DataFrame:
    """One row per group with ``<column>_median`` for each of ``values``."""
    q = stacked_quantiles(df, values, [0.5], group, n)
    return q.groupBy(group).agg(*[F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(f"{c}_median") for c in values])


def _quantiles(base: DataFrame, keys: list[str], probs, n: int | None) -> DataFrame:
    """(keys, p, quantile) of the column ``_v`` for each of ``keys``."""
    counts = base.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum = global_cumsum(counts, [F.col(k) for k in [*keys, "_v"]], "_c", "_cum", n=n)
    per_group = cum.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_c")).alias("_before"),
                                       F.sum("_c").alias("_n"))
    if keys:
        j = cum.join(few(per_group), keys, "inner")
    else:
        g = per_group.first()  # one row, also of an empty table
        j = cum.withColumn("_before", F.lit(g["_before"]).cast("bigint")).withColumn("_n", F.lit(g["_n"]).cast("bigint"))
    a = F.col("_cum") - F.col("_c") - F.col("_before") + 1
    b = F.col("_cum") - F.col("_before")
    covers = []
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("_n") - 1) + 1
        lo, hi = F.floor(h), F.ceil(h)
        is_lo, is_hi = (a <= lo) & (lo <= b), (a <= hi) & (hi <= b)
        covers += [is_lo, is_hi]
        aggs += [F.max(F.when(is_lo, F.col("_v"))).alias(f"_lo{i}"), F.max(F.when(is_hi, F.col("_v"))).alias(f"_hi{i}"),
                 F.max(h - lo).alias(f"_f{i}")]
    any_cover = covers[0]
    for c in covers[1:]:
        any_cover = any_cover | c
    picked = j.filter(any_cover).groupBy(*keys).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"),
                                        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}"))
                                        .alias("quantile")) for i, p in enumerate(probs)]))
    return picked.select(*keys, rows.alias("_q")).select(*keys, "_q.p", "_q.quantile")


def quantile_columns(df: DataFrame, value: str, probs, names, group: str | None = None,
                     n: int | None = None) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per probability (the
    probabilities are a short static list)."""
    q = exact_quantiles(df, value, probs, group, n)
    keys = [group] if group else []
    cols = [F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(nm) for p, nm in zip(probs, names)]
    if keys:
        return q.groupBy(*keys).agg(*cols)
    return q.agg(*cols)
