"""Hand fixtures for the cleaning rules, day arithmetic, second purchase,
repeat-purchase summary, scores and segments (FIXTURES.md section 4)."""

import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import tx_frame
from ledgerlens.config import Config
from ledgerlens.functions.scoring import edge_count_score, rank_quantile_score
from ledgerlens.operators import clean as C
from ledgerlens.operators import drivers as DR
from ledgerlens.operators import rfm as RF
from ledgerlens.operators import summary as SU

# (InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country)
CLEAN_RULES = [
    ("1", "A", "a", 2, "2011-01-01 10:00", 1.5, "10", "UK"),     # kept
    ("1", "A", "a", 2, "2011-01-01 10:00", 1.5, "10", "UK"),     # exact duplicate: dropped
    ("1", "A", "other", 2, "2011-01-01 10:00", 1.5, "10", "UK"),  # differs in Description: kept
    ("2", "B", "b", 1, "2011-01-02 10:00", 2.0, None, "UK"),     # no customer
    ("C3", "B", "b", -1, "2011-01-03 10:00", 2.0, "11", "UK"),   # return
    ("4", "B", "b", 0, "2011-01-04 10:00", 2.0, "11", "UK"),     # zero quantity
    ("5", "B", "b", 3, "2011-01-05 10:00", 0.0, "11", "UK"),     # free item
    ("6", "B", "b", 3, "2011-01-06 10:00", -1.0, "11", "UK"),    # negative price
    ("7", "C", "c", 1, "2011-01-07 10:00", 3.0, "11", "FR"),     # kept
    ("8", "C", "c", -2, "2011-01-08 10:00", 0.0, None, "FR"),    # all three rules
    ("9", "D", "d", 5, "2011-01-09 10:00", 1.0, "12", "DE"),     # kept
    ("9", "D", "d", 5, "2011-01-09 10:00", 1.0, "12", "DE"),     # duplicate
]


def test_clean_rules(spark):
    raw = tx_frame(spark, CLEAN_RULES)
    clean = C.tx_clean(raw)
    got = sorted((r.InvoiceNo, r.Description) for r in clean.collect())
    assert got == [("1", "a"), ("1", "other"), ("7", "c"), ("9", "d")]
    a = C.cleaning_audit(raw).first()
    assert (a.raw_rows, a.rows_with_customer, a.rows_positive_quantity, a.rows_positive_price, a.clean_rows) == \
        (12, 10, 8, 6, 4)
    assert C.duplicate_count(raw).first().duplicate_rows == 2
    assert C.returns_lines(raw).first().return_lines == 1
    assert C.zero_price_lines(raw).first().zero_price_lines == 1
    assert C.cancelled_lines(raw).first().cancelled_lines == 1


def test_dedupe_idempotent(spark):
    clean = C.tx_clean(tx_frame(spark, CLEAN_RULES))
    assert clean.count() == clean.dropDuplicates().count()


def test_recency_floors_elapsed_days(spark):
    # snapshot 2011-01-11 08:00: customer 1 last bought 22 h before (0 whole
    # days), customer 2 26 h before (1 day), customer 3 9 h before on the
    # previous calendar day (0 days, where a calendar difference says 1)
    import datetime as dt
    rows = [
        ("1", "A", "a", 1, "2011-01-10 10:00", 1.0, "1", "UK"),
        ("2", "A", "a", 1, "2011-01-10 06:00", 1.0, "2", "UK"),
        ("3", "A", "a", 1, "2011-01-10 23:00", 1.0, "3", "UK"),
        ("4", "A", "a", 1, "2011-01-01 23:00", 1.0, "1", "UK"),
    ]
    clean = C.tx_clean(tx_frame(spark, rows))
    snap = dt.datetime(2011, 1, 11, 8, 0)
    got = {r.CustomerID: r.Recency for r in RF.rfm_metrics(clean, snap).collect()}
    assert got == {"1": 0, "2": 1, "3": 0}
    default = {r.CustomerID: r.Recency for r in RF.rfm_metrics(clean).collect()}
    assert default == {"1": 1, "2": 1, "3": 1}  # snapshot = last line + 1 day


def test_second_purchase_is_second_line(spark):
    rows = [
        ("1", "A", "a", 1, "2011-01-01 10:00", 1.0, "1", "UK"),                 # one line
        ("2", "A", "a", 1, "2011-01-01 10:00", 1.0, "2", "UK"),                 # two lines, same invoice
        ("2", "B", "b", 1, "2011-01-01 10:00", 1.0, "2", "UK"),
        ("3", "A", "a", 1, "2011-01-01 10:00", 1.0, "3", "UK"),                 # two invoices 40 days apart
        ("4", "A", "a", 1, "2011-02-10 10:00", 1.0, "3", "UK"),
    ]
    clean = C.tx_clean(tx_frame(spark, rows))
    got = {r.CustomerID: (r.time_to_second_purchase, r.category_count) for r in DR.driver_metrics(clean).collect()}
    assert got == {"1": (-1.0, 1), "2": (0.0, 2), "3": (40.0, 1)}
    inv = {r.CustomerID: r.time_to_second_purchase
           for r in DR.driver_metrics(clean, grain="invoice").collect()}
    assert inv == {"1": -1.0, "2": -1.0, "3": 40.0}


def test_second_purchase_plans_group_limit(spark):
    clean = C.tx_clean(tx_frame(spark, CLEAN_RULES))
    plan = DR.second_purchase(clean)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_summary_day_periods(spark):
    rows = [
        ("1", "A", "a", 1, "2011-01-01 09:00", 10.0, "1", "UK"),
        ("2", "A", "a", 1, "2011-01-01 15:00", 30.0, "1", "UK"),   # same day: one period
        ("3", "A", "a", 1, "2011-01-05 09:00", 7.0, "1", "UK"),
        ("4", "A", "a", 2, "2011-01-05 10:00", 4.0, "1", "UK"),
        ("5", "A", "a", 1, "2011-01-11 09:00", 5.0, "1", "UK"),
        ("6", "A", "a", 1, "2011-01-03 12:00", 9.0, "2", "UK"),    # one purchase day
        ("7", "A", "a", 1, "2011-01-21 12:00", 1.0, "3", "UK"),    # observation end
    ]
    clean = C.tx_clean(tx_frame(spark, rows))
    got = {r.CustomerID: (r.frequency, r.recency, r.T, r.monetary_value)
           for r in SU.purchase_summary(clean).collect()}
    assert got["1"] == (2.0, 10.0, 20.0, (15.0 + 5.0) / 2)   # first day's 40 excluded
    assert got["2"] == (0.0, 0.0, 18.0, 0.0)
    assert got["3"] == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", list(range(1, 60)) + [97, 128, 399, 1500])
def test_rank_score_matches_quantile_cut(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).cast("bigint").alias("n"))
    got = [r.s for r in df.select(rank_quantile_score(F.col("rn"), F.col("n"), 5).alias("s")).orderBy("rn").collect()]
    if n == 1:
        assert got == [1]
        return
    expected = pd.qcut(pd.Series(range(1, n + 1), dtype=float), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert got == expected
    sizes = pd.Series(got).value_counts()
    assert sizes.max() - sizes.min() <= 2


def test_recency_score_matches_quantile_cut(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 400, size=500).tolist()
    df = spark.createDataFrame([(int(v),) for v in vals], "Recency bigint")
    edges = df.agg(F.percentile(F.col("Recency").cast("double"), F.array(*[F.lit(j / 5) for j in range(1, 5)]))).scalar()
    got = [r.s for r in df.select(edge_count_score(F.col("Recency"), edges, 5).alias("s")).collect()]
    expected = pd.qcut(pd.Series(vals), 5, labels=[5, 4, 3, 2, 1]).astype(int).tolist()
    assert got == expected


def test_recency_tied_edges(spark):
    vals = [1] * 8 + [2, 3]
    rfm = spark.createDataFrame([(str(i), v, 1, 10.0 + i) for i, v in enumerate(vals)],
                                "CustomerID string, Recency bigint, Frequency bigint, Monetary double")
    ok = RF.rfm_scores(rfm, Config()).collect()
    assert {r.R_Score for r in ok if r.Recency == 1} == {5}
    with pytest.raises(Exception, match="not unique"):
        RF.rfm_scores(rfm, Config(recency_ties="error")).collect()


def _segment_brute(r, f, m, rules):
    if rules == "code":
        table = [
            (lambda: r >= 4 and f >= 4 and m >= 4, "Champions"),
            (lambda: r >= 3 and f >= 3 and m >= 3, "Loyal Customers"),
            (lambda: r >= 4 and 1 <= f <= 2, "New Customers"),
            (lambda: 3 <= r <= 4 and 3 <= f <= 4, "Potential Loyalists"),
            (lambda: 2 <= r <= 3 and f >= 2 and m >= 2, "At Risk"),
            (lambda: r <= 2 and f >= 4 and m >= 4, "Can't Lose Them"),
            (lambda: r <= 2 and f <= 2, "Hibernating/Lost"),
        ]
        default = "Needs Attention"
    else:
        table = [
            (lambda: r >= 4 and f >= 4 and m >= 4, "Champions"),
            (lambda: r >= 2 and f >= 3 and m >= 3, "Loyal Customers"),
            (lambda: r >= 3 and f <= 3 and m <= 3, "Potential Loyalists"),
            (lambda: r >= 4 and f == 1, "New Customers"),
            (lambda: 2 <= r <= 3 and f >= 2 and m >= 2, "At Risk"),
            (lambda: r == 1 and f >= 4 and m >= 4, "Can't Lose Them"),
            (lambda: r == 1 and f <= 2 and m <= 2, "Lost Customers"),
        ]
        default = "Other"
    for cond, name in table:
        if cond():
            return name
    return default


@pytest.mark.parametrize("rules", ["code", "appendix"])
def test_segment_cube(spark, rules):
    cube = list(itertools.product(range(1, 6), repeat=3))
    df = spark.createDataFrame(cube, "r int, f int, m int")
    got = {(x.r, x.f, x.m): x.s for x in df.select(
        "r", "f", "m", RF.segment_of(F.col("r"), F.col("f"), F.col("m"), 5, rules).alias("s")).collect()}
    assert len(got) == 125
    for (r, f, m), s in got.items():
        assert s == _segment_brute(r, f, m, rules), (r, f, m)


def test_empty_inputs_keep_schema(spark):
    from ledgerlens.schema import RAW_TX
    raw = spark.createDataFrame([], RAW_TX)
    clean = C.tx_clean(raw)
    assert clean.count() == 0
    for df in (RF.rfm_metrics(clean), SU.purchase_summary(clean), DR.driver_metrics(clean)):
        assert df.count() == 0 and "CustomerID" in df.columns


def test_load_transactions_roundtrip_and_missing(spark, tmp_path):
    from ledgerlens.sources.files import load_transactions
    raw = tx_frame(spark, CLEAN_RULES)
    raw.write.parquet(str(tmp_path / "tx"))
    back = load_transactions(spark, str(tmp_path / "tx"))
    assert back.count() == len(CLEAN_RULES) and C.tx_clean(back).count() == 4
    raw.write.option("header", "true").csv(str(tmp_path / "csv"))
    assert C.tx_clean(load_transactions(spark, str(tmp_path / "csv"), fmt="csv")).count() == 4
    with pytest.raises(FileNotFoundError):
        load_transactions(spark, str(tmp_path / "absent"))


def test_customer_id_float_to_text(spark):
    df = spark.createDataFrame([("1", 1.0, "2011-01-01 10:00:00", 2.0, 17850.0)],
                               "InvoiceNo string, Quantity double, InvoiceDate string, UnitPrice double, CustomerID double")
    r = C.tx_normalized(df).first()
    assert r.CustomerID == "17850" and r.TotalPrice == 2.0 and r.InvoiceDate.year == 2011


def test_rank_score_random_sizes(spark):
    import numpy as np
    rng = np.random.default_rng(123)
    sizes = sorted(set(int(n) for n in rng.integers(2, 5000, 12)))
    rows = [(int(n), int(r)) for n in sizes for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n bigint, rn bigint")
    got = df.select("n", "rn", rank_quantile_score(F.col("rn"), F.col("n"), 5).alias("s")).toPandas()
    for n, g in got.groupby("n"):
        expected = pd.qcut(pd.Series(range(1, n + 1), dtype=float), 5, labels=[1, 2, 3, 4, 5]).astype(int)
        assert g.sort_values("rn").s.tolist() == expected.tolist(), n


def test_customer_table_query_pages(spark):
    from ledgerlens.operators import views as V
    rows = [(str(i), "Champions" if i % 2 else "At Risk", i % 7, 1 + i % 4, 100.0 + i, 5, 4, 3,
             float(1000 - 3 * i), 0.5, 2, 10.0) for i in range(40)]
    cols = ("CustomerID string, Segment string, Recency bigint, Frequency bigint, Monetary double, R_Score int, "
            "F_Score int, M_Score int, predicted_clv double, prob_alive double, category_count bigint, "
            "time_to_second_purchase double")
    df = spark.createDataFrame(rows, cols)
    p0 = V.customer_table_query(df, where="Frequency >= 2").collect()
    p1 = V.customer_table_query(df, where="Frequency >= 2", page=1).collect()
    assert len(p0) == 15 and len(p1) == 15
    clvs = [r.predicted_clv for r in p0 + p1]
    assert clvs == sorted(clvs, reverse=True) and all(r.Frequency >= 2 for r in p0 + p1)
    assert not {r.CustomerID for r in p0} & {r.CustomerID for r in p1}


def test_load_customer_table_validates(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerlens.sources.files import load_customer_table
    good = spark.createDataFrame([("1", "Champions", 10.0)], "CustomerID string, Segment string, predicted_clv double") \
        .withColumn("snapshot_date", F.lit("2011-01-01").cast("date"))
    calls = []

    def compute():
        calls.append(1)
        return good

    path = str(tmp_path / "customers")
    good.drop("snapshot_date").write.parquet(path)          # invalid: no snapshot date
    assert load_customer_table(spark, path, compute).count() == 1 and calls == [1]
    assert load_customer_table(spark, path, compute).count() == 1 and calls == [1]   # now valid: no recompute
    with pytest.raises(FileNotFoundError):
        load_customer_table(spark, str(tmp_path / "absent"))
