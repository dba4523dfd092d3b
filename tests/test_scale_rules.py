"""Caches follow the input, no silent limits, ranges follow the data."""

import decimal
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import SF001, tx_frame
from ledgerlens.config import BGNBDParams, Config
from ledgerlens.functions.special import hyp2f1_numpy
from ledgerlens.operators import clean as C
from ledgerlens.operators import features as FE
from ledgerlens.operators import ordered as O
from ledgerlens.operators import views as V
from ledgerlens.operators.bgnbd import bgnbd_fit
from ledgerlens.operators.clv import predict_clv
from ledgerlens.config import FIXED_GAMMA_GAMMA
from ledgerlens.sources.files import segment_rows


def test_a_rewritten_table_gives_new_answers(spark, tmp_path):
    import __spark_entry__ as E
    d = tmp_path / "sf"
    d.mkdir()
    for t in ("lineitem", "orders", "customer", "nation"):
        shutil.copyfile(f"{SF001}/{t}.parquet", d / f"{t}.parquet")
    names = ("kpis", "rfm_metrics", "load_customer_table", "clv_horizons")
    q = E.queries()
    total = lambda df: df.select([F.sum(c) for c, k in df.dtypes if k in ("double", "bigint")]).first()
    before = {n: total(q[n](spark, str(d))) for n in names}
    lines = pd.read_parquet(d / "lineitem.parquet")
    lines[lines.l_orderkey % 2 == 0].to_parquet(d / "lineitem.parquet")
    after = {n: total(q[n](spark, str(d))) for n in names}
    assert all(before[n] != after[n] for n in names)
    fresh = tmp_path / "again"
    shutil.copytree(d, fresh)
    for n in names:
        assert total(q[n](spark, str(fresh))) == pytest.approx(after[n], rel=1e-9)


@pytest.mark.parametrize("a,b,z", [(2.5, 3.0, 0.6), (2.5, 3.0, 0.999999), (-0.7, 3.0, 0.999), (40.0, 7.0, 0.95)])
def test_series_with_a_closed_form(a, b, z):
    assert hyp2f1_numpy(a, b, b, [z])[0] == pytest.approx((1 - z) ** -a, rel=1e-10)


def test_series_near_one_and_outside():
    for z in (0.3, 0.5, 0.51, 0.9, 0.999999, 1 - 1e-12):
        assert hyp2f1_numpy(1.0, 1.0, 2.0, [z])[0] == pytest.approx(-np.log1p(-z) / z, rel=1e-12)
    assert hyp2f1_numpy(2.5, -0.4, 300.5, [0.97])[0] == pytest.approx(1 - 0.4 * 2.5 / 300.5 * 0.97, rel=1e-4)
    for z in (-0.1, 1.0, np.nan):
        with pytest.raises(ValueError):
            hyp2f1_numpy(1.0, 1.0, 2.0, [z])


def test_a_new_customer_and_a_small_scale_parameter_have_a_value(spark):
    summary = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 5.0), ("b", 3.0, 20.0, 20.0, 5.0)],
                                    "CustomerID string, frequency double, recency double, T double, monetary_value double")
    bg = BGNBDParams(0.243, 0.001, 0.793, 2.426)
    out = predict_clv(summary, bg, FIXED_GAMMA_GAMMA).collect()
    assert all(np.isfinite(r.predicted_clv) and r.predicted_clv > 0 for r in out)
    zero = {r.CustomerID: r.predicted_clv for r in predict_clv(summary, bg, FIXED_GAMMA_GAMMA, Config(zero_freq_clv="zero")).collect()}
    assert zero["a"] == 0 and zero["b"] > 0


def test_a_fit_says_how_it_ended(spark):
    rows = [(str(i), float(i % 7 + 1), float(30 + i % 50), float(100 + i % 60), 9.0) for i in range(300)]
    summary = spark.createDataFrame(rows, "CustomerID string, frequency double, recency double, T double, monetary_value double")
    report = bgnbd_fit(summary).report
    assert report.iterations > 0 and np.isfinite(report.objective)
    assert report.at_bound or (report.converged and report.gradient_norm < 1e-2)
    short = bgnbd_fit(summary, max_iter=1).report
    assert not short.converged


def test_numeric_customer_ids_of_any_type_become_text(spark):
    base = tx_frame(spark, [("1", "A", "d", 1, "2020-01-01 10:00", 2.0, "17850", "UK")])
    for kind in ("decimal(10,1)", "double", "tinyint", "int", "bigint"):
        value = "17850" if kind != "tinyint" else "77"
        df = base.withColumn("CustomerID", F.lit(decimal.Decimal(value)).cast(kind))
        assert C.tx_normalized(df).first().CustomerID == value


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ranks_do_not_depend_on_the_number_of_ranges(spark, ranges):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), (F.col("id") % 3).alias("g"))
    got = {r.v: r.rn for r in O.global_row_number(df, [F.col("v")], n=ranges).collect()}
    assert got == {i: i + 1 for i in range(500)}
    cum = {r.v: r.cum for r in O.global_cumsum(df, [F.col("v")], "v", n=ranges).collect()}
    assert all(cum[i] == i * (i + 1) // 2 for i in range(500))


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 10)
    r = O.ranged(spark.range(300).select("id"), [F.col("id")])
    assert r.select(O._PID).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_day_with_a_third_of_all_lines(spark, monkeypatch):
    monkeypatch.setattr(FE, "LINE_BLOCK", 10)
    rows = [("1", f"S{i}", "d", 1, "2020-01-05 10:00", 1.0 + i, "hot", "UK") for i in range(105)]
    rows += [("2", "S", "d", 1, "2020-01-01 09:00", 1.0, "hot", "UK"), ("3", "S", "d", 1, "2020-01-02 09:00", 1.0, "b", "UK")]
    out = FE.time_between(C.tx_clean(tx_frame(spark, rows))).collect()
    assert len(out) == 107
    assert sorted(r.TimeDiff for r in out) == [0.0] * 106 + [4.0]


def test_group_statistics_do_not_shuffle_customers_by_group(spark):
    customers = spark.range(2000).select(F.col("id").cast("string").alias("CustomerID"), F.lit("one").alias("Segment"),
                                         F.col("id").cast("double").alias("predicted_clv"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        box = V.segment_clv_box(customers)
        plan = box._jdf.queryExecution().executedPlan().toString()
        r = box.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan
    assert (r.median, r.n) == (1000.0, 1999)


def test_raw_driver_values_without_bins(spark):
    customers = spark.createDataFrame([("a", 3, 5.0), ("b", 3, 7.0), ("c", 40, 9.0)], "CustomerID string, category_count int, predicted_clv double")
    out = {r.category_count_binned: r.n for r in V.driver_clv_box(customers, "category_count", binned=False).collect()}
    assert out == {"3": 2, "40": 1}


def test_segment_rows_are_all_rows(spark):
    df = spark.range(1500).select("id", F.lit("x").alias("Segment"))
    assert segment_rows(df).count() == 1500 and segment_rows(df, "y").count() == 0
    assert '"id":3' in segment_rows(df.where("id = 3"), "x").first().json


def test_audit_counts(spark):
    line = ("1", "A", "d", 1, "2020-01-01 10:00", 2.0, "c", "UK")
    rows = [line, line, (*line[:3], -1, *line[4:]), (*line[:5], 0.0, *line[6:]), (*line[:6], None, "UK")]
    r = C.cleaning_audit(tx_frame(spark, rows)).first()
    assert (r.raw_rows, r.rows_with_customer, r.rows_positive_quantity, r.rows_positive_price, r.clean_rows) == (5, 4, 3, 2, 1)
    assert C.cleaning_audit(tx_frame(spark, [line]).limit(0)).first().raw_rows == 0
    assert Config().order_partitions is None


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_and_visits_meet_where_the_join_put_them(spark, tmp_path, monkeypatch):
    from ledgerlens.sources import tables as T
    from ledgerlens.operators.visits import visits
    from ledgerlens.plans.common import clean_tx
    lines = pd.DataFrame([(o, p, 2.0, 8.0, f) for o, p, f in [(1, 1, "N"), (1, 1, "N"), (1, 2, "N"), (2, 1, "N"), (2, 1, "R"), (3, 1, "N")]],
                         columns=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"])
    orders = pd.DataFrame([(1, 7.0), (2, 7.0), (2, 7.0), (3, None)], columns=["o_orderkey", "o_custkey"]).astype({"o_custkey": "Int64"})
    orders["o_orderdate"] = pd.Timestamp("2020-01-01")
    lines.to_parquet(tmp_path / "lineitem.parquet")
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = visits(clean_tx(spark, str(tmp_path), with_order=True))
        assert _plan_text(seen).count("Exchange hashpartitioning") == 2  # both sides of the join
        rows = sorted((r.InvoiceNo, r.lines, r.TotalPrice) for r in seen.collect())
        monkeypatch.setattr(T, "LINES_PER_PART", 0.5)  # more partitions than the session's: 12
        more = visits(clean_tx(spark, str(tmp_path), with_order=True))
        assert _plan_text(more).count("Exchange hashpartitioning") == 2 and "_orderkey#" in _plan_text(more)
        assert sorted((r.InvoiceNo, r.lines, r.TotalPrice) for r in more.collect()) == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert rows == [("1", 2, 16.0), ("2", 1, 8.0)]
    assert "_order" not in clean_tx(spark, str(tmp_path)).columns and "_order" not in seen.columns


def test_partitions_follow_the_rows_while_a_plan_is_built(spark, tmp_path, monkeypatch):
    from ledgerlens import session as S
    from ledgerlens.operators import validation as VA
    from ledgerlens.plans import common, customer_plan as P, registry_more as M
    for t in ("lineitem", "orders"):
        shutil.copyfile(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    had, seen = spark.conf.get(S._PARTS), {}

    def note(name, f):
        def run(*a, **b):
            seen[name] = int(spark.conf.get(S._PARTS))
            return f(*a, **b)
        return run
    monkeypatch.setattr(P, "customer_base", note("base", P.customer_base))
    monkeypatch.setattr(M.FE, "ml_features", note("features", M.FE.ml_features))
    monkeypatch.setattr(M.E, "segment_transitions", note("transitions", M.E.segment_transitions))
    monkeypatch.setattr(VA, "calibration_holdout", note("holdout", lambda rows: rows.limit(0).selectExpr(
        "1D predicted_total", "1D mae", "1D mse", "1D correlation")))
    monkeypatch.setattr(S, "ROWS_PER_PART", 100)
    place = str(tmp_path)
    lines, visits = (spark.read.parquet(f"{place}/lineitem.parquet").count(), common.customer_plan(spark, place).visits.count())
    M._features(spark, place)
    M.q_segment_transitions(spark, place)
    M.q_calibration_holdout_fitted(spark, place)
    of = lambda n: max(int(had), -(-n // 100))
    assert seen == {"base": of(lines), "features": of(visits), "transitions": of(visits), "holdout": of(visits)}
    assert of(lines) > of(visits) > int(had) and spark.conf.get(S._PARTS) == had
    with S.partitions_for(spark.range(0)), S.partitions_for(spark.range(5)):
        assert spark.conf.get(S._PARTS) == had
    with pytest.raises(ZeroDivisionError), S.partitions_for(spark.range(5000)):
        1 / 0
    assert spark.conf.get(S._PARTS) == had


def test_a_plan_ranks_and_scores_only_when_asked(spark):
    from ledgerlens.plans.customer_plan import build_customer_plan
    rows = [(str(i), "A", "d", 1, f"2020-01-0{1 + i % 9} 10:00", 2.0 + i, f"c{i % 4}", "UK") for i in range(20)]
    plan = build_customer_plan(C.tx_clean(tx_frame(spark, rows)))
    assert plan.summary.count() == 4 and not {"segments", "customers"} & set(vars(plan))
    other = plan.scored(plan.bg, None)
    assert other.base is plan.base and other.segments is plan.segments
    assert {r.predicted_clv for r in other.customers.collect()} == {0.0}


def test_features_group_no_visits_by_invoice_and_purchase_times_once(spark, monkeypatch):
    import re
    from ledgerlens.plans.customer_plan import build_customer_plan
    rows = [(str(i % 7), f"S{i % 5}", "d", 1 + i % 3, f"2020-01-0{1 + i % 9} 1{i % 2}:00", 2.0 + i, f"c{i % 7 % 3}", "UK") for i in range(60)]
    rows += [rows[0], ("one", "S", "d", 2, "2020-01-03 10:00", 4.0, "new", "UK")]
    plan = build_customer_plan(C.tx_clean(tx_frame(spark, rows)))
    kept = []
    monkeypatch.setattr(FE, "cut_lineage", lambda df: kept.append(df) or df)
    got = FE.ml_features(plan.segments, plan.visits, products_of=plan.drivers, spread_of=plan.order_spread).toPandas().set_index("CustomerID")
    text = _plan_text(kept[0])
    assert "InvoiceNo" not in text and not re.search(r"hashpartitioning\([^)]*InvoiceDate", text)

    df = pd.DataFrame(rows, columns=["inv", "code", "d", "q", "t", "price", "c", "k"]).drop_duplicates()
    df = df.assign(t=pd.to_datetime(df.t), v=df.q * df.price)
    spread = df.groupby(["c", "inv"]).v.sum().groupby(level=0).std(ddof=1)
    spread = spread.fillna(spread.median())  # one invoice has none
    assert set(got.index) == {"c0", "c1", "c2", "new"}
    for c, own in df.groupby("c"):
        days = own.sort_values("t").t.diff().dt.days.fillna(0)
        assert got.AvgOrderValueStdDev[c] == pytest.approx(spread[c], rel=1e-9)
        assert got.TotalQuantity[c] == own.q.sum() and got.AvgOrderQuantity[c] == pytest.approx(own.q.mean(), rel=1e-12)
        assert got.MeanTimeBetweenPurchases[c] == pytest.approx(days.mean(), rel=1e-9)
        assert got.StdTimeBetweenPurchases[c] == pytest.approx(days.std() if len(own) > 1 else 0, rel=1e-9)
        assert got.UniqueProducts[c] == own.code.nunique()
        assert got.CategoryDiversityIndex[c] == pytest.approx(min(own.code.nunique() / len(own), 1))
        assert (got.FirstPurchase[c], got.LastPurchase[c]) == (own.t.min(), own.t.max())
    lines = FE.ml_features(plan.segments, C.tx_clean(tx_frame(spark, rows))).toPandas().set_index("CustomerID")
    pd.testing.assert_frame_equal(lines.loc[got.index], got, check_exact=False)
