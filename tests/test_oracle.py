"""Registered queries against their DuckDB SQL at sf0.001, the driver
contract, and the coverage of the oracle."""

import os
import re
import sys

import duckdb
import pytest

from helpers import ROOT, SF001

sys.path.insert(0, os.path.join(ROOT, "tools"))

# model fits and the boosted trees have no SQL twin (iterative algorithms)
ROWS_ONLY = {"bgnbd_fit", "gg_fit", "customer_table_fitted", "calibration_holdout_fitted", "regression_metrics",
             "regression_metrics_absolute", "feature_importance", "boosted_rounds", "boosted_metrics", "boosted_importance",
             "leafwise_rounds", "leafwise_metrics"}

SAMPLE = ["event_rfm_metrics", "load_customer_table", "tx_clean", "cleaning_audit", "rfm_segments", "segment_distribution", "purchase_summary",
          "driver_metrics", "predict_clv", "customer_table", "kpis", "segment_clv_box", "scenario_totals",
          "executive_summary", "clv_horizons", "value_concentration", "ml_features", "calibration_holdout",
          "gateway_products", "segment_transitions",
          "train_test_split", "baseline_metrics", "bgnbd_objective", "gg_objective",
          "event_calibration_holdout"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split():
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_has_an_oracle_or_is_iterative():
    import __spark_entry__ as E
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(sql) == ROWS_ONLY


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import _digest
    sdf = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows)[0] == _digest(dcols, drows)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["Segment", "Count", "Percent"]
    assert abs(sum(r.Percent for r in rows) - 100.0) < 1e-3
