"""Model formulas: special functions, scoring properties, scenario
properties and parameter recovery of both fits on synthetic customers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import FIXED_BGNBD, FIXED_GAMMA_GAMMA, BGNBDParams, Config, GammaGammaParams
from ledgerlens.functions.special import digamma, hyp2f1_numpy, lgamma
from ledgerlens.operators import bgnbd as BG
from ledgerlens.operators import clv as CL
from ledgerlens.operators import gammagamma as GG
from ledgerlens.operators import scenario as SC


def test_hyp2f1_closed_forms():
    z = np.array([0.0, 0.1, 0.5, 0.9, 0.99])
    got = hyp2f1_numpy(1.0, 1.0, 2.0, z)
    exp = np.where(z == 0, 1.0, -np.log1p(-z) / np.where(z == 0, 1, z))
    assert np.allclose(got, exp, rtol=1e-12)
    # 2F1(a, b; b; z) = (1 - z)^-a
    assert np.allclose(hyp2f1_numpy(0.7, 2.5, 2.5, z), (1 - z) ** -0.7, rtol=1e-12)


def test_lgamma_column(spark):
    xs = [1e-3, 0.24, 0.5, 1.0, 2.5, 10.0, 123.4, 5e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.g for r in df.select(lgamma(F.col("x")).alias("g")).collect()]
    for x, g in zip(xs, got):
        assert math.isclose(g, math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)


def _direct_expectation(h, x, t, T, p: BGNBDParams):
    """The textbook form, 2F1(r+x, b+x; a+b+x-1; z), for comparison."""
    z = h / (p.alpha + T + h)
    hyp = hyp2f1_numpy(p.r + x, p.b + x, p.a + p.b + x - 1, np.array([z]))[0]
    first = (p.a + p.b + x - 1) / (p.a - 1)
    second = 1 - ((p.alpha + T) / (p.alpha + T + h)) ** (p.r + x) * hyp
    alive = 1.0 if x == 0 else 1 / (1 + p.a / (p.b + x - 1) * ((p.alpha + T) / (p.alpha + t)) ** (p.r + x))
    return first * second * alive


def test_euler_form_matches_direct_series(spark):
    cases = [(0.0, 0.0, 100.0), (2.0, 50.0, 400.0), (10.0, 300.0, 350.0), (1.0, 5.0, 10.0)]
    df = spark.createDataFrame(cases, "frequency double, recency double, T double")
    for h in (30.0, 180.0):
        got = [r.e for r in df.select(BG.expected_purchases(h, F.col("frequency"), F.col("recency"), F.col("T"),
                                                            FIXED_BGNBD).alias("e")).collect()]
        for (x, t, T), g in zip(cases, got):
            assert math.isclose(g, _direct_expectation(h, x, t, T, FIXED_BGNBD), rel_tol=1e-9)


def test_scoring_properties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        T = float(rng.integers(1, 2000))
        t = float(rng.integers(0, T + 1))
        x = float(rng.integers(0, 20)) if t > 0 else 0.0
        rows.append((str(i), x, t if x > 0 else 0.0, T, float(rng.uniform(0, 5000)) if x > 0 else 0.0))
    s = spark.createDataFrame(rows, "CustomerID string, frequency double, recency double, T double, monetary_value double")
    scored = CL.clv_scores(s, FIXED_BGNBD, FIXED_GAMMA_GAMMA).collect()
    assert all(0.0 <= r.prob_alive <= 1.0 for r in scored)
    assert all(r.predicted_clv >= 0 for r in scored)
    c3 = {r.CustomerID: r.predicted_clv for r in CL.predict_clv(s, FIXED_BGNBD, FIXED_GAMMA_GAMMA, months=3).collect()}
    c12 = {r.CustomerID: r.predicted_clv for r in CL.predict_clv(s, FIXED_BGNBD, FIXED_GAMMA_GAMMA, months=12).collect()}
    assert all(c12[k] >= c3[k] - 1e-9 for k in c3)


def test_scenario_zero_is_identity(spark):
    rows = [(str(i), seg, 100.0 + i, 0.5, 20.0) for i, seg in enumerate(
        ["Champions", "At Risk", "New Customers", "Loyal Customers"])]
    df = spark.createDataFrame(rows, "CustomerID string, Segment string, predicted_clv double, prob_alive double, "
                                     "avg_transaction_value double")
    sim = SC.scenario_clv(df, SC.Scenario(0, 0, 0, 0)).collect()
    for r in sim:
        assert math.isclose(r.simulated_clv, r.predicted_clv, rel_tol=1e-6)
    edges = spark.createDataFrame([("1", "At Risk", 50.0, 0.99, 10.0), ("2", "Champions", 50.0, 1.0, 0.0),
                                   ("3", "At Risk", 50.0, 0.0, 10.0)], df.schema)
    got = {r.CustomerID: r for r in SC.scenario_clv(edges).collect()}
    assert math.isclose(got["1"].sim_prob_alive, 0.95)      # the cap lowers p above 0.95
    assert got["2"].simulated_clv == 0.0                     # v = 0 gives 0
    with pytest.raises(ValueError):
        SC.Scenario(reactivation_pct=60).validate()


def _simulate_bgnbd(n, p: BGNBDParams, rng):
    lam = rng.gamma(p.r, 1.0 / p.alpha, n)
    drop = rng.beta(p.a, p.b, n)
    T = rng.uniform(27, 39, n)
    rows = []
    for i in range(n):
        t, x, last = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1.0 / lam[i])
            if t > T[i]:
                break
            x, last = x + 1, t
            if rng.random() < drop[i]:
                break
        rows.append((str(i), float(x), float(last), float(T[i]), 0.0))
    return rows


@pytest.mark.slow
def test_bgnbd_parameter_recovery(spark):
    truth = BGNBDParams(0.24, 4.4, 0.79, 2.4)
    rows = _simulate_bgnbd(5000, truth, np.random.default_rng(42))
    s = spark.createDataFrame(rows, "CustomerID string, frequency double, recency double, T double, monetary_value double")
    got = BG.bgnbd_fit(s, Config(), penalizer=0.0, fit_all=True, max_iter=100)
    assert abs(got.r - truth.r) / truth.r < 0.10
    assert abs(got.alpha - truth.alpha) / truth.alpha < 0.10
    assert abs(got.a - truth.a) / truth.a < 0.25
    assert abs(got.b - truth.b) / truth.b < 0.25


@pytest.mark.slow
def test_gamma_gamma_parameter_recovery(spark):
    truth = GammaGammaParams(6.0, 4.0, 15.0)
    rng = np.random.default_rng(42)
    rows = []
    for i in range(5000):
        x = int(rng.integers(1, 10))
        nu = rng.gamma(truth.q, 1.0 / truth.v)
        m = rng.gamma(truth.p, 1.0 / nu, x).mean()
        rows.append((str(i), float(x), 0.0, 1.0, float(m)))
    s = spark.createDataFrame(rows, "CustomerID string, frequency double, recency double, T double, monetary_value double")
    got = GG.gg_fit(s, Config(), penalizer=0.0, max_iter=100)
    assert abs(got.q - truth.q) / truth.q < 0.10
    pop = lambda p: p.p * p.v / (p.q - 1)
    assert abs(pop(got) - pop(truth)) / pop(truth) < 0.10
    assert abs(got.p - truth.p) / truth.p < 0.25
    assert abs(got.v - truth.v) / truth.v < 0.25


def test_scenario_grid_matches_single_scenarios(spark):
    rows = [(str(i), seg, 100.0 + 7 * i, 0.3 + 0.05 * (i % 10), 20.0 + i)
            for i, seg in enumerate(["Champions", "At Risk", "New Customers", "Loyal Customers"] * 5)]
    df = spark.createDataFrame(rows, "CustomerID string, Segment string, predicted_clv double, prob_alive double, "
                                     "avg_transaction_value double")
    grid = SC.slider_grid()
    assert len(grid) == len(set(grid))
    got = {(r.reactivation_pct, r.churn_reduction_pct, r.new_conversion_pct, r.value_boost_pct): r.simulated_total
           for r in SC.scenario_grid(df, grid).collect()}
    for sc in grid[:3] + grid[-2:]:
        single = SC.scenario_totals(SC.scenario_clv(df, sc)).first().simulated_total
        key = (float(sc.reactivation_pct), float(sc.churn_reduction_pct), float(sc.new_conversion_pct),
               float(sc.value_boost_pct))
        assert math.isclose(got[key], single, rel_tol=1e-12)


def test_gbt_early_stopping_option(spark):
    from ledgerlens.operators import ml as ML
    rng = np.random.default_rng(3)
    rows = [(str(i), float(x), float(y), float(3 * x + rng.normal())) for i, (x, y) in
            enumerate(zip(rng.normal(size=300), rng.normal(size=300)))]
    df = spark.createDataFrame(rows, "CustomerID string, a double, b double, predicted_clv double")
    full = ML.gbt_fit(df, ["a", "b"])
    early = ML.gbt_fit(df, ["a", "b"], early_stopping=True)
    assert full.stages[-1].getNumTrees == 100
    assert 1 <= early.stages[-1].getNumTrees <= 100
    with pytest.raises(ValueError):
        ML.gbt_model(["a"], loss="huber")


def test_purchase_probabilities_match_the_closed_form(spark):
    from ledgerlens.operators import validation as VA
    p = FIXED_BGNBD
    beta = lambda x, y: math.exp(math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y))

    def prob(x, t):
        gamma = lambda j: math.exp(math.lgamma(p.r + j) - math.lgamma(p.r) - math.lgamma(j + 1))
        rate = lambda j: gamma(j) * (p.alpha / (p.alpha + t)) ** p.r * (t / (p.alpha + t)) ** j
        left = beta(p.a + 1, p.b + x - 1) / beta(p.a, p.b) * (1 - sum(map(rate, range(x)))) if x else 0.0
        return beta(p.a, p.b + x) / beta(p.a, p.b) * rate(x) + left

    ages = [0.0, 1.0, 200.0, 2500.0]
    rows = spark.createDataFrame([(t, float(i)) for i, t in enumerate(ages)], "T double, frequency double")
    got = {r["T"]: r["p"] for r in rows.select("T", VA.purchase_probabilities(F.col("T"), p, 40).alias("p")).collect()}
    for t in ages:
        assert np.allclose(got[t], [prob(x, t) for x in range(40)], atol=1e-10) and sum(got[t]) <= 1 + 1e-9
    out = VA.purchase_count_check(rows, p, most=3).orderBy("purchases").collect()
    assert [(r.purchases, r.is_tail, r.observed) for r in out] == [(0, False, 1), (1, False, 1), (2, False, 1), (3, True, 1)]
    assert sum(r.expected for r in out) == pytest.approx(4)


def test_pages_by_key_equal_pages_by_offset(spark):
    from ledgerlens.operators import views as V
    rng = np.random.default_rng(1)
    rows = [(f"c{i:03d}", float(rng.integers(0, 9)), int(rng.integers(0, 4))) for i in range(200)]
    df = spark.createDataFrame(rows, "CustomerID string, predicted_clv double, Recency int").repartition(4)
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2], r[0]))]
    last, got = None, []
    while page := V.page_after(df, last, size=17).collect():
        got += [r.CustomerID for r in page]
        last = (page[-1].predicted_clv, page[-1].Recency, page[-1].CustomerID)
    assert got == want


@pytest.mark.parametrize("values,width", [([1.0, 99.0], 2.0), ([3.0], 1.0), ([0.1, 0.9], 0.02), ([10.0, 2510.0], 50.0), ([5.0, 5.0], 1.0)])
def test_round_bins(spark, values, width):
    from ledgerlens.operators import views as V
    df = spark.createDataFrame([(v, "s") for v in [*values, -1.0]], "predicted_clv double, Segment string")
    out = V.clv_histogram_rounded(df).collect()
    assert sum(r["count"] for r in out) == len(values)
    assert all(r.bin_end - r.bin_start == pytest.approx(width) for r in out)
    assert sorted(r.bin_start for r in out) == pytest.approx(sorted({math.floor(v / width) * width for v in values}))


def test_digamma_is_the_slope_of_lgamma(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 1.4616321449683623, 2.5, 7.0, 33.3, 1e4]
    euler = 0.5772156649015329
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.g for r in df.select(digamma(F.col("x")).alias("g")).collect()]
    for x, g in zip(xs, got):
        assert math.isclose(g, digamma(x), rel_tol=1e-13, abs_tol=1e-13)
        if x > 0.1:
            h = 1e-5 * x
            assert math.isclose(g, (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel_tol=1e-6, abs_tol=1e-6)
    assert math.isclose(digamma(1.0), -euler, rel_tol=1e-14)
    assert math.isclose(digamma(0.5), -euler - 2 * math.log(2), rel_tol=1e-14)
    # -1/x - euler + x pi^2 / 6 near zero
    assert math.isclose(digamma(1e-6), -1e6 - euler + 1e-6 * math.pi ** 2 / 6, rel_tol=1e-14)


def _equals_differences(evaluate, points, k, h=1e-4):
    for th in map(np.array, points):
        stencil = [th + d * h * e for e in np.eye(k) for d in (-2, -1, 1, 2)]
        values, gradients = evaluate([th, *stencil])
        far_down, down, up, far_up = values[1:].reshape(k, 4).T
        assert np.allclose(gradients[0], (far_down - 8 * down + 8 * up - far_up) / (12 * h), rtol=1e-6, atol=1e-7)


def test_fit_gradients_equal_differences(spark):
    rng = np.random.default_rng(8)
    bg = []
    for x in [*range(0, 30), 200]:
        T = float(rng.uniform(1, 10))
        bg.append((float(x), float(rng.uniform(0, T)) if x else 0.0, T, float(rng.integers(1, 5))))
    rows = spark.createDataFrame(bg, "fx double, ft double, fage double, w double")
    per_x = rows.groupBy("fx").agg(F.sum("w").alias("w"))
    _equals_differences(BG.likelihood(per_x, rows, 77.0, 0.01), [[0, 0, 0, 0], [-1.4, 1.5, -0.2, 0.9], [0.5, -2, -6, 2], [1, 3, 1, -3]], 4)
    gg = [(float(x), float(rng.gamma(2, 0.5)), float(rng.integers(1, 5))) for x in [*range(1, 20), 150]]
    rows = spark.createDataFrame(gg, "x double, m double, w double")
    per_x = rows.groupBy("x").agg(F.sum("w").alias("w"))
    _equals_differences(GG.likelihood(per_x, rows, 50.0, 0.01), [[0, 0, 0], [1.8, 1.4, 2.7], [-2, 1, -1]], 3)


def test_minimizer_on_plain_functions():
    from ledgerlens.operators.optimize import minimize_batched
    calls = []

    def rosenbrock(points):
        calls.append(len(points))
        p = np.array(points)
        x, y = p[:, 0], p[:, 1]
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.stack([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)], 1)
    x, report = minimize_batched(rosenbrock, [-1.2, 1.0], max_iter=200)
    assert np.allclose(x, 1, atol=1e-5) and report.converged and not report.at_bound
    assert len(calls) <= report.iterations + 1 and max(calls) <= 7
    # a slope that never ends stops on the box and says so
    x, report = minimize_batched(lambda p: (np.array([v[0] for v in p]), np.ones((len(p), 1))), [0.0])
    assert report.at_bound and report.converged and x[0] == -25
    # nothing to evaluate
    _, report = minimize_batched(lambda p: (np.full(len(p), np.inf), np.full((len(p), 1), np.nan)), [0.0])
    assert not report.converged


def test_sketches_of_months_merge_to_any_span(spark):
    from ledgerlens.operators import sketches as K
    rows = spark.range(60_000).select(
        F.expr("date_add(date'2024-01-15', cast(id % 12 as int) * 30)").alias("InvoiceDate"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 9_000).cast("string")).alias("CustomerID"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 40).alias("StockCode"))
    months = K.monthly_sketches(rows)
    assert months.count() == 12
    for span in ("month", "quarter", "year"):
        exact = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.to_date(F.date_trunc(span, "InvoiceDate"))).agg(
            F.count_distinct("CustomerID"), F.count_distinct("StockCode")).collect()}
        got = {r[0]: (r[1], r[2]) for r in K.merged_counts(months, span).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(a - b) <= max(1, 0.05 * b) for d in exact for a, b in zip(got[d], exact[d]))
    assert K.merged_counts(K.monthly_sketches(rows.limit(0))).count() == 0
    assert K.sketch_check(rows, months).where("NOT CustomerID_close OR NOT StockCode_close").count() == 0
