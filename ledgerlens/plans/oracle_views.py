"""DuckDB SQL for the views over the customer table, scenario and insights."""

from __future__ import annotations

from ledgerlens.plans.oracle import CUST_SELECT, M, P, R, full, tx_ctes, with_


def _box(src: str, group: str) -> str:
    """Box statistics of predicted_clv per ``group`` over the rows of ``src``."""
    return f"""
, bq AS (
  SELECT {group} AS g, quantile_cont(predicted_clv, 0.25) AS q1, quantile_cont(predicted_clv, 0.5) AS median,
         quantile_cont(predicted_clv, 0.75) AS q3
  FROM {src} GROUP BY {group}
), bf AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM bq
)
SELECT bf.g AS {group}, {M('q1')} AS q1, {M('median')} AS median, {M('q3')} AS q3,
  {M('lower_fence')} AS lower_fence, {M('upper_fence')} AS upper_fence, count(*) AS n,
  {M('min(CASE WHEN s.predicted_clv >= lower_fence AND s.predicted_clv <= upper_fence THEN s.predicted_clv END)')} AS whisker_low,
  {M('max(CASE WHEN s.predicted_clv >= lower_fence AND s.predicted_clv <= upper_fence THEN s.predicted_clv END)')} AS whisker_high,
  count(*) FILTER (WHERE NOT (s.predicted_clv >= lower_fence AND s.predicted_clv <= upper_fence)) AS outliers
FROM {src} s JOIN bf ON s.{group} = bf.g
GROUP BY bf.g, q1, median, q3, lower_fence, upper_fence"""


SECOND_BINS = """
CASE WHEN time_to_second_purchase = -1 THEN 'First Purchase Only'
     WHEN time_to_second_purchase < 0 THEN NULL
     WHEN time_to_second_purchase < 30 THEN '0-29 days'
     WHEN time_to_second_purchase < 60 THEN '30-59 days'
     WHEN time_to_second_purchase < 90 THEN '60-89 days'
     WHEN time_to_second_purchase < 180 THEN '90-179 days'
     WHEN time_to_second_purchase < 365 THEN '180-364 days'
     ELSE '>= 365 days' END"""
SECOND_ORDER = """
CASE WHEN time_to_second_purchase = -1 THEN 6 WHEN time_to_second_purchase < 0 THEN -1
     WHEN time_to_second_purchase < 30 THEN 0 WHEN time_to_second_purchase < 60 THEN 1
     WHEN time_to_second_purchase < 90 THEN 2 WHEN time_to_second_purchase < 180 THEN 3
     WHEN time_to_second_purchase < 365 THEN 4 ELSE 5 END"""
CAT_BINS = """
CASE WHEN category_count < 0 THEN NULL WHEN category_count < 1 THEN '0-0' WHEN category_count < 2 THEN '1-1'
     WHEN category_count < 3 THEN '2-2' WHEN category_count < 5 THEN '3-4' ELSE '>= 5' END"""
CAT_ORDER = """
CASE WHEN category_count < 0 THEN -1 WHEN category_count < 1 THEN 0 WHEN category_count < 2 THEN 1
     WHEN category_count < 3 THEN 2 WHEN category_count < 5 THEN 3 ELSE 4 END"""


def _describe(src: str, cols, fmt) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, {fmt(f'avg({c})')} AS mean,
  {fmt(f'stddev_samp({c})')} AS std, {fmt(f'CAST(min({c}) AS DOUBLE)')} AS min,
  {fmt(f'quantile_cont({c}, 0.25)')} AS p25, {fmt(f'quantile_cont({c}, 0.5)')} AS p50,
  {fmt(f'quantile_cont({c}, 0.75)')} AS p75, {fmt(f'CAST(max({c}) AS DOUBLE)')} AS max FROM {src}""")
    return "\nUNION ALL\n".join(parts)


SCENARIO = """
, sim AS (
  SELECT CustomerID, Segment, predicted_clv, prob_alive, avg_transaction_value,
    CASE WHEN Segment = 'At Risk' THEN least(prob_alive * (1 + 0.1), 0.95)
         WHEN Segment = 'Champions' THEN least(prob_alive + (1 - prob_alive) * 0.15, 1.0)
         ELSE prob_alive END AS sim_prob_alive,
    CASE WHEN Segment IN ('At Risk', 'Champions') THEN avg_transaction_value * (1 + 0.05)
         ELSE avg_transaction_value END AS sim_avg_transaction_value
  FROM cust
), sim1 AS (
  SELECT *, sim_prob_alive / (prob_alive + 1e-09) AS prob_alive_factor,
         sim_avg_transaction_value / (avg_transaction_value + 1e-09) AS value_factor FROM sim
), sim2 AS (
  SELECT *, predicted_clv * prob_alive_factor * value_factor AS s0 FROM sim1
), sim3 AS (
  SELECT * EXCLUDE (s0),
    greatest(CASE WHEN Segment = 'New Customers' THEN s0 * (1 + 0.2) ELSE s0 END, 0.0) AS simulated_clv FROM sim2
)"""


def view_sql() -> dict[str, str]:
    from ledgerlens.operators.insights import SEGMENT_ACTIONS

    f = full()
    q: dict[str, str] = {}
    q["segment_rfm_means"] = f + f"""SELECT Segment, {P('avg(Recency)')} AS Recency,
  {P('avg(Frequency)')} AS Frequency, {P('avg(Monetary)')} AS Monetary FROM cust GROUP BY Segment"""
    q["segment_clv_mean"] = f + f"SELECT Segment, {M('avg(predicted_clv)')} AS predicted_clv FROM cust GROUP BY Segment"
    q["segment_clv_sum"] = f + f"""SELECT Segment, {M('sum(predicted_clv)')} AS predicted_clv,
  GROUPING(Segment) = 1 AS is_total FROM cust GROUP BY ROLLUP (Segment)"""
    q["segment_value_share"] = f + f""", s AS (SELECT Segment, sum(predicted_clv) AS v FROM cust GROUP BY Segment)
SELECT Segment, {M('v')} AS predicted_clv,
  {P('CASE WHEN sum(v) OVER () > 0 THEN v / sum(v) OVER () * 100 ELSE 0.0 END')} AS percent FROM s"""
    q["kpis"] = f + f"""SELECT {M('coalesce(sum(predicted_clv), 0.0)')} AS total_clv,
  {M('coalesce(avg(CASE WHEN predicted_clv > 0 THEN predicted_clv END), 0.0)')} AS avg_clv_positive,
  count(DISTINCT CustomerID) AS customers,
  {P('coalesce(avg(CASE WHEN prob_alive > 0 THEN prob_alive END), 0.0)')} AS avg_prob_alive_positive FROM cust"""
    q["top_segment"] = f + f""", s AS (SELECT Segment, sum(predicted_clv) AS v FROM cust GROUP BY Segment)
SELECT Segment AS top_segment, {M('v')} AS top_segment_clv,
  {P('CASE WHEN (SELECT sum(v) FROM s) > 0 THEN v / (SELECT sum(v) FROM s) * 100 ELSE 0.0 END')} AS top_segment_pct
FROM s ORDER BY v DESC, Segment LIMIT 1"""
    risk = f""", a AS (
  SELECT coalesce(sum(CASE WHEN Segment = 'At Risk' THEN predicted_clv END), 0.0) AS at_risk_clv,
    coalesce(sum(predicted_clv), 0.0) AS total, count(*) FILTER (WHERE Segment = 'At Risk') AS at_risk_customers
  FROM cust)"""
    q["at_risk_value"] = f + risk + f"""
SELECT {M('at_risk_clv')} AS at_risk_clv, {P('CASE WHEN total > 0 THEN at_risk_clv * 100 / total ELSE 0.0 END')} AS at_risk_pct,
  at_risk_customers,
  {M('CASE WHEN at_risk_customers > 0 THEN at_risk_clv / at_risk_customers ELSE 0.0 END')} AS avg_at_risk_clv,
  {M('at_risk_clv * 0.15')} AS recovery_value FROM a"""
    eff = """, e AS (
  SELECT coalesce(avg(CASE WHEN time_to_second_purchase <= 30 AND time_to_second_purchase >= 0 THEN predicted_clv END), 0.0) AS early_avg_clv,
    coalesce(avg(CASE WHEN time_to_second_purchase > 30 THEN predicted_clv END), 0.0) AS late_avg_clv,
    coalesce(avg(CASE WHEN category_count >= 3 THEN predicted_clv END), 0.0) AS diverse_avg_clv,
    coalesce(avg(CASE WHEN category_count < 3 THEN predicted_clv END), 0.0) AS limited_avg_clv
  FROM cust)"""
    early = "CASE WHEN late_avg_clv > 0 THEN (early_avg_clv - late_avg_clv) * 100 / late_avg_clv ELSE 0.0 END"
    diverse = "CASE WHEN limited_avg_clv > 0 THEN (diverse_avg_clv - limited_avg_clv) * 100 / limited_avg_clv ELSE 0.0 END"
    q["driver_effects"] = f + eff + f"""
SELECT {M('early_avg_clv')} AS early_avg_clv, {M('late_avg_clv')} AS late_avg_clv, {R(early, 3)} AS early_impact_pct,
  {M('diverse_avg_clv')} AS diverse_avg_clv, {M('limited_avg_clv')} AS limited_avg_clv,
  {R(diverse, 3)} AS diversity_impact_pct FROM e"""
    spr = """, r AS (
  SELECT count(*) FILTER (WHERE Segment = 'New Customers') AS new_customers,
         count(*) FILTER (WHERE Frequency > 1) AS repeat_customers FROM cust)"""
    rate = ("CASE WHEN new_customers + repeat_customers > 0 THEN repeat_customers * 100.0 / "
            "(new_customers + repeat_customers) ELSE 0.0 END")
    q["second_purchase_rate"] = f + spr + f"\nSELECT new_customers, repeat_customers, {P(rate)} AS second_purchase_rate FROM r"
    q["segment_profile"] = f + f""", m AS (
  SELECT Segment, avg(R_Score) AS R_Score, avg(F_Score) AS F_Score, avg(M_Score) AS M_Score,
         avg(predicted_clv) AS predicted_clv, avg(prob_alive) AS prob_alive FROM cust GROUP BY Segment),
mm AS (SELECT *, max(predicted_clv) OVER () AS mx FROM m)
SELECT Segment, {P('R_Score')} AS R_Score, {P('F_Score')} AS F_Score, {P('M_Score')} AS M_Score,
  {M('predicted_clv')} AS predicted_clv, {P('prob_alive')} AS prob_alive,
  {P('CASE WHEN mx > 0 THEN 1 + 4 * (predicted_clv / mx) ELSE 1.0 END')} AS CLV_Score,
  {P('1 + 4 * prob_alive')} AS Active_Score FROM mm"""
    q["segment_prob_active"] = f + f"SELECT Segment, {P('avg(prob_alive)')} AS prob_alive FROM cust GROUP BY Segment"
    q["positive_clv"] = f + f"SELECT {CUST_SELECT} FROM cust WHERE predicted_clv > 0"
    q["clv_histogram"] = f + f""", pos AS (SELECT * FROM cust WHERE predicted_clv > 0),
rng AS (SELECT min(predicted_clv) AS lo, max(predicted_clv) AS hi, (max(predicted_clv) - min(predicted_clv)) / 50 AS w FROM pos),
b AS (
  SELECT CAST(CASE WHEN w > 0 THEN least(floor((predicted_clv - lo) / w), 49) ELSE 0 END AS INTEGER) AS bin, Segment, lo, w
  FROM pos, rng)
SELECT bin, Segment, count(*) AS count, {M('lo + bin * w')} AS bin_start, {M('lo + (bin + 1) * w')} AS bin_end
FROM b GROUP BY bin, Segment, lo, w"""
    q["clv_histogram_rounded"] = f + f""", pos AS (SELECT * FROM cust WHERE predicted_clv > 0),
raw AS (SELECT (max(predicted_clv) - min(predicted_clv)) / 50 AS raw, pow(10.0, floor(log10(nullif(raw, 0)))) AS tens FROM pos),
wid AS (SELECT CASE WHEN raw <= 0 THEN 1.0 WHEN raw <= tens THEN tens WHEN raw <= 2 * tens THEN 2 * tens WHEN raw <= 5 * tens THEN 5 * tens
               ELSE 10 * tens END AS w FROM raw),
b AS (SELECT floor(predicted_clv / w) AS bin, w, Segment, count(*) AS count FROM pos, wid GROUP BY ALL)
SELECT {M('bin * w')} AS bin_start, {M('(bin + 1) * w')} AS bin_end, Segment, count FROM b"""
    q["segment_clv_box"] = f + ", pos AS (SELECT * FROM cust WHERE predicted_clv > 0)" + _box("pos", "Segment")
    q["driver_bins_second_purchase"] = f + f"""SELECT CustomerID, time_to_second_purchase, {M('predicted_clv')} AS predicted_clv,
  {SECOND_BINS} AS time_to_second_purchase_binned, {SECOND_ORDER} AS bin_order FROM cust WHERE predicted_clv > 0"""
    q["driver_bins_category"] = f + f"""SELECT CustomerID, category_count, {M('predicted_clv')} AS predicted_clv,
  {CAT_BINS} AS category_count_binned, {CAT_ORDER} AS bin_order FROM cust WHERE predicted_clv > 0"""
    q["driver_values_category"] = f + f"""SELECT CustomerID, category_count, {M('predicted_clv')} AS predicted_clv,
  CAST(category_count AS VARCHAR) AS category_count_binned, category_count AS bin_order FROM cust WHERE predicted_clv > 0"""
    q["driver_comparison"] = f + f""", pos AS (SELECT *, {SECOND_BINS} AS time_to_second_purchase_binned
  FROM cust WHERE predicted_clv > 0)""" + _box("pos", "time_to_second_purchase_binned")
    q["driver_clv_box"] = f + f""", pos AS (SELECT *, {CAT_BINS} AS category_count_binned
  FROM cust WHERE predicted_clv > 0)""" + _box("pos", "category_count_binned")
    q["segment_drilldown"] = f + f"SELECT {CUST_SELECT} FROM cust WHERE Segment = 'At Risk'"
    detail = f"""CustomerID, Segment, Recency, Frequency, {M('Monetary')} AS Monetary, R_Score, F_Score, M_Score,
  {M('predicted_clv')} AS predicted_clv, {P('prob_alive')} AS prob_alive, category_count, time_to_second_purchase"""
    q["customer_detail"] = f + f"SELECT {detail} FROM cust"
    q["customer_table_query"] = f + f"""SELECT {detail} FROM cust WHERE Frequency >= 2
ORDER BY predicted_clv DESC, Recency ASC, CustomerID ASC LIMIT 15"""
    q["rfm_scatter"] = f + f"""SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary, Segment,
  {M('predicted_clv')} AS predicted_clv, CAST(CASE WHEN Segment = 'Champions' THEN 1.0 ELSE 0.3 END AS DOUBLE) AS opacity,
  CASE WHEN Segment = 'Champions' THEN 10 ELSE 6 END AS size FROM cust"""
    q["rfm_describe"] = f + _describe("rfm", ["Recency", "Frequency", "Monetary"], P)
    q["clv_describe"] = f + _describe("cust", ["predicted_clv"], M)
    q["rfm_projection"] = f + f"""SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary, R_Score, F_Score,
  M_Score, RFM_Score, Segment FROM cust"""
    values = ", ".join(
        "('" + seg.replace("'", "''") + "', [" + ", ".join("'" + a.replace("'", "''") + "'" for a in acts) + "])"
        for seg, acts in SEGMENT_ACTIONS.items())
    q["segment_strategies"] = f + f""", lookup AS (SELECT * FROM (VALUES {values}) t(Segment, actions)),
per AS (SELECT Segment, count(*) AS customers, sum(predicted_clv) AS v FROM cust GROUP BY Segment)
SELECT per.Segment, customers, {M('v')} AS predicted_clv, lookup.actions FROM per LEFT JOIN lookup ON per.Segment = lookup.Segment"""
    q["executive_summary"] = f + risk + eff + spr + f""", s AS (SELECT Segment, sum(predicted_clv) AS v FROM cust GROUP BY Segment),
t AS (SELECT Segment AS top_segment,
        CASE WHEN (SELECT sum(v) FROM s) > 0 THEN v / (SELECT sum(v) FROM s) * 100 ELSE 0.0 END AS top_segment_pct
      FROM s ORDER BY v DESC, Segment LIMIT 1),
m AS (
  SELECT coalesce((SELECT top_segment FROM t), 'N/A') AS top_segment,
    {M("coalesce((SELECT top_segment_pct FROM t), 0.0)")} AS top_segment_pct,
    {M('at_risk_clv')} AS at_risk_clv, {M('CASE WHEN total > 0 THEN at_risk_clv * 100 / total ELSE 0.0 END')} AS at_risk_pct,
    {M('CASE WHEN at_risk_customers > 0 THEN at_risk_clv / at_risk_customers ELSE 0.0 END')} AS avg_at_risk_clv,
    {M('at_risk_clv * 0.15')} AS recovery_value,
    {M(early)} AS early_impact_pct, {M(diverse)} AS diversity_impact_pct,
    {R1(rate)} AS second_purchase_rate, {R1(early)} AS early_1
  FROM a, e, r)
SELECT top_segment, top_segment_pct, at_risk_clv, at_risk_pct, avg_at_risk_clv, recovery_value, early_impact_pct,
  diversity_impact_pct, second_purchase_rate,
  printf('The ''%s'' segment contributes %.2f%% of total predicted 12-Month CLV, representing our highest-value customer group.', top_segment, top_segment_pct) AS insight_top_segment,
  printf('''At Risk'' customers represent £%s (%.2f%%) in potential CLV that could be lost without intervention.', format('{{:,.2f}}', at_risk_clv), at_risk_pct) AS insight_at_risk,
  printf('Customers making a second purchase within 30 days show %+.2f%% higher average CLV than those who take longer.', early_impact_pct) AS insight_early,
  printf('Customers purchasing from 3+ categories have %+.2f%% higher average CLV than those with limited category exposure.', diversity_impact_pct) AS insight_diversity,
  printf('Targeting ''At Risk'' customers (avg. predicted CLV £%.2f) with uplift-modelled campaigns could recover £%s of potential value, based on a conservative 15%% success rate.', avg_at_risk_clv, format('{{:,.2f}}', recovery_value)) AS insight_recovery,
  printf('Currently, only %.1f%% of new customers make a second purchase. Accelerating second purchases for ''New Customers'' could boost their segment CLV by an estimated %.1f%% based on our driver analysis.', second_purchase_rate, early_1) AS insight_second_purchase
FROM m"""
    q["scenario_clv"] = f + SCENARIO + f"""
SELECT CustomerID, Segment, {M('predicted_clv')} AS predicted_clv, {P('prob_alive')} AS prob_alive,
  {P('sim_prob_alive')} AS sim_prob_alive, {P('prob_alive_factor')} AS prob_alive_factor,
  {P('value_factor')} AS value_factor, {M('simulated_clv')} AS simulated_clv FROM sim3"""
    q["scenario_totals"] = f + SCENARIO + f""", tt AS (SELECT sum(predicted_clv) AS o, sum(simulated_clv) AS s FROM sim3),
ch AS (SELECT o, s, (s - o) / (o + 1e-09) * 100 AS c FROM tt)
SELECT {M('o')} AS original_total, {M('s')} AS simulated_total, {P('c')} AS change_pct,
  CASE WHEN c > 0.1 THEN 'up' WHEN c < -0.1 THEN 'down' ELSE 'flat' END AS direction FROM ch"""
    q["scenario_segment_share"] = f + SCENARIO + f""", s AS (SELECT Segment, sum(simulated_clv) AS v FROM sim3 GROUP BY Segment)
SELECT Segment, {M('v')} AS predicted_clv,
  {P('CASE WHEN sum(v) OVER () > 0 THEN v / sum(v) OVER () * 100 ELSE 0.0 END')} AS percent FROM s"""
    q["load_customer_table"] = f + f"SELECT {CUST_SELECT} FROM cust"
    from ledgerlens.operators.scenario import slider_grid
    grid = ", ".join(f"({float(g.reactivation_pct)}, {float(g.churn_reduction_pct)}, {float(g.new_conversion_pct)}, "
                     f"{float(g.value_boost_pct)})" for g in slider_grid())
    q["scenario_grid"] = f + f""", g AS (SELECT * FROM (VALUES {grid}) t(ra, cr, nc, vb)),
gs AS (
  SELECT g.ra, g.cr, g.nc, g.vb, c.Segment, c.predicted_clv,
    CASE WHEN c.Segment = 'At Risk' THEN least(c.prob_alive * (1 + g.ra / 100.0), 0.95)
         WHEN c.Segment = 'Champions' THEN least(c.prob_alive + (1 - c.prob_alive) * (g.cr / 100.0), 1.0)
         ELSE c.prob_alive END / (c.prob_alive + 1e-09) AS pf,
    CASE WHEN c.Segment IN ('At Risk', 'Champions') THEN c.avg_transaction_value * (1 + g.vb / 100.0)
         ELSE c.avg_transaction_value END / (c.avg_transaction_value + 1e-09) AS vf
  FROM cust c, g),
gsim AS (
  SELECT ra, cr, nc, vb, predicted_clv,
    greatest(CASE WHEN Segment = 'New Customers' THEN predicted_clv * pf * vf * (1 + nc / 100.0)
                  ELSE predicted_clv * pf * vf END, 0.0) AS s FROM gs)
SELECT CAST(ra AS DOUBLE) AS reactivation_pct, CAST(cr AS DOUBLE) AS churn_reduction_pct,
  CAST(nc AS DOUBLE) AS new_conversion_pct, CAST(vb AS DOUBLE) AS value_boost_pct,
  {M('sum(predicted_clv)')} AS original_total, {M('sum(s)')} AS simulated_total,
  {P('(sum(s) - sum(predicted_clv)) / (sum(predicted_clv) + 1e-09) * 100')} AS change_pct
FROM gsim GROUP BY ra, cr, nc, vb"""
    cols = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country", "TotalPrice"]
    types = ("CASE typeof({c}) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' "
             "WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({c})) END")
    q["schema_info"] = with_(tx_ctes(True)) + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {types.format(c='any_value(' + c + ')')} AS dtype, count({c}) AS non_null FROM clean"
        for c in cols)
    return q


def R1(expr: str) -> str:
    from ledgerlens.plans.oracle import R
    return R(expr, 1)
