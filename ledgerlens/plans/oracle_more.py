"""DuckDB SQL for cleaning diagnostics, appendix variants, exploratory
metrics, model checks and engineered features."""

from __future__ import annotations

from ledgerlens.config import FIXED_BGNBD, FIXED_GAMMA_GAMMA, BGNBDParams
from ledgerlens.plans.oracle import (BASE, CUST, DRIVERS, SUMMARY, M, P, R, _fixed, clv_ctes, expected_sql,
                                     floor_days, full, prob_alive_sql, rfm_ctes, tx_ctes, value_sql, with_)

RAW_COLS = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]
WC = "txn WHERE CustomerID IS NOT NULL"


def _concentration(src: str, value: str) -> str:
    shares = (0.01, 0.1, 0.2, 0.5)
    cols = ", ".join(
        f"{P(f'coalesce(sum(CASE WHEN rn - 1 < n * {p} THEN {value} END) / sum({value}), 0.0)')} AS top_{int(p * 100)}_pct"
        for p in shares)
    bottom = P(f"1 - coalesce(sum(CASE WHEN rn - 1 < n * 0.5 THEN {value} END) / sum({value}), 0.0)")
    return f""", ranked AS (
  SELECT {value}, row_number() OVER (ORDER BY {value} DESC, CustomerID) AS rn, count(*) OVER () AS n FROM {src})
SELECT {cols}, {bottom} AS bottom_50_pct FROM ranked"""


def _horizon_ctes(cfg_margin: float = 0.4, discount: float = 0.1 / 12, horizons=(3, 6, 12)) -> str:
    bg, gg = _fixed()
    bgm = BGNBDParams(bg.r, bg.alpha / 30.0, bg.a, bg.b)
    top = max(horizons)
    t, T = "(recency / 30.0)", "(T / 30.0)"
    clv_cols = ", ".join(
        f"{cfg_margin!r} * sum(CASE WHEN i <= {h} THEN em * (ex - ex_prev) / pow({1.0 + discount!r}, i) END) AS CLV_{h}months"
        for h in horizons)
    purch = ", ".join(f"max(CASE WHEN i = {h} THEN ex END) AS predicted_purch_{h}m" for h in horizons)
    return f"""
hz AS (SELECT CustomerID, frequency, recency, T, monetary_value, unnest(range(1, {top + 1})) AS i FROM summ),
hze AS (
  SELECT CustomerID, i, {value_sql('frequency', 'monetary_value', gg)} AS em,
    {expected_sql('CAST(i AS DOUBLE)', 'frequency', t, T, bgm)} AS ex FROM hz),
hzl AS (SELECT *, coalesce(lag(ex) OVER (PARTITION BY CustomerID ORDER BY i), 0.0) AS ex_prev FROM hze),
hzc AS (SELECT CustomerID, {purch}, {clv_cols} FROM hzl GROUP BY CustomerID),
horizons AS (
  SELECT s.CustomerID, {prob_alive_sql('s.frequency', '(s.recency / 30.0)', '(s.T / 30.0)', bgm)} AS prob_alive,
    {value_sql('s.frequency', 's.monetary_value', gg)} AS predicted_avg_value,
    {', '.join(f'c.predicted_purch_{h}m, c.CLV_{h}months' for h in horizons)}, v.Segment
  FROM summ s JOIN hzc c ON s.CustomerID = c.CustomerID JOIN v2rfm v ON s.CustomerID = v.CustomerID
)"""


def _features_ctes() -> str:
    return f"""
tdl AS (
  SELECT CustomerID, InvoiceDate, Quantity, StockCode, TotalPrice,
    CAST(coalesce({floor_days('lag(InvoiceDate) OVER (PARTITION BY CustomerID ORDER BY InvoiceDate)', 'InvoiceDate')}, 0) AS DOUBLE) AS TimeDiff
  FROM clean),
mx AS (SELECT max(InvoiceDate) AS max_date FROM clean),
per AS (
  SELECT CustomerID, avg(TimeDiff) AS MeanTimeBetweenPurchases, coalesce(stddev_samp(TimeDiff), 0.0) AS StdTimeBetweenPurchases,
    avg(Quantity) AS AvgOrderQuantity, sum(Quantity) AS TotalQuantity, count(DISTINCT StockCode) AS UniqueProducts,
    min(InvoiceDate) AS FirstPurchase, max(InvoiceDate) AS LastPurchase, count(*) AS lines,
    count(DISTINCT CASE WHEN InvoiceDate >= (SELECT max_date FROM mx) - INTERVAL 90 DAY THEN InvoiceDate END) AS recent
  FROM tdl GROUP BY CustomerID),
inv AS (SELECT CustomerID, InvoiceNo, sum(TotalPrice) AS v FROM clean GROUP BY CustomerID, InvoiceNo),
ostd AS (SELECT CustomerID, stddev_samp(v) AS AvgOrderValueStdDev FROM inv GROUP BY CustomerID),
feats0 AS (
  SELECT r.CustomerID, r.Recency, r.Frequency, r.Monetary, r.R_Score, r.F_Score, r.M_Score, r.RFM_Score, r.Segment,
    p.MeanTimeBetweenPurchases, p.StdTimeBetweenPurchases, p.AvgOrderQuantity, p.TotalQuantity, p.UniqueProducts,
    p.FirstPurchase, p.LastPurchase,
    {floor_days('p.FirstPurchase', '(SELECT max_date FROM mx)')} AS DaysSinceFirstPurchase,
    {floor_days('p.FirstPurchase', 'p.LastPurchase')} AS CustomerTenure,
    CASE WHEN p.recent > 0 THEN p.recent END AS PurchaseCountLast3Months,
    least(p.UniqueProducts / p.lines, 1.0) AS CategoryDiversityIndex,
    o.AvgOrderValueStdDev
  FROM rfm r LEFT JOIN per p ON r.CustomerID = p.CustomerID LEFT JOIN ostd o ON r.CustomerID = o.CustomerID),
feats AS (
  SELECT CustomerID, CAST(Recency AS DOUBLE) AS Recency, CAST(Frequency AS DOUBLE) AS Frequency, Monetary,
    CAST(R_Score AS DOUBLE) AS R_Score, CAST(F_Score AS DOUBLE) AS F_Score, CAST(M_Score AS DOUBLE) AS M_Score,
    RFM_Score, Segment, MeanTimeBetweenPurchases, StdTimeBetweenPurchases, AvgOrderQuantity, TotalQuantity,
    CAST(UniqueProducts AS DOUBLE) AS UniqueProducts, FirstPurchase, LastPurchase,
    CAST(DaysSinceFirstPurchase AS DOUBLE) AS DaysSinceFirstPurchase, CAST(CustomerTenure AS DOUBLE) AS CustomerTenure,
    coalesce(CAST(PurchaseCountLast3Months AS DOUBLE), (SELECT quantile_cont(PurchaseCountLast3Months, 0.5) FROM feats0))
      AS PurchaseCountLast3Months,
    CategoryDiversityIndex,
    coalesce(AvgOrderValueStdDev, (SELECT quantile_cont(AvgOrderValueStdDev, 0.5) FROM feats0)) AS AvgOrderValueStdDev
  FROM feats0)"""


FEATURE_RATIO = ["MeanTimeBetweenPurchases", "StdTimeBetweenPurchases", "AvgOrderQuantity", "TotalQuantity",
                 "PurchaseCountLast3Months", "AvgOrderValueStdDev", "CategoryDiversityIndex"]


def more_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    b = with_(BASE)
    q["tx_normalized"] = b + f"""SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, {M('UnitPrice')} AS UnitPrice,
  CustomerID, {M('TotalPrice')} AS TotalPrice FROM txn"""
    q["null_counts"] = b + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM tx" for c in RAW_COLS)
    q["cleaning_audit"] = b + """, a AS (
  SELECT count(*) AS raw_rows, count(*) FILTER (WHERE CustomerID IS NOT NULL) AS rows_with_customer,
    count(*) FILTER (WHERE CustomerID IS NOT NULL AND Quantity > 0) AS rows_positive_quantity,
    count(*) FILTER (WHERE CustomerID IS NOT NULL AND Quantity > 0 AND UnitPrice > 0) AS rows_positive_price,
    (SELECT count(*) FROM clean) AS clean_rows FROM txn)
SELECT raw_rows, rows_with_customer, rows_positive_quantity, rows_positive_price, clean_rows,
  raw_rows - rows_with_customer AS removed_missing_customer,
  rows_with_customer - rows_positive_quantity AS removed_nonpositive_quantity,
  rows_positive_quantity - rows_positive_price AS removed_nonpositive_price,
  rows_positive_price - clean_rows AS removed_duplicates FROM a"""
    q["returns_lines"] = b + f"SELECT count(*) FILTER (WHERE Quantity < 0) AS return_lines FROM {WC}"
    q["zero_price_lines"] = b + f"SELECT count(*) FILTER (WHERE UnitPrice = 0) AS zero_price_lines FROM {WC}"
    q["cancelled_lines"] = b + f"""SELECT count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) AS cancelled_lines,
  count(DISTINCT CASE WHEN starts_with(InvoiceNo, 'C') THEN InvoiceNo END) AS cancelled_invoices FROM {WC}"""
    q["duplicate_count"] = b + f"""SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM {WC} GROUP BY ALL_COLUMNS)""".replace(
        "GROUP BY ALL_COLUMNS", "GROUP BY InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID, TotalPrice")
    fences = f""", w AS (SELECT * FROM {WC}),
qs AS (SELECT quantile_cont(Quantity, 0.25) AS qq1, quantile_cont(Quantity, 0.75) AS qq3,
              quantile_cont(UnitPrice, 0.25) AS pq1, quantile_cont(UnitPrice, 0.75) AS pq3 FROM w),
f AS (SELECT qq1 - 1.5 * (qq3 - qq1) AS ql, qq3 + 1.5 * (qq3 - qq1) AS qh,
             pq1 - 1.5 * (pq3 - pq1) AS pl, pq3 + 1.5 * (pq3 - pq1) AS ph FROM qs)"""
    q["iqr_outliers"] = b + fences + f"""
SELECT {P('ql')} AS quantity_lower, {P('qh')} AS quantity_upper, {P('pl')} AS price_lower, {P('ph')} AS price_upper,
  count(*) FILTER (WHERE Quantity < ql OR Quantity > qh) AS quantity_outliers,
  count(*) FILTER (WHERE UnitPrice < pl OR UnitPrice > ph) AS price_outliers
FROM w, f GROUP BY ql, qh, pl, ph"""
    q["iqr_price_outlier_lines"] = b + fences + f"""
SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, {M('UnitPrice')} AS UnitPrice, CustomerID, {M('TotalPrice')} AS TotalPrice,
  {P('pl')} AS lower_bound, {P('ph')} AS upper_bound FROM w, f WHERE UnitPrice < pl OR UnitPrice > ph"""
    q["bulk_and_pricey"] = b + f"""SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, {M('UnitPrice')} AS UnitPrice,
  CustomerID, {M('TotalPrice')} AS TotalPrice, Quantity > 10000 AS is_bulk, UnitPrice > 500 AS is_pricey FROM txn"""
    q["distinct_customers"] = b + "SELECT count(DISTINCT CustomerID) AS customers FROM clean"
    q["tx_clean_appendix"] = b + f"""SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, {M('UnitPrice')} AS UnitPrice,
  CustomerID, {M('TotalPrice')} AS TotalPrice FROM {WC} AND Quantity > 0 AND NOT starts_with(InvoiceNo, 'C')"""

    # appendix variants
    v2 = rfm_ctes("clean", "v2", "appendix")
    q["rfm_segments_v2"] = with_(BASE, v2) + f"""SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary,
  R_Score, F_Score, M_Score, RFM_Score, Segment FROM v2rfm"""
    q["segment_stats"] = with_(BASE, v2) + f"""SELECT Segment, {P('avg(Recency)')} AS Recency_mean,
  {P('avg(Frequency)')} AS Frequency_mean, {P('avg(Monetary)')} AS Monetary_mean, count(*) AS count,
  {P('quantile_cont(Recency, 0.5)')} AS Recency_median, {P('quantile_cont(Frequency, 0.5)')} AS Frequency_median,
  {P('quantile_cont(Monetary, 0.5)')} AS Monetary_median FROM v2rfm GROUP BY Segment"""
    hz = with_(BASE, v2, SUMMARY, _horizon_ctes())
    hsel = f"""CustomerID, {P('prob_alive')} AS prob_alive, {R('predicted_avg_value', 4)} AS predicted_avg_value,
  {P('predicted_purch_3m')} AS predicted_purch_3m, {M('CLV_3months')} AS CLV_3months,
  {P('predicted_purch_6m')} AS predicted_purch_6m, {M('CLV_6months')} AS CLV_6months,
  {P('predicted_purch_12m')} AS predicted_purch_12m, {M('CLV_12months')} AS CLV_12months, Segment"""
    q["clv_horizons"] = hz + f"SELECT {hsel} FROM horizons"
    aggs = ["count(*) AS count"]
    for c in ("CLV_3months", "CLV_6months", "CLV_12months"):
        aggs += [f"{M(f'avg({c})')} AS {c}_mean", f"{M(f'sum({c})')} AS {c}_sum",
                 f"{M(f'quantile_cont({c}, 0.5)')} AS {c}_median"]
    aggs += [f"{P('avg(prob_alive)')} AS prob_alive_mean", f"{P('quantile_cont(prob_alive, 0.5)')} AS prob_alive_median"]
    q["segment_clv_horizons"] = hz + f"SELECT Segment, {', '.join(aggs)} FROM horizons GROUP BY Segment"
    q["customer_avg_line_value"] = b + f"""SELECT CustomerID, {R('avg(TotalPrice)', 7)} AS avg_transaction_value
FROM {WC} AND Quantity > 0 AND NOT starts_with(InvoiceNo, 'C') GROUP BY CustomerID"""
    q["clv_total_12m"] = hz + f"SELECT {M('sum(CLV_12months)')} AS total_12m_value FROM horizons"
    q["customer_age"] = b + f""", snapa AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS s FROM {WC}),
firsts AS (SELECT CustomerID, min(InvoiceDate) AS FirstPurchaseDate FROM {WC} AND Quantity > 0
           AND NOT starts_with(InvoiceNo, 'C') GROUP BY CustomerID)
SELECT CustomerID, FirstPurchaseDate, {floor_days('FirstPurchaseDate', '(SELECT s FROM snapa)')} AS T FROM firsts"""
    q["clv_cumulative"] = hz + f"""SELECT CustomerID, {M('CLV_12months')} AS CLV_12months,
  {P('sum(CLV_12months) OVER (ORDER BY CLV_12months DESC, CustomerID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(CLV_12months) OVER ()')} AS cum_pct
FROM horizons"""
    q["value_concentration"] = hz.rstrip("\n") + _concentration("horizons", "CLV_12months")

    # exploratory metrics
    bc = with_(tx_ctes(True))
    q["dataset_profile"] = bc + f""", r AS (
  SELECT count(*) FILTER (WHERE Quantity < 0) / count(*) * 100 AS return_rate,
         count(*) FILTER (WHERE CustomerID IS NULL) / count(*) * 100 AS missing_customer_pct FROM txn),
a AS (SELECT min(InvoiceDate) AS first_date, max(InvoiceDate) AS last_date, count(DISTINCT CustomerID) AS customers,
        count(DISTINCT InvoiceNo) AS invoices, count(*) AS lines, sum(TotalPrice) AS rev,
        count(DISTINCT Country) AS countries FROM clean)
SELECT first_date, last_date, {floor_days('first_date', 'last_date')} AS span_days, customers, invoices, lines, countries,
  {P('lines / invoices')} AS lines_per_invoice, {P('rev / invoices')} AS value_per_invoice,
  {P('return_rate')} AS return_rate, {P('missing_customer_pct')} AS missing_customer_pct FROM a, r"""
    q["sales_by_weekday"] = b + f""", g AS (
  SELECT dayofweek(InvoiceDate) + 1 AS weekday, dayname(InvoiceDate) AS weekday_name, count(*) AS lines,
    count(DISTINCT InvoiceNo) AS invoices, sum(TotalPrice) AS revenue FROM clean GROUP BY 1, 2)
SELECT CAST(weekday AS INTEGER) AS weekday, weekday_name, lines, invoices, {M('revenue')} AS revenue,
  {P('CASE WHEN sum(revenue) OVER () > 0 THEN revenue / sum(revenue) OVER () * 100 ELSE 0.0 END')} AS revenue_share FROM g"""
    q["sales_by_month"] = b + f""", g AS (
  SELECT CAST(date_trunc('month', InvoiceDate) AS DATE) AS month, sum(TotalPrice) AS revenue,
    count(DISTINCT InvoiceNo) AS invoices, count(DISTINCT CustomerID) AS customers FROM clean GROUP BY 1),
l AS (SELECT *, lag(revenue) OVER (ORDER BY month) AS prev FROM g)
SELECT month, {M('revenue')} AS revenue, invoices, customers,
  {P('CASE WHEN prev > 0 THEN (revenue - prev) / prev * 100 END')} AS revenue_change_pct FROM l"""
    q["sales_by_quarter"] = b + f""", g AS (
  SELECT CAST(date_trunc('quarter', InvoiceDate) AS DATE) AS quarter, sum(TotalPrice) AS revenue,
    count(DISTINCT InvoiceNo) AS invoices, count(*) AS lines FROM clean GROUP BY 1),
l AS (SELECT *, lag(revenue) OVER (ORDER BY quarter) AS pr, lag(invoices) OVER (ORDER BY quarter) AS pi FROM g)
SELECT quarter, {M('revenue')} AS revenue, invoices, lines,
  {P('CASE WHEN pr > 0 THEN (revenue - pr) / pr * 100 END')} AS revenue_change_pct,
  {P('CASE WHEN pi > 0 THEN (invoices - pi) / pi * 100 END')} AS invoice_change_pct FROM l"""
    q["distinct_sketch_check"] = b + """SELECT CAST(date_trunc('quarter', InvoiceDate) AS DATE) AS quarter,
  count(DISTINCT CustomerID) AS CustomerID_exact, count(DISTINCT StockCode) AS StockCode_exact,
  true AS CustomerID_close, true AS StockCode_close FROM clean GROUP BY 1"""
    q["country_share"] = bc + f"""SELECT Country, count(DISTINCT CustomerID) AS customers,
  {P('count(DISTINCT CustomerID) / (SELECT count(DISTINCT CustomerID) FROM clean) * 100')} AS percent
FROM clean GROUP BY Country"""
    band_r = "CASE WHEN Recency <= 30 THEN '0-30 days' WHEN Recency <= 90 THEN '31-90 days' ELSE '90+ days' END"
    band_f = "CASE WHEN Frequency <= 1 THEN '1' WHEN Frequency <= 5 THEN '2-5' WHEN Frequency <= 12 THEN '6-12' ELSE '13+' END"
    for name, band in (("recency_bands", band_r), ("frequency_bands", band_f)):
        q[name] = with_(BASE, rfm_ctes()) + f""", g AS (SELECT {band} AS band, count(*) AS customers FROM rfm GROUP BY 1)
SELECT band, customers, {P('CASE WHEN sum(customers) OVER () > 0 THEN customers / sum(customers) OVER () * 100 ELSE 0.0 END')} AS percent FROM g"""
    rb = with_(BASE, rfm_ctes())
    q["monetary_quantiles"] = rb + f"""SELECT {P('quantile_cont(Monetary, 0.5)')} AS median,
  {P('quantile_cont(Monetary, 0.9)')} AS top_10_pct_threshold, {P('quantile_cont(Monetary, 0.99)')} AS top_1_pct_threshold FROM rfm"""
    q["freq_vs_value_corr"] = rb + f"""SELECT {P('corr(CAST(Frequency AS DOUBLE), Monetary)')} AS corr_frequency_monetary,
  {P('corr(CAST(Frequency AS DOUBLE), Monetary / Frequency)')} AS corr_frequency_order_value FROM rfm"""
    q["customer_profile"] = rb + f"""SELECT CustomerID, count(DISTINCT CAST(InvoiceDate AS DATE)) AS PurchaseFrequency,
  {P('sum(TotalPrice) / count(DISTINCT InvoiceNo)')} AS AverageOrderValue,
  {floor_days('max(InvoiceDate)', '(SELECT snapshot_date FROM snap)')} AS PurchaseRecency,
  {floor_days('min(InvoiceDate)', '(SELECT snapshot_date FROM snap)')} AS DaysSinceFirstPurchase
FROM clean GROUP BY CustomerID"""
    q["segment_revenue_share"] = full() + f""", g AS (
  SELECT Segment, count(*) AS customers, sum(Monetary) AS revenue, avg(Frequency) AS avg_frequency,
    sum(Monetary) / sum(Frequency) AS avg_order_value, avg(Recency) AS avg_recency FROM cust GROUP BY Segment)
SELECT Segment, customers,
  {P('CASE WHEN sum(customers) OVER () > 0 THEN customers / sum(customers) OVER () * 100 ELSE 0.0 END')} AS pct_customers,
  {M('revenue')} AS revenue,
  {P('CASE WHEN sum(revenue) OVER () > 0 THEN revenue / sum(revenue) OVER () * 100 ELSE 0.0 END')} AS pct_revenue,
  {P('avg_frequency')} AS avg_frequency, {P('avg_order_value')} AS avg_order_value, {P('avg_recency')} AS avg_recency FROM g"""
    early = "early AS (SELECT * FROM clean WHERE InvoiceDate <= (SELECT max(InvoiceDate) FROM clean) - INTERVAL 90 DAY)"
    q["segment_transitions"] = with_(BASE, rfm_ctes(), early, rfm_ctes("early", "e_")) + f""", g AS (
  SELECT e.Segment AS from_segment, n.Segment AS to_segment, count(*) AS customers
  FROM e_rfm e JOIN rfm n ON e.CustomerID = n.CustomerID GROUP BY 1, 2)
SELECT from_segment, to_segment, customers,
  {P('customers / sum(customers) OVER (PARTITION BY from_segment) * 100')} AS share_pct FROM g"""
    fc = full()
    q["acquisition_season"] = fc + f""", fp AS (SELECT CustomerID, min(InvoiceDate) AS f FROM clean GROUP BY CustomerID)
SELECT CASE WHEN month(fp.f) IN (9, 10, 11) THEN 'Sep-Nov' ELSE 'Other' END AS acquisition_season,
  count(*) AS customers, {M('avg(c.predicted_clv)')} AS avg_clv
FROM cust c JOIN fp ON c.CustomerID = fp.CustomerID GROUP BY 1"""
    q["order_size_progression"] = b + f""", inv AS (
  SELECT CustomerID, InvoiceNo, min(InvoiceDate) AS d, sum(TotalPrice) AS v FROM clean GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY d, InvoiceNo) AS rn FROM inv),
a AS (SELECT avg(CASE WHEN rn = 1 THEN v END) AS a1, avg(CASE WHEN rn BETWEEN 3 AND 5 THEN v END) AS a35 FROM r WHERE rn <= 5)
SELECT {P('a1')} AS avg_first_order, {P('a35')} AS avg_orders_3_to_5, {P('a35 / a1')} AS growth_ratio FROM a"""
    q["return_rate_driver"] = fc + f""", rr AS (
  SELECT CustomerID, count(*) FILTER (WHERE Quantity < 0) / count(*) * 100 AS r FROM {WC} GROUP BY CustomerID)
SELECT CASE WHEN rr.r = 0 THEN '0%' WHEN rr.r < 5 THEN '0-5%' WHEN rr.r <= 15 THEN '5-15%' ELSE '15%+' END AS return_band,
  count(*) AS customers, {M('avg(c.predicted_clv)')} AS avg_clv
FROM cust c JOIN rr ON c.CustomerID = rr.CustomerID GROUP BY 1"""
    q["revenue_concentration"] = rb.rstrip("\n") + _concentration("rfm", "Monetary")
    q["clv_to_cac"] = fc + f"""SELECT Segment, {M('avg(predicted_clv)')} AS avg_clv, {P('avg(predicted_clv) / 30.0')} AS clv_to_cac
FROM cust GROUP BY Segment"""
    q["gateway_products"] = fc + f""", fp AS (SELECT CustomerID, min(InvoiceDate) AS f FROM clean GROUP BY CustomerID),
items AS (SELECT DISTINCT CustomerID, InvoiceDate, StockCode FROM clean),
firsts AS (SELECT i.CustomerID, i.StockCode FROM items i JOIN fp ON i.CustomerID = fp.CustomerID AND i.InvoiceDate = fp.f),
g AS (SELECT StockCode, count(*) AS customers, avg(c.predicted_clv) AS avg_clv
      FROM firsts JOIN cust c ON firsts.CustomerID = c.CustomerID GROUP BY StockCode)
SELECT StockCode, customers, {M('avg_clv')} AS avg_clv,
  row_number() OVER (ORDER BY {M('avg_clv')} DESC, StockCode) AS rank FROM g"""
    q["cohort_retention"] = b + f""", act AS (SELECT DISTINCT CustomerID, year(InvoiceDate) * 12 + month(InvoiceDate) AS m FROM clean),
fst AS (SELECT CustomerID, min(m) AS c FROM act GROUP BY CustomerID),
g AS (SELECT fst.c, act.m - fst.c AS months_since, count(*) AS active_customers
      FROM act JOIN fst ON act.CustomerID = fst.CustomerID GROUP BY 1, 2),
s AS (SELECT *, max(CASE WHEN months_since = 0 THEN active_customers END) OVER (PARTITION BY c) AS cohort_size FROM g)
SELECT make_date(CAST((c - 1) // 12 AS INTEGER), CAST((c - 1) % 12 + 1 AS INTEGER), 1) AS cohort,
  CAST(months_since AS INTEGER) AS months_since, active_customers, cohort_size,
  {P('active_customers / cohort_size * 100')} AS retention_pct FROM s"""
    q["cancellation_patterns"] = fc + f""", g AS (
  SELECT CustomerID, count(DISTINCT InvoiceNo) AS invoices,
    count(DISTINCT CASE WHEN starts_with(InvoiceNo, 'C') THEN InvoiceNo END) AS cancelled_invoices
  FROM {WC} GROUP BY CustomerID)
SELECT g.CustomerID, invoices, cancelled_invoices, {P('cancelled_invoices / invoices * 100')} AS cancellation_rate,
  c.Segment, {P('c.prob_alive')} AS prob_alive FROM g LEFT JOIN cust c ON g.CustomerID = c.CustomerID"""

    # model checks
    bg, _ = _fixed()
    cal = """
cal_last AS (SELECT max(InvoiceDate) AS last FROM clean),
cal_lines AS (SELECT * FROM clean
              WHERE CAST(InvoiceDate AS DATE) <= CAST((SELECT last FROM cal_last) - INTERVAL 90 DAY AS DATE)),
cal_days AS (SELECT CustomerID, CAST(InvoiceDate AS DATE) AS d, sum(TotalPrice) AS v FROM cal_lines GROUP BY 1, 2),
cal_end AS (SELECT CAST((SELECT last FROM cal_last) - INTERVAL 90 DAY AS DATE) AS e, CAST((SELECT last FROM cal_last) AS DATE) AS l),
cal_summ AS (
  SELECT CustomerID, CAST(count(*) - 1 AS DOUBLE) AS frequency, CAST(date_diff('day', min(d), max(d)) AS DOUBLE) AS recency,
    CAST(date_diff('day', min(d), (SELECT e FROM cal_end)) AS DOUBLE) AS T,
    CAST(date_diff('day', (SELECT e FROM cal_end), (SELECT l FROM cal_end)) AS DOUBLE) AS h
  FROM cal_days GROUP BY CustomerID),
act AS (SELECT CustomerID, count(DISTINCT CAST(InvoiceDate AS DATE)) AS actual FROM clean
        WHERE CAST(InvoiceDate AS DATE) > (SELECT e FROM cal_end) GROUP BY CustomerID)"""
    h = "s.h"
    compare = f""", j AS (
  SELECT s.CustomerID, {expected_sql(h, 's.frequency', 's.recency', 's.T', bg)} AS predicted,
    coalesce(a.actual, 0) AS actual FROM cal_summ s LEFT JOIN act a ON s.CustomerID = a.CustomerID)
SELECT count(*) AS customers, CAST(sum(actual) AS BIGINT) AS actual_total, {P('sum(predicted)')} AS predicted_total,
  {P('avg(abs(predicted - actual))')} AS mae, {P('avg((predicted - actual) * (predicted - actual))')} AS mse,
  {P('corr(predicted, CAST(actual AS DOUBLE))')} AS correlation FROM j"""
    q["calibration_holdout"] = with_(BASE, cal) + compare
    # purchase events have a time of day, so the day cut is seen to be whole days
    q["event_calibration_holdout"] = with_("""
clean AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS CustomerID, CAST(event_id AS VARCHAR) AS InvoiceNo, 1.0 AS Quantity,
  ts AS InvoiceDate, value AS UnitPrice, 1.0 * value AS TotalPrice
  FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND value > 0)""", cal) + compare
    q["interpurchase_distribution"] = b + f""", days AS (SELECT DISTINCT CustomerID, CAST(InvoiceDate AS DATE) AS day FROM clean),
lg AS (SELECT CustomerID, day, lag(day) OVER (PARTITION BY CustomerID ORDER BY day) AS prev FROM days),
gaps AS (SELECT date_diff('day', prev, day) AS gap FROM lg WHERE prev IS NOT NULL),
g AS (SELECT CAST(floor(gap / 30) * 30 AS INTEGER) AS gap_from, count(*) AS gaps, avg(gap) AS mean_gap FROM gaps GROUP BY 1)
SELECT gap_from, gap_from + 29 AS gap_to, gaps, {P('mean_gap')} AS mean_gap,
  {P('gaps / sum(gaps) OVER () * 100')} AS share_pct FROM g"""
    q["time_between"] = b + f"""SELECT CustomerID, InvoiceDate,
  CAST(coalesce({floor_days('lag(InvoiceDate) OVER (PARTITION BY CustomerID ORDER BY InvoiceDate)', 'InvoiceDate')}, 0) AS DOUBLE) AS TimeDiff
FROM clean"""

    # engineered features
    fe = with_(BASE, rfm_ctes(), _features_ctes())
    fsel = ", ".join(
        [f"{M('Monetary')} AS Monetary" if c == "Monetary" else (f"{P(c)} AS {c}" if c in FEATURE_RATIO else c)
         for c in ["CustomerID", "Recency", "Frequency", "Monetary", "R_Score", "F_Score", "M_Score", "RFM_Score",
                   "Segment", "MeanTimeBetweenPurchases", "StdTimeBetweenPurchases", "AvgOrderQuantity",
                   "TotalQuantity", "UniqueProducts", "FirstPurchase", "LastPurchase", "DaysSinceFirstPurchase",
                   "CustomerTenure", "PurchaseCountLast3Months", "CategoryDiversityIndex", "AvgOrderValueStdDev"]])
    q["ml_features"] = fe + f"SELECT {fsel} FROM feats"
    listed = ["Recency", "Frequency", "Monetary", "MeanTimeBetweenPurchases", "StdTimeBetweenPurchases",
              "AvgOrderQuantity", "TotalQuantity", "UniqueProducts"]
    dsel = ", ".join(f"{M(f'f.{c}')} AS {c}" if c == "Monetary" else (f"{P(f'f.{c}')} AS {c}" if c in FEATURE_RATIO
                                                                        else f"f.{c}") for c in listed)
    q["ml_dataset"] = with_(BASE, rfm_ctes(), SUMMARY, DRIVERS, clv_ctes(), CUST, _features_ctes()) + f"""
SELECT f.CustomerID, {dsel}, {M('c.predicted_clv')} AS predicted_clv FROM feats f JOIN cust c ON f.CustomerID = c.CustomerID"""
    data = with_(BASE, rfm_ctes(), SUMMARY, DRIVERS, clv_ctes(), CUST, _features_ctes()) + """, sides AS (
  SELECT f.CustomerID, c.predicted_clv AS y,
         ('0x' || substr(md5(f.CustomerID || '|42'), 1, 8))::BIGINT % 100 < 20 AS test
  FROM feats f JOIN cust c ON f.CustomerID = c.CustomerID)"""
    q["train_test_split"] = data + "\nSELECT CustomerID, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM sides"
    q["baseline_metrics"] = data + f""", m AS (
  SELECT avg(y) FILTER (WHERE NOT test) AS mean, count(*) FILTER (WHERE NOT test) AS train_rows FROM sides)
SELECT count(*) AS test_rows, {M('avg(abs(mean - y))')} AS baseline_mae,
  {M('sqrt(avg((mean - y) * (mean - y)))')} AS baseline_rmse, any_value(train_rows) AS train_rows
FROM sides, m WHERE test"""
    g, s = FIXED_BGNBD, FIXED_GAMMA_GAMMA
    alive = f"""CASE WHEN frequency > 0 THEN {g.a} / ({g.b} + frequency - 1) * exp(-({g.r} + frequency)
    * ln({g.alpha} + recency) + ({g.r} + frequency) * ln({g.alpha} + T)) ELSE 0 END"""
    bg_ll = f"""avg(lgamma({g.r} + frequency) - lgamma({g.r}) + {g.r} * ln({g.alpha}) + lgamma({g.a + g.b})
    + lgamma({g.b} + frequency) - lgamma({g.b}) - lgamma({g.a + g.b} + frequency)
    - ({g.r} + frequency) * ln({g.alpha} + T) + ln(1 + {alive}))"""
    gg_ll = f"""avg(lgamma({s.p} * frequency + {s.q}) - lgamma({s.p} * frequency) - lgamma({s.q}) + {s.q} * ln({s.v})
    + ({s.p} * frequency - 1) * ln(monetary_value) + {s.p} * frequency * ln(frequency)
    - ({s.p} * frequency + {s.q}) * ln(frequency * monetary_value + {s.v}))"""
    for name, ll, theta, where in (("bgnbd_objective", bg_ll, (g.r, g.alpha, g.a, g.b), "frequency > 0"),
                                   ("gg_objective", gg_ll, (s.p, s.q, s.v), "frequency > 0 AND monetary_value > 0")):
        q[name] = with_(BASE, SUMMARY) + f""", l AS (SELECT count(*) AS customers, {ll} AS ll FROM summ WHERE {where})
SELECT customers, {P('ll')} AS mean_log_likelihood, {P(f'{0.01 * sum(v * v for v in theta)} - ll')} AS objective FROM l"""
    r, al, a, b = (f"CAST({v} AS DOUBLE)" for v in (g.r, g.alpha, g.a, g.b))
    q["purchase_count_check"] = with_(BASE, SUMMARY).replace("WITH", "WITH RECURSIVE", 1) + f""", m AS (
  SELECT T, count(*) AS n, 0 AS i, pow({al} / ({al} + T), {r}) AS rate, CAST(0 AS DOUBLE) AS below, CAST(1 AS DOUBLE) AS active,
         CAST(0 AS DOUBLE) AS gone FROM summ GROUP BY T
  UNION ALL
  SELECT T, n, i + 1, rate * ({r} + i) / (i + 1) * (T / ({al} + T)), below + rate, active * ({b} + i) / ({a} + {b} + i),
         CASE WHEN i = 0 THEN {a} / ({a} + {b}) ELSE gone * ({b} + i - 1) / ({a} + {b} + i) END FROM m WHERE i < 11
), e AS (
  SELECT i AS purchases, sum(n * (active * rate + gone * (1 - below))) AS expected FROM m GROUP BY i
), every AS (
  SELECT * FROM e UNION ALL SELECT 12, (SELECT count(*) FROM summ) - (SELECT sum(expected) FROM e)
), o AS (
  SELECT CAST(least(frequency, 12) AS INTEGER) AS purchases, count(*) AS observed FROM summ GROUP BY 1
)
SELECT purchases, purchases = 12 AS is_tail, coalesce(observed, 0) AS observed, {P('expected')} AS expected FROM every LEFT JOIN o USING (purchases)"""
    ev = """
ev_clean AS (
  SELECT DISTINCT CAST(event_id AS VARCHAR) AS InvoiceNo, 1.0 AS Quantity, ts AS InvoiceDate, value AS UnitPrice,
    CAST(user_id AS VARCHAR) AS CustomerID, 1.0 * value AS TotalPrice
  FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL AND value > 0)"""
    evr = rfm_ctes("ev_clean", "ev_")
    q["event_rfm_metrics"] = with_(ev, evr) + f"SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary FROM ev_rfm_m"
    q["event_purchase_summary"] = with_(ev, SUMMARY.replace("FROM clean", "FROM ev_clean")) + f"""
SELECT CustomerID, frequency, recency, T, {P('monetary_value')} AS monetary_value FROM summ"""
    return q
