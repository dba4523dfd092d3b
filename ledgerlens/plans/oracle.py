"""Independent DuckDB SQL for every registered query.

Written from the semantics, not generated from the Spark plans: each query is
``WITH <shared CTEs> SELECT ...``. Doubles are rounded with the same
``floor(x * 10^d + 0.5) / 10^d`` the Spark side uses (money 2, ratios 6).
"""

from __future__ import annotations


def R(expr: str, d: int) -> str:
    return f"(floor(({expr}) * {10 ** d}.0 + 0.5) / {10 ** d}.0)"


def M(expr: str) -> str:
    return R(expr, 2)


def P(expr: str) -> str:
    return R(expr, 6)


# --- transaction mapping and cleaning ----------------------------------------
# The marks /*price*/, /*customer*/ and /*copies*/ are filled per query: plain,
# or perturbed for the queries whose feature is cleaning (CLEANING).

TX = """
tx_base AS (
  SELECT
    o.o_orderkey AS _okey,
    CASE WHEN l.l_returnflag = 'R' THEN 'C' || CAST(o.o_orderkey AS VARCHAR)
         ELSE CAST(o.o_orderkey AS VARCHAR) END AS InvoiceNo,
    CAST(l.l_partkey AS VARCHAR) AS StockCode,
    CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END AS Quantity,
    o.o_orderdate AS InvoiceDate,
    /*price*/ AS UnitPrice,
    /*customer*/ AS CustomerID
    {country_col}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  {country_join}
),
tx AS (
  SELECT * EXCLUDE (_okey) FROM tx_base/*copies*/
),
txn AS (SELECT *, Quantity * UnitPrice AS TotalPrice FROM tx),
clean AS (
  SELECT DISTINCT * FROM txn
  WHERE CustomerID IS NOT NULL AND Quantity > 0 AND UnitPrice > 0
)"""


CLEANING = {"tx_normalized", "tx_clean", "tx_clean_appendix", "cleaning_audit", "null_counts", "zero_price_lines",
            "duplicate_count", "dataset_profile", "distinct_customers"}
PLAIN_MARKS = {"/*price*/": "l.l_extendedprice / l.l_quantity", "/*customer*/": "CAST(o.o_custkey AS VARCHAR)",
               "/*copies*/": ""}
DIRTY_MARKS = {
    "/*price*/": "CASE WHEN l.l_partkey % 97 = 0 THEN 0.0 ELSE l.l_extendedprice / l.l_quantity END",
    "/*customer*/": "CASE WHEN o.o_orderkey % 10 = 3 THEN NULL ELSE CAST(o.o_custkey AS VARCHAR) END",
    "/*copies*/": """
  UNION ALL
  SELECT * EXCLUDE (_okey) FROM tx_base WHERE _okey % 50 = 7"""}


def filled(name: str, sql: str) -> str:
    for mark, text in (DIRTY_MARKS if name in CLEANING else PLAIN_MARKS).items():
        sql = sql.replace(mark, text)
    return sql


def tx_ctes(with_country: bool = False) -> str:
    if with_country:
        return TX.format(
            country_col=", n.n_name AS Country",
            country_join="LEFT JOIN customer c ON o.o_custkey = c.c_custkey "
                         "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
    return TX.format(country_col="", country_join="")


def floor_days(start: str, end: str) -> str:
    return f"CAST(floor(date_diff('microsecond', {start}, {end}) / 86400000000.0) AS BIGINT)"


# --- RFM ---------------------------------------------------------------------

def rfm_ctes(src: str = "clean", p: str = "", rules: str = "code") -> str:
    """RFM metrics, scores and segments over the lines of ``src``; CTE names
    get the prefix ``p`` so two chains can live in one query."""
    seg = SEGMENT_CASE_APPENDIX if rules == "appendix" else SEGMENT_CASE
    return f"""
{p}snap AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS snapshot_date, max(InvoiceDate) AS max_date FROM {src}),
{p}rfm_m AS (
  SELECT CustomerID,
    {floor_days('max(InvoiceDate)', f'(SELECT snapshot_date FROM {p}snap)')} AS Recency,
    count(DISTINCT InvoiceNo) AS Frequency,
    sum(TotalPrice) AS Monetary
  FROM {src} GROUP BY CustomerID HAVING sum(TotalPrice) > 0
),
{p}rfm_edges AS (
  SELECT quantile_cont(CAST(Recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM {p}rfm_m
),
{p}rfm_ranked AS (
  SELECT *,
    row_number() OVER (ORDER BY Frequency, CustomerID) AS rf,
    row_number() OVER (ORDER BY (floor(Monetary * 1000000.0 + 0.5) / 1000000.0), CustomerID) AS rm,
    count(*) OVER () AS n
  FROM {p}rfm_m
),
{p}rfm_s AS (
  SELECT CustomerID, Recency, Frequency, Monetary,
    CAST(5 - (CAST(round(e[1], 9) < Recency AS INTEGER) + CAST(round(e[2], 9) < Recency AS INTEGER)
            + CAST(round(e[3], 9) < Recency AS INTEGER) + CAST(round(e[4], 9) < Recency AS INTEGER)) AS INTEGER) AS R_Score,
    CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil((rf - 1) * 5 / (n - 1))) END AS INTEGER) AS F_Score,
    CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(1, ceil((rm - 1) * 5 / (n - 1))) END AS INTEGER) AS M_Score
  FROM {p}rfm_ranked, {p}rfm_edges
),
{p}rfm AS (
  SELECT *, CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score,
    {seg} AS Segment
  FROM {p}rfm_s
)"""


SEGMENT_CASE = """CASE
      WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'Champions'
      WHEN R_Score >= 3 AND F_Score >= 3 AND M_Score >= 3 THEN 'Loyal Customers'
      WHEN R_Score >= 4 AND F_Score >= 1 AND F_Score <= 2 THEN 'New Customers'
      WHEN R_Score >= 3 AND R_Score <= 4 AND F_Score >= 3 AND F_Score <= 4 THEN 'Potential Loyalists'
      WHEN R_Score >= 2 AND R_Score <= 3 AND F_Score >= 2 AND M_Score >= 2 THEN 'At Risk'
      WHEN R_Score <= 2 AND F_Score >= 4 AND M_Score >= 4 THEN 'Can''t Lose Them'
      WHEN R_Score <= 2 AND F_Score <= 2 THEN 'Hibernating/Lost'
      ELSE 'Needs Attention'
    END"""

SEGMENT_CASE_APPENDIX = """CASE
      WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'Champions'
      WHEN R_Score >= 2 AND F_Score >= 3 AND M_Score >= 3 THEN 'Loyal Customers'
      WHEN R_Score >= 3 AND F_Score <= 3 AND M_Score <= 3 THEN 'Potential Loyalists'
      WHEN R_Score >= 4 AND F_Score = 1 THEN 'New Customers'
      WHEN R_Score >= 2 AND R_Score <= 3 AND F_Score >= 2 AND M_Score >= 2 THEN 'At Risk'
      WHEN R_Score = 1 AND F_Score >= 4 AND M_Score >= 4 THEN 'Can''t Lose Them'
      WHEN R_Score = 1 AND F_Score <= 2 AND M_Score <= 2 THEN 'Lost Customers'
      ELSE 'Other'
    END"""

RFM = rfm_ctes()


# --- repeat-purchase summary, drivers ---------------------------------------

SUMMARY = """
obs AS (SELECT CAST(max(InvoiceDate) AS DATE) AS end_day FROM clean),
daily AS (SELECT CustomerID, CAST(InvoiceDate AS DATE) AS d, sum(TotalPrice) AS v FROM clean GROUP BY 1, 2),
summ AS (
  SELECT CustomerID,
    CAST(count(*) - 1 AS DOUBLE) AS frequency,
    CAST(date_diff('day', min(d), max(d)) AS DOUBLE) AS recency,
    CAST(date_diff('day', min(d), (SELECT end_day FROM obs)) AS DOUBLE) AS T,
    CASE WHEN count(*) > 1 THEN (sum(v) - arg_min(v, d)) / (count(*) - 1) ELSE 0.0 END AS monetary_value
  FROM daily GROUP BY CustomerID
)"""

DRIVERS = f"""
line_rank AS (
  SELECT CustomerID, InvoiceDate, row_number() OVER (PARTITION BY CustomerID ORDER BY InvoiceDate) AS rn FROM clean
),
pairs AS (
  SELECT CustomerID, min(InvoiceDate) AS first_purchase,
         max(CASE WHEN rn = 2 THEN InvoiceDate END) AS second_purchase
  FROM line_rank WHERE rn <= 2 GROUP BY CustomerID
),
cats AS (SELECT CustomerID, count(DISTINCT StockCode) AS category_count FROM clean GROUP BY CustomerID),
drv AS (
  SELECT p.CustomerID,
    coalesce(CAST({floor_days('p.first_purchase', 'p.second_purchase')} AS DOUBLE), -1.0) AS time_to_second_purchase,
    CAST(coalesce(c.category_count, 0) AS BIGINT) AS category_count
  FROM pairs p LEFT JOIN cats c ON p.CustomerID = c.CustomerID
)"""


# --- model scoring at the fixed parameters --------------------------------------

def _fixed():
    from ledgerlens.config import FIXED_BGNBD, FIXED_GAMMA_GAMMA
    return FIXED_BGNBD, FIXED_GAMMA_GAMMA


HYP_TERMS = 2000


def hyp_sql(A: float, B: float, C: str, z: str, terms: int = HYP_TERMS) -> str:
    """2F1(A, B; C; z) by its series, each term from log-gamma values (A, B
    fixed numbers > -1, so the sign of the rising factorials is known)."""
    assert A > -1 and B > -1
    sign = (-1 if A < 0 else 1) * (-1 if B < 0 else 1)
    # terms shrink at least geometrically in z here, so ln(1e-17)/ln(z) + 8
    # of them leave a tail below double precision
    n_terms = f"least({terms}, CAST(ceil(-39.2 / ln({z})) AS BIGINT) + 8)"
    return (f"(CASE WHEN {z} = 0 THEN 1.0 ELSE 1.0 + list_sum(list_transform(range(1, {n_terms}), lambda k: "
            f"{sign}.0 * exp(lgamma({A!r} + k) - lgamma({A!r}) + lgamma({B!r} + k) - lgamma({B!r}) "
            f"- lgamma({C} + k) + lgamma({C}) - lgamma(k + 1) + k * ln({z})))) END)")


def prob_alive_sql(x: str, t: str, T: str, bg) -> str:
    return (f"(CASE WHEN {x} = 0 THEN 1.0 ELSE 1.0 / (1.0 + exp(({bg.r!r} + {x}) * "
            f"ln(({bg.alpha!r} + {T}) / ({bg.alpha!r} + {t})) + ln({bg.a!r} / ({bg.b!r} + greatest({x}, 1.0) - 1.0)))) END)")


def expected_sql(h: str, x: str, t: str, T: str, bg) -> str:
    z = f"(({h}) / ({bg.alpha!r} + {T} + ({h})))"
    c = f"({bg.a + bg.b - 1.0!r} + {x})"
    hyp = hyp_sql(bg.a + bg.b - 1.0 - bg.r, bg.a - 1.0, c, z)
    return (f"(CASE WHEN ({h}) = 0 THEN 0.0 ELSE {c} / {bg.a - 1.0!r} * (1.0 - pow(1.0 - {z}, {bg.a - 1.0!r}) * {hyp})"
            f" * {prob_alive_sql(x, t, T, bg)} END)")


def value_sql(x: str, m: str, gg) -> str:
    return f"({gg.p!r} * ({gg.v!r} + {x} * {m}) / ({gg.p!r} * {x} + {gg.q - 1.0!r}))"


def clv_ctes(months: int = 12, discount: float = 0.0083, period: float = 30.0) -> str:
    bg, gg = _fixed()
    return f"""
clv_h AS (
  SELECT CustomerID, frequency, recency, T, monetary_value, unnest(range(1, {months + 1})) AS i FROM summ
),
clv_e AS (
  SELECT CustomerID, frequency, recency, T, monetary_value, i,
    {expected_sql(f'{period!r} * i', 'frequency', 'recency', 'T', bg)} AS ex
  FROM clv_h
),
clv_l AS (
  SELECT *, coalesce(lag(ex) OVER (PARTITION BY CustomerID ORDER BY i), 0.0) AS ex_prev FROM clv_e
),
clv AS (
  SELECT s.CustomerID,
    greatest(coalesce(c.raw, 0.0), 0.0) AS predicted_clv,
    {prob_alive_sql('s.frequency', 's.recency', 's.T', bg)} AS prob_alive,
    s.monetary_value AS avg_transaction_value
  FROM summ s LEFT JOIN (
    SELECT CustomerID, sum({value_sql('frequency', 'monetary_value', gg)} * (ex - ex_prev) / pow({1.0 + discount!r}, i)) AS raw
    FROM clv_l GROUP BY CustomerID) c ON s.CustomerID = c.CustomerID
)"""


CUST = """
cust AS (
  SELECT r.CustomerID, r.Recency, r.Frequency, r.Monetary, r.R_Score, r.F_Score, r.M_Score, r.RFM_Score, r.Segment,
    coalesce(c.predicted_clv, 0.0) AS predicted_clv, coalesce(c.prob_alive, 0.0) AS prob_alive,
    coalesce(c.avg_transaction_value, 0.0) AS avg_transaction_value,
    coalesce(d.time_to_second_purchase, -1.0) AS time_to_second_purchase,
    CAST(coalesce(d.category_count, 0) AS BIGINT) AS category_count,
    (SELECT snapshot_date FROM snap) AS snapshot_date
  FROM rfm r LEFT JOIN clv c ON r.CustomerID = c.CustomerID LEFT JOIN drv d ON r.CustomerID = d.CustomerID
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE = tx_ctes()


def full() -> str:
    """Every CTE up to the customer table."""
    return with_(BASE, RFM, SUMMARY, DRIVERS, clv_ctes(), CUST)


CUST_SELECT = f"""CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary, R_Score, F_Score, M_Score, RFM_Score,
  Segment, {M('predicted_clv')} AS predicted_clv, {P('prob_alive')} AS prob_alive,
  {P('avg_transaction_value')} AS avg_transaction_value, time_to_second_purchase, category_count, snapshot_date"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["tx_clean"] = with_(tx_ctes(True)) + f"""
SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, {M('UnitPrice')} AS UnitPrice, CustomerID, Country,
       {M('TotalPrice')} AS TotalPrice
FROM clean"""
    q["rfm_metrics"] = with_(BASE, RFM) + f"""
SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary FROM rfm_m"""
    q["rfm_scores"] = with_(BASE, RFM) + f"""
SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary, R_Score, F_Score, M_Score,
       CAST(R_Score AS VARCHAR) || CAST(F_Score AS VARCHAR) || CAST(M_Score AS VARCHAR) AS RFM_Score
FROM rfm_s"""
    q["rfm_segments"] = with_(BASE, RFM) + f"""
SELECT CustomerID, Recency, Frequency, {M('Monetary')} AS Monetary, R_Score, F_Score, M_Score, RFM_Score, Segment
FROM rfm"""
    q["segment_distribution"] = with_(BASE, RFM) + f"""
SELECT Segment, count(*) AS Count, {P('count(*) / sum(count(*)) OVER () * 100')} AS Percent
FROM rfm GROUP BY Segment"""
    q.update(_more())
    from ledgerlens.plans.oracle_more import more_sql
    from ledgerlens.plans.oracle_views import view_sql
    q.update(view_sql())
    q.update(more_sql())
    return {name: filled(name, sql) for name, sql in q.items()}


def _more() -> dict[str, str]:
    q: dict[str, str] = {}
    b = with_(BASE, RFM)
    q["snapshot_date"] = b + "SELECT snapshot_date, max_date FROM snap"
    q["purchase_summary"] = with_(BASE, SUMMARY) + f"""
SELECT CustomerID, frequency, recency, T, {P('monetary_value')} AS monetary_value FROM summ"""
    q["second_purchase"] = with_(BASE, DRIVERS) + "SELECT CustomerID, first_purchase, second_purchase FROM pairs"
    q["driver_metrics"] = with_(BASE, DRIVERS) + "SELECT CustomerID, time_to_second_purchase, category_count FROM drv"
    q["bgnbd_input"] = with_(BASE, SUMMARY) + f"""
SELECT CustomerID, frequency, recency, T, {P('monetary_value')} AS monetary_value FROM summ WHERE frequency > 0"""
    q["gg_input"] = with_(BASE, SUMMARY) + f"""
SELECT CustomerID, frequency, recency, T, {P('monetary_value')} AS monetary_value FROM summ
WHERE frequency > 0 AND monetary_value > 0"""
    q["freq_monetary_corr"] = with_(BASE, SUMMARY) + f"""
SELECT count(*) AS n, {P('corr(frequency, monetary_value)')} AS correlation,
       abs(corr(frequency, monetary_value)) > 0.1 AS exceeds_threshold
FROM summ WHERE frequency > 0 AND monetary_value > 0"""
    bg, gg = _fixed()
    q["bgnbd_prob_alive"] = with_(BASE, SUMMARY) + f"""
SELECT CustomerID, {P(prob_alive_sql('frequency', 'recency', 'T', bg))} AS prob_alive FROM summ"""
    q["bgnbd_expected_purchases"] = with_(BASE, SUMMARY) + "SELECT CustomerID, " + ", ".join(
        f"{P(expected_sql(str(h), 'frequency', 'recency', 'T', bg))} AS expected_purchases_{h}" for h in (30, 90, 180, 360)
    ) + " FROM summ"
    q["gg_expected_value"] = with_(BASE, SUMMARY) + f"""
SELECT CustomerID, {M(value_sql('frequency', 'monetary_value', gg))} AS expected_average_value FROM summ"""
    q["predict_clv"] = with_(BASE, SUMMARY, clv_ctes()) + f"""
SELECT CustomerID, {M('predicted_clv')} AS predicted_clv, {P('prob_alive')} AS prob_alive,
       {P('avg_transaction_value')} AS avg_transaction_value FROM clv"""
    q["customer_table"] = full() + f"SELECT {CUST_SELECT} FROM cust"
    return q
