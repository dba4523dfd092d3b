"""Property test: random small invoice-line sets through cleaning, the
repeat-purchase summary, RFM metrics and driver metrics, against a direct
pandas computation of the same definitions."""

import datetime as dt

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.operators import clean as C
from ledgerlens.operators import drivers as DR
from ledgerlens.operators import rfm as RF
from ledgerlens.operators import summary as SU
from ledgerlens.schema import RAW_TX

DAY0 = dt.datetime(2011, 1, 1)

line = st.tuples(
    st.integers(1, 6),                 # invoice
    st.integers(1, 5),                 # product
    st.integers(-2, 6),                # quantity (returns and zeros included)
    st.integers(0, 40),                # day
    st.sampled_from([0, 9, 23]),       # hour
    st.sampled_from([0.0, 1.25, 3.5]), # unit price (free items included)
    st.sampled_from(["1", "2", "3", None]),
)


def _frame(lines):
    return [(f"{c}-{inv}", str(p), None, float(q), DAY0 + dt.timedelta(days=d, hours=h), price, c, "UK")
            for inv, p, q, d, h, price, c in lines]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(line, min_size=1, max_size=40))
def test_pipeline_matches_pandas(spark, lines):
    rows = _frame(lines)
    clean = C.tx_clean(spark.createDataFrame(rows, RAW_TX))
    pdf = pd.DataFrame(rows, columns=[f.name for f in RAW_TX.fields])
    pdf = pdf[pdf.CustomerID.notna() & (pdf.Quantity > 0) & (pdf.UnitPrice > 0)].drop_duplicates()
    pdf["TotalPrice"] = pdf.Quantity * pdf.UnitPrice
    assert clean.count() == len(pdf)
    if pdf.empty:
        return

    summ = {r.CustomerID: r for r in SU.purchase_summary(clean).collect()}
    end = pdf.InvoiceDate.max().normalize()
    days = pdf.assign(d=pdf.InvoiceDate.dt.normalize()).groupby(["CustomerID", "d"]).TotalPrice.sum()
    for cust, g in days.groupby(level=0):
        g = g.droplevel(0).sort_index()
        s = summ[cust]
        assert s.frequency == len(g) - 1
        assert s.recency == (g.index.max() - g.index.min()).days
        assert s.T == (end - g.index.min()).days
        expect = g.iloc[1:].mean() if len(g) > 1 else 0.0
        assert abs(s.monetary_value - expect) < 1e-9

    snap = pdf.InvoiceDate.max() + pd.Timedelta(days=1)
    rfm = {r.CustomerID: r for r in RF.rfm_metrics(clean).collect()}
    drv = {r.CustomerID: r for r in DR.driver_metrics(clean).collect()}
    for cust, g in pdf.groupby("CustomerID"):
        assert rfm[cust].Recency == (snap - g.InvoiceDate.max()).days
        assert rfm[cust].Frequency == g.InvoiceNo.nunique()
        dates = sorted(g.InvoiceDate)
        assert drv[cust].time_to_second_purchase == ((dates[1] - dates[0]).days if len(dates) > 1 else -1)
        assert drv[cust].category_count == g.StockCode.nunique()
