"""Shared by the test modules; conftest.py holds fixtures only, as a second
conftest.py in a subfolder takes its module name."""

import datetime as dt
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def tx_frame(spark, rows):
    """Raw invoice lines from tuples (InvoiceNo, StockCode, Description,
    Quantity, InvoiceDate 'YYYY-MM-DD HH:MM', UnitPrice, CustomerID, Country)."""
    from ledgerlens.schema import RAW_TX
    conv = [(r[0], r[1], r[2], float(r[3]), dt.datetime.strptime(r[4], "%Y-%m-%d %H:%M"), float(r[5]), r[6], r[7])
            for r in rows]
    return spark.createDataFrame(conv, RAW_TX)
