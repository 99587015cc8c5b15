"""Tiny hand-written invoice frames for rule tests."""

import datetime as dt

from tillroll.schema import RAW_SCHEMA

D = dt.datetime


def raw_frame(spark, rows):
    """rows: tuples in raw column order (invoice, stock_code, description, quantity,
    invoice_date, price, customer_id, country)."""
    return spark.createDataFrame(rows, RAW_SCHEMA)
