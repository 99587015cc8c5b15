"""Canonical layouts of invoice lines and the header aliases they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.numeric import SALES_TYPE

RAW_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType(), True),
        T.StructField("stock_code", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("quantity", T.LongType(), True),
        T.StructField("invoice_date", T.TimestampNTZType(), True),
        T.StructField("price", T.DoubleType(), True),
        T.StructField("customer_id", T.DoubleType(), True),
        T.StructField("country", T.StringType(), True),
    ]
)

CLEAN_SCHEMA = T.StructType(
    [f if f.name != "customer_id" else T.StructField("customer_id", T.StringType(), True) for f in RAW_SCHEMA.fields]
    + [
        T.StructField("sales", SALES_TYPE, True),
        T.StructField("year", T.IntegerType(), True),
        T.StructField("month", T.IntegerType(), True),
        T.StructField("year_month", T.StringType(), True),
    ]
)

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]
CLEAN_COLUMNS = [f.name for f in CLEAN_SCHEMA.fields]

# Source header names per canonical column, first present wins
# (the two common header layouts of invoice-line files).
ALIASES = {
    "invoice": ["Invoice", "InvoiceNo"],
    "stock_code": ["StockCode"],
    "description": ["Description"],
    "quantity": ["Quantity"],
    "invoice_date": ["InvoiceDate"],
    "price": ["Price", "UnitPrice"],
    "customer_id": ["Customer ID", "CustomerID"],
    "country": ["Country"],
    "sales": ["Sales"],
    "year": ["Year"],
    "month": ["Month"],
    "year_month": ["YearMonth"],
}


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Map canonical name → source column for the columns that are present."""
    present = set(columns)
    found = {}
    for canonical, names in ALIASES.items():
        if canonical in present:
            found[canonical] = canonical
            continue
        for name in names:
            if name in present:
                found[canonical] = name
                break
    return found


def rename_to_canonical(df: DataFrame) -> DataFrame:
    """Rename aliased source columns to canonical names; others are kept."""
    mapping = resolve_columns(df.columns)
    reverse = {src: canon for canon, src in mapping.items()}
    return df.select(*[F.col(f"`{c}`").alias(reverse.get(c, c)) for c in df.columns])


def to_source_headers(df: DataFrame) -> DataFrame:
    """Rename canonical columns to the first source header of each (``invoice`` → ``Invoice``)."""
    return df.select(*[F.col(f"`{c}`").alias(ALIASES[c][0] if c in ALIASES else c) for c in df.columns])
