"""Load report, preview and the union of period files for invoice lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def load_report(df: DataFrame) -> DataFrame:
    """S3: one row — status, row count, column count, column names and types.

    Names and types come from the schema (plan metadata); only the count
    runs over the data.
    """
    names = ",".join(df.columns)
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("success").alias("status"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(names).alias("columns"),
        F.lit(types).alias("dtypes"),
    )


def missing_source_report(spark, path: str) -> DataFrame:
    """S3 error record: the row the load report gives when the source is absent."""
    return spark.createDataFrame(
        [("error", f"Fichier introuvable : {path}")], "status string, message string"
    )


def load_report_for(spark, read, path: str) -> DataFrame:
    """S3 for a path: the load report, or the error record if nothing is there.

    ``read(path)`` builds the source DataFrame; Spark reports a missing path
    when the read is planned, which is turned into the error record.
    """
    from pyspark.errors import AnalysisException

    try:
        df = read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return missing_source_report(spark, path)
        raise
    return load_report(df)


def load_preview(df: DataFrame, n: int = 3) -> DataFrame:
    """S3: the first ``n`` rows in a stated order (all columns ascending, nulls first).

    ``orderBy(..).limit(n)`` is a bounded top-n (TakeOrderedAndProject); the
    row number is taken over those n rows only.
    """
    order = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
    head = df.orderBy(*order).limit(n)
    return head.select(F.row_number().over(Window.orderBy(*order)).alias("row_no"), *[f"`{c}`" for c in df.columns])


def union_periods(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """One table from several period files, each row labelled with its period.

    Columns are matched by name; a column missing from one part is null there.
    """
    labelled = [df.select(F.lit(label).alias("period"), "*") for label, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
