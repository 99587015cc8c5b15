"""Parquet tables of a data folder (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns each view reads, with their types. Reading with a stated schema
# skips footer-based schema inference at planning time and reads only these
# columns.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_returnflag string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
}


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    path = f"{data_dir.rstrip('/')}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)

