"""Invoice lines derived from the star-schema tables.

``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part`` (inner joins) projected to
the raw invoice layout. The tables hold no bad rows, so the view plants them
by key: cancellations, zero quantities and prices, missing descriptions and
customers.

Plan at scale: only the needed columns are read (column pruning reaches the
Parquet scans). Orders get their country first (``orders ⋈ customer`` on
the customer key, then ``⋈ nation``), so the customer-key shuffle moves
order-sized data, not line-sized data. The nation list is far under the
broadcast threshold (Spark's size check), so that join has no shuffle. The
lines then meet the enriched orders on the order key and ``part`` on the
part key: two line-sized shuffles in all. Each dimension side is unique on its
key, so a hot key on the line side is split by adaptive skew-join handling.
No side is forced: Spark broadcasts one only when its file size, or its
measured size at run time, is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import read_table

# The keys that plant problems into the view.
CANCEL_FLAG = "R"
CANCEL_ORDER_MOD, CANCEL_ORDER_REM = 10, 3
NULL_DESCRIPTION_MOD = 97
ZERO_QUANTITY_MOD = 211
ZERO_PRICE_MOD = 173
NULL_CUSTOMER_MOD = 5


def _cancelled(returnflag: Column, orderkey: Column) -> Column:
    return (returnflag == F.lit(CANCEL_FLAG)) & (orderkey % CANCEL_ORDER_MOD == CANCEL_ORDER_REM)


def retail_lines(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw invoice lines (8 canonical columns) from the tables in ``data_dir``."""
    li = read_table(spark, data_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    od = read_table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, data_dir, "customer").select("c_custkey", "c_nationkey")
    na = read_table(spark, data_dir, "nation").select("n_nationkey", "n_name")
    pa = read_table(spark, data_dir, "part").select("p_partkey", "p_name", "p_retailprice")

    orders_country = (
        od.join(cu, F.col("o_custkey") == F.col("c_custkey"))
        .join(na, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "n_name")
    )
    joined = li.join(orders_country, F.col("l_orderkey") == F.col("o_orderkey")).join(
        pa, F.col("l_partkey") == F.col("p_partkey")
    )

    cancelled = _cancelled(F.col("l_returnflag"), F.col("o_orderkey"))
    order_text = F.col("o_orderkey").cast("string")
    qty = F.col("l_quantity").cast("bigint")
    return joined.select(
        F.when(cancelled, F.concat(F.lit("C"), order_text)).otherwise(order_text).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.when(F.col("l_partkey") % NULL_DESCRIPTION_MOD == 0, F.lit(None).cast("string"))
        .otherwise(F.col("p_name"))
        .alias("description"),
        F.when(cancelled, -qty)
        .when((F.col("l_orderkey") + F.col("l_linenumber")) % ZERO_QUANTITY_MOD == 0, F.lit(0).cast("bigint"))
        .otherwise(qty)
        .alias("quantity"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("invoice_date"),
        F.when((F.col("l_orderkey") + F.col("l_partkey")) % ZERO_PRICE_MOD == 0, F.lit(0.0))
        .otherwise(F.col("p_retailprice"))
        .alias("price"),
        F.when(F.col("o_custkey") % NULL_CUSTOMER_MOD == 0, F.lit(None).cast("double"))
        .otherwise(F.col("o_custkey").cast("double"))
        .alias("customer_id"),
        F.col("n_name").alias("country"),
    )
