"""The inputs every registered query starts from, derived from the data folder."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators.alerts import ALERT_KPIS, kpi_alerts, kpi_insights
from tillroll.operators.clean import clean
from tillroll.operators.kpis import (
    DIM_COUNTRY,
    DIM_PRODUCT,
    breakdowns_from,
    figures,
    kpi_scalars,
    kpis_from,
    monthly_from,
    monthly_revenue,
    top_countries,
    top_from,
    top_products,
)
from tillroll.session import scratch_dir
from tillroll.sources.log_view import grants_frame, log_from_events
from tillroll.sources.retail_view import retail_lines


def raw(spark: SparkSession, d: str) -> DataFrame:
    return retail_lines(spark, d)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean(raw(spark, d))


def kpis_clean(spark: SparkSession, d: str, *which: str) -> DataFrame:
    return kpi_scalars(cleaned(spark, d), which)


def kpis_raw(spark: SparkSession, d: str, *which: str) -> DataFrame:
    return kpi_scalars(raw(spark, d), which)


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return monthly_revenue(cleaned(spark, d))


def countries(spark: SparkSession, d: str) -> DataFrame:
    return top_countries(cleaned(spark, d))


def products(spark: SparkSession, d: str) -> DataFrame:
    return top_products(cleaned(spark, d))


def alerts_raw(spark: SparkSession, d: str) -> DataFrame:
    return kpi_alerts(kpis_raw(spark, d, *ALERT_KPIS))


def log(spark: SparkSession, d: str) -> DataFrame:
    return log_from_events(spark, d)


def grants(spark: SparkSession) -> DataFrame:
    return grants_frame(spark)


class SmallTables:
    """The small tables derived from invoice lines (by default the clean ones), each computed once.

    The KPI row, the revenue breakdowns (months, countries, products), the
    alerts and the insight lines are far smaller than the lines. A query that
    uses several of them would otherwise derive the invoice lines for each.
    Here the lines are evaluated once, by one grouping-sets aggregate
    (``figures``: by month, country, product and order), which is written once
    under the session's checkpoint folder, a folder a set, and read back; all
    the tables come from it.
    """

    def __init__(self, spark: SparkSession, d: str, lines: DataFrame | None = None, orders: bool = True):
        self.spark, self.orders = spark, orders
        self.lines = cleaned(spark, d) if lines is None else lines
        self.base = scratch_dir(spark, f"small-{uuid.uuid4().hex}")

    def _keep(self, name: str, df: DataFrame, by: list[str] = []) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    @cached_property
    def figures(self) -> DataFrame:
        return self._keep("figures", figures(self.lines, self.orders), ["dim"])

    @cached_property
    def kpis(self) -> DataFrame:
        return self._keep("kpis", kpis_from(self.figures))

    @cached_property
    def breakdowns(self) -> DataFrame:
        return breakdowns_from(self.figures)

    @cached_property
    def monthly(self) -> DataFrame:
        return monthly_from(self.breakdowns)

    @cached_property
    def countries(self) -> DataFrame:
        return top_from(self.breakdowns, DIM_COUNTRY, "country")

    @cached_property
    def products(self) -> DataFrame:
        return top_from(self.breakdowns, DIM_PRODUCT, "description")

    @cached_property
    def alerts(self) -> DataFrame:
        return kpi_alerts(self.kpis)

    @cached_property
    def insights(self) -> DataFrame:
        return kpi_insights(self.kpis, self.countries, self.alerts)
