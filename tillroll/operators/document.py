"""The KPI document: one long table, and its JSON form.

The long table (section, pos, name, value, text) keeps the order of every
breakdown in ``pos``, which Spark maps would lose. All pieces are small:
months, top-k lists, alerts and insight lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.frames import combine_rows

# Names of the scalar KPIs in the document, with their source column.
DOC_SCALARS = [
    ("CA_total", "ca_total"),
    ("revenue_moyen", "revenue_mean"),
    ("nb_clients_uniques", "n_customers"),
    ("nb_commandes", "n_orders"),
    ("panier_moyen", "avg_basket"),
    ("taux_annulation", "cancellation_rate"),
    ("data_quality_score", "completeness"),
]
# Section names of the document.
SECTION_KPIS, SECTION_MONTHS, SECTION_COUNTRIES, SECTION_PRODUCTS = "kpis", "CA_par_mois", "CA_par_pays_top10", "top_10_produits"
SECTION_ALERTS, SECTION_INSIGHTS = "alertes", "insights"
SECTION_RUN = "run"


def kpi_document(kpis: DataFrame, monthly: DataFrame, countries: DataFrame, products: DataFrame,
                 alerts: DataFrame, insights: DataFrame) -> DataFrame:
    """(section, pos, name, value, text) for every entry of the KPI document."""
    null_text = F.lit(None).cast("string")
    scalars = kpis.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(SECTION_KPIS).alias("section"), F.lit(i + 1).alias("pos"), F.lit(name).alias("name"),
                             F.col(src).cast("double").alias("value"), null_text.alias("text"))
                    for i, (name, src) in enumerate(DOC_SCALARS)
                ]
            )
        )
    ).filter(F.col("value").isNotNull())
    months = monthly.select(
        F.lit(SECTION_MONTHS).alias("section"), F.row_number().over(Window.orderBy("year_month")).alias("pos"),
        F.col("year_month").alias("name"), F.col("revenue").alias("value"), null_text.alias("text"),
    )
    ctry = countries.select(F.lit(SECTION_COUNTRIES).alias("section"), F.col("rank").alias("pos"),
                            F.col("country").alias("name"), F.col("revenue").alias("value"), null_text.alias("text"))
    prod = products.select(F.lit(SECTION_PRODUCTS).alias("section"), F.col("rank").alias("pos"),
                           F.col("description").alias("name"), F.col("revenue").alias("value"), null_text.alias("text"))
    alert = alerts.select(F.lit(SECTION_ALERTS).alias("section"), F.col("alert_order").alias("pos"),
                          F.col("kpi").alias("name"), F.col("value"), F.col("message").alias("text"))
    lines = insights.select(F.lit(SECTION_INSIGHTS).alias("section"), F.col("line_no").alias("pos"),
                            null_text.alias("name"), F.lit(None).cast("double").alias("value"), F.col("text"))
    return scalars.unionByName(months).unionByName(ctry).unionByName(prod).unionByName(alert).unionByName(lines)


def _ordered_map(df: DataFrame, pos: str, name: str, alias: str) -> DataFrame:
    """A name → revenue map whose entries follow ``pos`` (Spark keeps insertion order in JSON)."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(name).alias("key"), F.col("revenue").alias("value"))))
    return df.agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"]))).alias(alias))


def document_json(kpis: DataFrame, monthly: DataFrame, countries: DataFrame, products: DataFrame,
                  alerts: DataFrame, insights: DataFrame, output_path: str | None = None,
                  more: dict[str, str] | None = None) -> DataFrame:
    """The document as one JSON string: ``{kpis, alertes, insights, output_path}``.

    ``more`` are text fields to put before them instead of ``output_path``.

    Breakdowns are JSON objects whose keys keep their order (months in
    calendar order, top-k by rank). Every input is small (months, k, alerts,
    lines); the pieces are folded into one row without a join.
    """
    scalars = kpis.select(*[F.col(src).alias(name) for name, src in DOC_SCALARS])
    alert_list = alerts.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("alert_order", "kpi", "value", "level", "threshold", "message"))),
            lambda a: F.struct(a["kpi"].alias("kpi"), a["value"].alias("valeur"), a["level"].alias("niveau"),
                               a["threshold"].alias("seuil"), a["message"].alias("message")),
        ).alias("alertes")
    )
    lines = insights.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("insights")
    )
    maps = [
        _ordered_map(monthly, "year_month", "year_month", SECTION_MONTHS),
        _ordered_map(countries, "rank", "country", SECTION_COUNTRIES),
        _ordered_map(products, "rank", "description", SECTION_PRODUCTS),
    ]
    # Maps are not orderable, so they cross the one-row fold as JSON text.
    parts = combine_rows(
        scalars,
        *[m.select(F.to_json(m.columns[0]).alias(m.columns[0])) for m in maps],
        alert_list,
        lines,
    )
    as_map = "map<string,double>"
    kpi_fields = [F.col(name) for name, _ in DOC_SCALARS[:2]] + [F.from_json(SECTION_MONTHS, as_map).alias(SECTION_MONTHS),
                  F.from_json(SECTION_COUNTRIES, as_map).alias(SECTION_COUNTRIES)]
    kpi_fields += [F.col(name) for name, _ in DOC_SCALARS[2:6]] + [F.from_json(SECTION_PRODUCTS, as_map).alias(SECTION_PRODUCTS)]
    kpi_fields += [F.col(name) for name, _ in DOC_SCALARS[6:]]
    content = [F.struct(*kpi_fields).alias("kpis"), F.col("alertes"), F.col("insights")]
    if more is None:
        body = F.struct(*content, F.lit(output_path).cast("string").alias("output_path"))
    else:
        body = F.struct(*[F.lit(v).alias(k) for k, v in more.items()], *content)
    return parts.select(F.to_json(body).alias("document"))


def dashboard_payload(kpis: DataFrame, monthly: DataFrame, countries: DataFrame, products: DataFrame,
                      alerts: DataFrame, insights: DataFrame, run_id: str, dashboard_path: str) -> DataFrame:
    """What the dashboard is published with: ``{run_id, dashboard_path, kpis, alertes, insights}``."""
    return document_json(kpis, monthly, countries, products, alerts, insights,
                         more={"run_id": run_id, "dashboard_path": dashboard_path})


def payload_rows(payload: DataFrame) -> DataFrame:
    """The fields of a payload read back from its JSON, as (section, pos, name, value, text)."""
    scalar = ", ".join(f"{name}: double" for name, _ in DOC_SCALARS)
    maps = ", ".join(f"{name}: map<string, double>" for name in (SECTION_MONTHS, SECTION_COUNTRIES, SECTION_PRODUCTS))
    alert = "struct<kpi: string, valeur: double, niveau: string, seuil: double, message: string>"
    schema = (f"struct<run_id: string, dashboard_path: string, kpis: struct<{scalar}, {maps}>, "
              f"alertes: array<{alert}>, insights: array<string>>")
    read = payload.select(F.from_json("document", schema).alias("d"))
    no_text, no_value, no_name = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")

    def entry(section: str, pos, name, value, text):
        return F.struct(F.lit(section).alias("section"), pos.cast("int").alias("pos"), name.alias("name"),
                        value.alias("value"), text.alias("text"))

    rows = [F.array(entry(SECTION_RUN, F.lit(1), F.lit("run_id"), no_value, F.col("d.run_id")),
                    entry(SECTION_RUN, F.lit(2), F.lit("dashboard_path"), no_value, F.col("d.dashboard_path")))]
    rows.append(F.filter(F.array(*[entry(SECTION_KPIS, F.lit(i + 1), F.lit(name), F.col(f"d.kpis.{name}"), no_text)
                                   for i, (name, _) in enumerate(DOC_SCALARS)]), lambda e: e["value"].isNotNull()))

    def of_map(section: str):
        return F.transform(F.map_entries(f"d.kpis.{section}"), lambda e, i: entry(section, i + 1, e["key"], e["value"], no_text))

    rows += [of_map(s) for s in (SECTION_MONTHS, SECTION_COUNTRIES, SECTION_PRODUCTS)]
    rows.append(F.transform("d.alertes", lambda a, i: entry(SECTION_ALERTS, i + 1, a["kpi"], a["valeur"], a["message"])))
    rows.append(F.transform("d.insights", lambda t, i: entry(SECTION_INSIGHTS, i + 1, no_name, no_value, t)))
    return read.select(F.inline(F.concat(*rows)))
