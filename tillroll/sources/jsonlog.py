"""Run logs on disk: tool calls, decisions, run metadata, KPI documents.

Layout: ``<base>/<run_id>/tool_calls.jsonl``, ``<base>/<run_id>/decisions.jsonl``
and ``<base>/<run_id>/metadata.json``; logs that one job writes for many runs
lie in ``<base>/_many/`` and name their run. A tool-call file mixes two record
shapes, ``{timestamp, run_id, tool, data}`` and ``{timestamp, agent_name,
tool_name, input, output, success, error}``; both are read with one fixed
schema (no inference) and coalesced. Nested objects are kept as JSON text.
The run id of a record without one comes from its folder name. A kind of file
that no run has yet is an empty table. A call with any error text, or whose
data report an error, has failed, whatever else the record says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOOL_CALL_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("agent_name", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)
DECISION_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("completed", T.ArrayType(T.StringType())),
        T.StructField("pending", T.ArrayType(T.StringType())),
        T.StructField("artifacts", T.MapType(T.StringType(), T.StringType())),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("current_step", T.StringType()),
        T.StructField("finished_at", T.StringType()),
    ]
)
KPI_DOC_SCHEMA = T.StructType(
    [
        T.StructField(
            "kpis",
            T.StructType(
                [
                    T.StructField("CA_total", T.DoubleType()),
                    T.StructField("revenue_moyen", T.DoubleType()),
                    T.StructField("CA_par_mois", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("CA_par_pays_top10", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("nb_clients_uniques", T.LongType()),
                    T.StructField("nb_commandes", T.LongType()),
                    T.StructField("panier_moyen", T.DoubleType()),
                    T.StructField("taux_annulation", T.DoubleType()),
                    T.StructField("top_10_produits", T.MapType(T.StringType(), T.DoubleType())),
                    T.StructField("data_quality_score", T.DoubleType()),
                ]
            ),
        ),
        T.StructField(
            "alertes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("kpi", T.StringType()),
                        T.StructField("valeur", T.DoubleType()),
                        T.StructField("niveau", T.StringType()),
                        T.StructField("seuil", T.DoubleType()),
                        T.StructField("message", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("insights", T.ArrayType(T.StringType())),
        T.StructField("output_path", T.StringType()),
    ]
)

_RUN_FROM_PATH = r"/([^/]+)/[^/]+\.jsonl?(/[^/]*)?$"
# The folder of logs that one job writes for many runs.
MANY_RUNS = "_many"


def _run_of_path(path: str = "_metadata.file_path") -> F.Column:
    return F.nullif(F.regexp_extract(F.col(path), _RUN_FROM_PATH, 1), F.lit(MANY_RUNS))


def _read(spark: SparkSession, pattern: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON files with the column ``_file``, or no rows if nothing matches the pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType())]))
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(pattern)
    return raw.select("*", F.col("_metadata.file_path").alias("_file"))


def read_records(spark: SparkSession, base: str, kind: str, schema: T.StructType) -> DataFrame:
    """The records of a kind of all runs, with their run (their own, else their folder's) as ``run``."""
    own = [] if "run_id" in schema.names else [T.StructField("run_id", T.StringType())]
    raw = _read(spark, f"{base.rstrip('/')}/*/{kind}", T.StructType([*schema.fields, *own]))
    return raw.select(*schema.names, F.coalesce("run_id", _run_of_path("_file")).alias("run"))


def _ts(text: F.Column) -> F.Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def unify_tool_calls(raw: DataFrame) -> DataFrame:
    """One table from both record shapes (``raw`` has the schema above plus ``file_run``)."""
    status = F.get_json_object(F.col("data"), "$.status")
    data_error = F.coalesce(F.get_json_object(F.col("data"), "$.message"), F.get_json_object(F.col("data"), "$.error"))
    own_error = F.when(F.col("error") != "", F.col("error"))
    reported = F.get_json_object(F.col("data"), "$.error")
    reported = F.when((reported != "") & ~reported.isin("null", "false", "[]", "{}"), reported)
    error = F.coalesce(own_error, reported, F.when(status == "error", data_error))
    failed = error.isNotNull() | F.coalesce(status == "error", F.lit(False))
    success = F.when(failed, F.lit(False)).otherwise(F.coalesce(F.col("success"), F.lit(True)))
    return raw.select(
        F.xxhash64("file_run", *[c for c in TOOL_CALL_SCHEMA.names]).alias("event_id"),
        _ts(F.col("timestamp")).alias("ts"),
        F.coalesce(F.col("run_id"), F.col("file_run")).alias("run_id"),
        F.col("agent_name").alias("agent"),
        F.coalesce(F.col("tool"), F.col("tool_name")).alias("tool"),
        success.alias("success"),
        error.alias("error"),
        F.coalesce(F.col("data"), F.col("output")).alias("payload"),
    )


# Nested values are opened this many levels deep; what lies deeper stays as JSON text.
PAYLOAD_LEVELS = 4


def _kind(v: str) -> F.Column:
    """The JSON kind of a variant."""
    schema = F.schema_of_variant(v)
    named = F.when(schema == "VOID", "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
    return named.when(F.startswith(schema, F.lit("OBJECT<")), "object").when(F.startswith(schema, F.lit("ARRAY<")), "array").otherwise("number")


def _members(v: str, path: str) -> F.Column:
    """(path, value) of an object's or array's members; any other value, and an empty one, is its own only member."""
    dot = F.when(F.col(path) == "", F.lit("")).otherwise(F.lit("."))
    of_object = F.transform(
        F.map_entries(F.try_variant_get(v, "$", "map<string, variant>")),
        lambda e: F.struct(F.concat(F.col(path), dot, e["key"]).alias(path), e["value"].alias(v)),
    )
    of_array = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda e, i: F.struct(F.concat(F.col(path), F.lit("["), i.cast("string"), F.lit("]")).alias(path), e.alias(v)),
    )
    kind = _kind(v)
    itself = F.array(F.struct(F.col(path), F.col(v)))
    opened = F.when(kind == "object", of_object).when(kind == "array", of_array)
    return F.when(F.size(opened) > 0, opened).otherwise(itself)


def payload_fields(calls: DataFrame, columns: list[str], levels: int = PAYLOAD_LEVELS) -> DataFrame:
    """The values inside JSON columns, one row each: (<other columns>, side, path, kind, text, number).

    ``side`` names the column. ``path`` is the place (``a.b[0].c``), ``kind`` one of
    string, number, boolean, null, object, array, bad; ``text`` holds strings
    as they are and other values as JSON, ``number`` numbers as doubles.
    Objects and arrays are opened down to ``levels``; an empty one, and what lies
    below that, is a row of its own. Text that is no JSON (an object that names
    a key twice included) is one row of kind ``bad``; a null column has no row.
    One pass over the rows, no shuffle and no Python.
    """
    keep = [f"`{c}`" for c in calls.columns if c not in columns]
    sides = [F.struct(F.lit(c).alias("side"), F.col(f"`{c}`").cast("string").alias("__json")) for c in columns]
    rows = calls.select(*keep, F.inline(F.array(*sides))).filter(F.col("__json").isNotNull())
    bad = F.when(F.try_parse_json("__json").isNull(), F.col("__json")).alias("__bad")
    rows = rows.select(*keep, "side", F.lit("").alias("path"), bad, F.try_parse_json("__json").alias("__v"))
    for _ in range(levels):
        rows = rows.select(*keep, "side", "__bad", F.inline(_members("__v", "path")))
    kind = F.when(F.col("__v").isNull(), "bad").otherwise(_kind("__v"))
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == "bad", F.col("__bad")).when(F.col("kind") == "string", F.try_variant_get("__v", "$", "string"))
    number = F.when(F.col("kind") == "number", F.try_variant_get("__v", "$", "double"))
    return rows.select(*keep, "side", "path", "kind", text.otherwise(F.to_json("__v")).alias("text"), number.alias("number"))


def bad_payloads(fields: DataFrame) -> DataFrame:
    """(side, n_bad, n_values) of :func:`payload_fields`: texts that are no JSON, and values found."""
    bad = F.col("kind") == "bad"
    return fields.groupBy("side").agg(F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_values"))


def read_tool_calls(spark: SparkSession, base: str) -> DataFrame:
    return unify_tool_calls(read_records(spark, base, "tool_calls.jsonl", TOOL_CALL_SCHEMA).withColumnRenamed("run", "file_run"))


def read_decisions(spark: SparkSession, base: str) -> DataFrame:
    raw = read_records(spark, base, "decisions.jsonl", DECISION_SCHEMA)
    return raw.select(
        F.col("run").alias("run_id"),
        _ts(F.col("timestamp")).alias("ts"),
        F.col("timestamp").alias("timestamp_text"),
        "agent",
        "decision",
        "reason",
    )


def read_run_metadata(spark: SparkSession, base: str) -> DataFrame:
    """One row per run folder that has a ``metadata.json``."""
    raw = _read(spark, f"{base.rstrip('/')}/*/metadata.json", METADATA_SCHEMA, multi_line=True)
    folder = F.regexp_extract(F.col("_file"), r"/([^/]+)/metadata\.json(/[^/]*)?$", 1)
    return raw.select(F.coalesce("run_id", folder).alias("run_id"), folder.alias("folder"), *[c for c in METADATA_SCHEMA.names if c != "run_id"])


def run_history_from_metadata(meta: DataFrame) -> DataFrame:
    """L1: runs by folder name, newest first; folders without metadata never appear."""
    return meta.orderBy(F.col("folder").desc())


def read_kpi_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KPI_DOC_SCHEMA).option("multiLine", True).json(path)


def read_kpi_documents(spark: SparkSession, base: str) -> DataFrame:
    """The KPI document of every run folder (``<run>/artifacts/insights.json``), with its run id."""
    raw = _read(spark, f"{base.rstrip('/')}/*/artifacts/insights.json", KPI_DOC_SCHEMA, multi_line=True)
    run = F.regexp_extract(F.col("_file"), r"/([^/]+)/artifacts/insights\.json(/[^/]*)?$", 1)
    return raw.select(run.alias("run_id"), *KPI_DOC_SCHEMA.names)


def document_breakdowns(doc: DataFrame) -> DataFrame:
    """Long form (section, name, value) of the three breakdown maps of a KPI document."""
    parts = []
    for section in ["CA_par_mois", "CA_par_pays_top10", "top_10_produits"]:
        parts.append(
            doc.select(F.lit(section).alias("section"), F.explode(F.col(f"kpis.{section}")).alias("name", "value"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
