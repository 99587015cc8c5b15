"""Invoice CSV files → canonical raw lines.

Every field is read as text (header row, RFC-4180 quoting with doubled
quotes), pandas' null tokens become nulls, aliased headers get canonical
names, and the text is cast to the canonical types. This mirrors what
``pandas.read_csv`` infers for these files without a schema-inference pass
over the data.

Files are matched by column name: a Spark job reads the first line of each
file, files are grouped by it, each group is read with its own header, and the
groups are put together by name.
A quoted field may hold a newline (``multi_line``, the default; a file is then
one split, so very large files without such fields are better read with
``multi_line=False``). A record that does not parse is never passed on as
nulls: it raises, or, with ``bad="keep"``, carries its problem in a column.
"""

from __future__ import annotations

import csv as _csv
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.nulls import normalize_null_tokens
from tillroll.schema import CLEAN_SCHEMA, RAW_SCHEMA, rename_to_canonical

# Date layouts of the invoice files, tried in order.
PROBLEM = "problem"
_BROKEN = "_corrupt_record"
# Split size at which every file is a split of its own.
_ONE_FILE = 1 << 42
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "M/d/yyyy H:mm", "yyyy-MM-dd"]


def parse_invoice_date(text: Column, strict: bool = False) -> Column:
    """First format that parses; ``strict`` raises on text that none parses."""
    # The stated layouts first, then Spark's ISO-8601 reading (fractions, 'T').
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS] + [F.try_to_timestamp(text)]
    parsed = F.coalesce(*tries).cast("timestamp_ntz")
    if not strict:
        return parsed
    bad = parsed.isNull() & text.isNotNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("unparsable invoice date: "), text)).cast("timestamp_ntz")).otherwise(parsed)


def _number(text: Column, to: str) -> Column:
    """The number a text states; null for other text (and for a fraction where a whole number is asked for)."""
    as_double = text.try_cast("double")
    if to == "bigint":
        # "6" and "6.0" both read as 6.
        return F.coalesce(text.try_cast("bigint"), F.when(as_double == F.floor(as_double), as_double.cast("bigint")))
    return as_double


def typed_lines(text_df: DataFrame, strict_dates: bool = False, layout: str = "auto", bad: str = "raise",
                fractional: bool = False) -> DataFrame:
    """Canonical layout from a frame of text columns (missing columns are null).

    ``layout`` is ``raw`` (8 columns), ``clean`` (12 columns, customer id as
    text) or ``auto``: clean when the file carries a Sales column.
    ``fractional`` reads quantities as doubles. ``bad`` says what becomes of a
    line with text that its column's type can't hold, or with too many or too
    few fields: ``raise``, or ``keep`` (column ``problem`` names the fields).
    An unreadable date is a missing date, as the analysis counts it under its
    own month, unless ``strict_dates``.
    """
    df = normalize_null_tokens(rename_to_canonical(text_df))
    if layout == "auto":
        layout = "clean" if "sales" in df.columns else "raw"
    schema = CLEAN_SCHEMA if layout == "clean" else RAW_SCHEMA
    cols, problems = [], []
    for field in schema.fields:
        if field.name not in df.columns:
            cols.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = text = F.col(field.name)
        kind = field.dataType.simpleString()
        if kind == "bigint":
            c = _number(c, "double" if fractional and field.name == "quantity" else "bigint")
        elif kind == "double":
            c = _number(c, "double")
        elif kind == "int":
            c = _number(c, "bigint").cast("int")
        elif kind.startswith("decimal"):
            c = c.try_cast(field.dataType)
        elif kind == "timestamp_ntz":
            c = parse_invoice_date(c, strict_dates)
        if kind not in ("string", "timestamp_ntz"):
            problems.append(F.when(c.isNull() & text.isNotNull(), F.lit(field.name)))
        cols.append(c.alias(field.name))
    if _BROKEN in df.columns:
        problems.append(F.when(F.col(_BROKEN).isNotNull(), F.lit("fields")))
    named = F.array_join(F.array_compact(F.array(*problems)), ",") if problems else F.lit("")
    problem = F.when(named != "", named)
    if bad == "keep":
        return df.select(*cols, problem.alias(PROBLEM))
    if problems:
        shown = F.concat(F.lit("unparsable invoice line: "), problem)
        df = df.filter(F.when(problem.isNotNull(), F.raise_error(shown).cast("boolean")).otherwise(F.lit(True)))
    return df.select(*cols)


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a task's rows; the rest of its file is not read."""
    for batch in batches:
        if batch.num_rows:
            yield batch.slice(0, 1)
            return


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line): the first line of each file, as bytes, read by one short task a file.

    Files are not split and not put together in this read (split sizes of a
    session of its own), so a task's first row is its file's first line, and
    the task ends after it, however long the file. Empty files have no row.
    """
    alone = spark.newSession()
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        alone.conf.set(key, str(_ONE_FILE))
    alone.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = alone.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_first_line, "file string, line binary")


def _by_header(spark: SparkSession, path: str | list[str], encoding: str) -> dict[tuple[str, ...], list[str]]:
    """The files of each different header, as Spark lists them for a read anyway."""
    found = headers(spark, path).groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files"))
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, files in sorted(map(tuple, found.collect())):
        text = bytes(line).decode(encoding, "ignore").lstrip("\ufeff")
        groups.setdefault(tuple(next(_csv.reader([text]), [])), []).extend(unquote(f) for f in files)
    return groups


def read_text_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """All files as text columns, matched by name; broken records are in ``_corrupt_record``."""
    # A folder's sub-folders (month=2010-01) give columns, as they do when the folder is read whole.
    by_header = _by_header(spark, path, encoding)
    one = isinstance(path, str) and not re.search(r"[*?{\[]", path)
    folder = one and not any(f.endswith(path.rstrip("/")) for files in by_header.values() for f in files)
    frames = []
    for header, group in by_header.items():
        if not any(header):
            continue  # a file whose first line is empty
        fields = ", ".join(f"`{name.replace('`', '``')}` string" for name in header)
        reader = spark.read.option("basePath", path) if folder else spark.read
        frames.append(
            reader.option("header", True)
            .option("encoding", encoding)
            .option("quote", '"')
            .option("escape", '"')
            .option("multiLine", multi_line)
            .option("enforceSchema", True)
            .option("mode", "PERMISSIVE")
            .option("columnPruning", False)  # else the number of fields is not checked
            .option("columnNameOfCorruptRecord", _BROKEN)
            .schema(f"{fields}, `{_BROKEN}` string")
            .csv(group)
        )
    if not frames:
        return spark.createDataFrame([], f"`{_BROKEN}` string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(rename_to_canonical, frames))


def read_invoice_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", strict_dates: bool = False,
                     layout: str = "auto", bad: str = "raise", fractional: bool = False, multi_line: bool = True) -> DataFrame:
    """Invoice lines from CSV (``encoding='ISO-8859-1'`` for Latin-1 files).

    A file written by the cleaning step (with Sales, Year, Month, YearMonth)
    is read in the clean layout, so the analysis can start from it.
    """
    return typed_lines(read_text_csv(spark, path, encoding, multi_line), strict_dates, layout, bad, fractional)


def bad_line_counts(lines: DataFrame) -> DataFrame:
    """(problem, n_lines) of lines that were read with ``bad="keep"``."""
    return lines.filter(F.col(PROBLEM).isNotNull()).groupBy(PROBLEM).agg(F.count(F.lit(1)).alias("n_lines"))
