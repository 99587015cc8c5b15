"""Helpers shared by the operators: table readers, Arrow row maps, scratch tables."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillroll.session import drop_scratch, scratch_dir

# Rows handed back to Spark at once: bounded by rows and by bytes of input.
OUT_ROWS = 1024
OUT_BYTES = 8 << 20
# Buckets by which the rows of a set of ids are chosen.
CHOICE_BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of bounded rows and bytes (a single long row stays whole)."""
    if batch.num_rows == 0:
        return
    mean = max(1, batch.nbytes // batch.num_rows)
    step = max(1, min(OUT_ROWS, OUT_BYTES // mean))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def add_columns(
    df: DataFrame,
    added: str,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
) -> DataFrame:
    """Append computed columns to every row; columns of the same name are replaced.

    ``added`` is a DDL list of the new columns. ``make`` runs once per task
    (it loads what the rows need) and returns a function from a record batch
    (all columns of ``df``) to one array or list per new column.
    """
    new = T._parse_datatype_string(added)
    names = {f.name for f in new.fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + new.fields)
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = make()
        for whole in batches:
            for batch in slices(whole):
                arrays = [batch.column(batch.schema.get_field_index(n)) for n in kept_names]
                for field, values in zip(arrow, [None] * len(kept) + list(work(batch))):
                    if values is not None:
                        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
                arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def bucket(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(CHOICE_BUCKETS))


def fresh_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of ``frames`` is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_ids(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be among ``ids`` (one bigint column), and the rest, which passes by without a shuffle.

    What is broadcast are the ids' hash buckets: at most ``CHOICE_BUCKETS``
    short rows, whatever the data. With more ids, more rows count as touched.
    """
    name = fresh_name("_bucket", df)
    found = F.broadcast(ids.select(bucket(ids.columns[0]).alias(name)).distinct())
    marked = df.withColumn(name, bucket(id_col))
    return marked.join(found, name, "left_semi").drop(name), marked.join(found, name, "left_anti").drop(name)


class Known(dict):
    """A bounded memo of ``make(key)``: a full memo starts again empty, long keys are not kept."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 64):
        super().__init__()
        self._make, self._most, self._longest = make, most, longest

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._most:
                self.clear()
            self[key] = value
        return value


class Scratch:
    """Tables written once under the shared checkpoint folder and read back.

    Cuts lineage and survives the loss of executors: the files lie in the
    folder that ``spark.checkpoint.dir`` names.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")
        self._n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.base}/{name}-{self._n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        drop_scratch(self.spark, kept._scratch_path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished writes now (it does once the driver collects garbage)."""
        gc.collect()
        self.spark._jvm.System.gc()
