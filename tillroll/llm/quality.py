"""Quality classifier: a support vector machine on naive Bayes features.

Method: a text's features are indicators of its byte n-grams (hashed) and of
runs of one repeated word; each is scaled by the log ratio of its smoothed
counts in the two classes, rows are scaled to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent. Part of the rows is
kept from the fit and gives the logistic curve from margins to scores, with
the class shares of all labelled rows.

The fit sees a bounded sample of labelled rows, at most ``PER_CLASS`` of each
class, chosen by a hash of the id; it runs in one task on the rows' features.
Class shares are counted over all labelled rows; every text is scored whole.
The model is two arrays of fixed size.

Defined results: a null text is the empty text, which has a score too; labels
other than 0 and 1, null labels and null ids are not learned from; an id
labelled more than once counts as 1 if half of its labels do; an id with
several texts is learned from one of them; without labels of both classes
every score is the smoothed share of label 1; rows are scored one by one, so
ties, repeated rows and empty tables need no rule; other columns pass through,
and a column named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import add_columns

# Longest n-gram, feature buckets (a power of two), lengths of word runs with a feature of their own.
LONGEST, BITS = 4, 18
RUNS = (1, 2, 4, 8)
# Rows of each class in the fit; passes over them; bound of a row's weight in the dual; share kept for the curve.
PER_CLASS, EPOCHS, COST, KEPT = 4000, 10, 1.0, 5
PIECE = 1 << 20
_STEP = np.uint32(0x9E3779B1)
_SALT = [np.uint32(s) for s in (0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


class Features:
    """Feature numbers of whole texts (one object per task: it holds a work array)."""

    def __init__(self):
        self._on = np.zeros(1 << BITS, bool)

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of the features a text has, sorted."""
        data = (text or "").encode()
        on = self._on
        for at in range(0, len(data), PIECE):
            raw = np.frombuffer(data[at : at + PIECE + LONGEST - 1], np.uint8).astype(np.uint32)
            h = np.zeros(len(raw), np.uint32)
            for n in range(min(LONGEST, len(raw))):
                h = (h[: len(raw) - n] ^ raw[n:]) * _STEP
                h ^= h >> np.uint32(15)
                on[(h * _SALT[n % len(_SALT)] + np.uint32(n)) >> np.uint32(32 - BITS)] = True
        words = data.split()
        same = bytes(map(eq, words[1:], words))
        for i, run in enumerate(RUNS):
            if b"\1" * run in same:
                on[i] = True
        found = np.flatnonzero(on)
        on[found] = False
        return found.astype(np.int32)


@dataclass
class Model:
    """Weight of each feature (log ratio included), its squared log ratio, bias, and the curve's slope and offset."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        size = float(np.sqrt(self.squares[features].sum(dtype=np.float64)))
        return float(self.weights[features].sum(dtype=np.float64)) / size + self.bias if size > 0 else self.bias

    def score(self, features: np.ndarray) -> float:
        return _logistic(self.slope * self.margin(features) + self.offset)


def _logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _constant(n1: int, n0: int) -> Model:
    none = np.zeros(1 << BITS, np.float32)
    return Model(none, none, 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))


def descend(rows: list[np.ndarray], scaled: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the hinge loss, by dual coordinate descent."""
    rng = np.random.default_rng(1)
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in scaled])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], scaled[i], signs[i]
            gradient = y * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), costs[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
    return w, bias


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve through smoothed labels, by Newton's method."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        gradient = x.T @ (p - target) + 1e-6 * np.array([a, b])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if float(np.abs(step).max()) < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def train(rows: list[np.ndarray], labels: np.ndarray, n1: int, n0: int) -> Model:
    """A model of the sample's features and labels; n1, n0: labelled rows in all."""
    size = 1 << BITS
    kept = np.arange(len(rows)) % KEPT == 0
    if min(labels[kept].sum(), (1 - labels[kept]).sum()) < 2:
        kept[:] = False  # too few to set aside: the curve goes through the fitted rows
    fitted = np.flatnonzero(~kept)
    if len(set(labels[fitted].tolist())) < 2:
        return _constant(n1, n0)
    counts = [np.ones(size), np.ones(size)]
    for i in fitted:
        counts[int(labels[i])][rows[i]] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    some = [rows[i] for i in fitted]
    scaled = []
    for x in some:
        v = ratio[x]
        length = float(np.sqrt((v * v).sum()))
        scaled.append(v / length if length > 0 else v)
    y = labels[fitted]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    w, bias = descend(some, scaled, np.where(y == 1, 1.0, -1.0), COST * 0.5 / share[y], size)
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias), 1.0, 0.0)
    seen = np.flatnonzero(kept) if kept.any() else fitted
    margins = np.array([model.margin(rows[i]) for i in seen])
    slope, offset = curve(margins, labels[seen])
    s1, s0 = int(labels[seen].sum()), int((1 - labels[seen]).sum())
    model.slope, model.offset = slope, offset + float(np.log(max(n1, 1) / max(n0, 1)) - np.log(max(s1, 1) / max(s0, 1)))
    return model


_MODEL = pa.schema([("weights", pa.binary()), ("squares", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64())])


def held_out(id_col: Column) -> Column:
    """The rows that are never learned from: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS
) -> Model:
    """A model from the labelled rows of ``df`` that are not held out."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    marks = marks.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return _constant(n1, n0)
    order = F.xxhash64("id", F.lit(7))
    sample = [marks.filter(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class rows are broadcast.
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample[0].unionByName(sample[1])), "id")
    id_type = dict(chosen.dtypes)["id"]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [features.of(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.binary())], names=["id", "y", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[2]))
        model = train([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows]), n1, n0)
        row = {"weights": model.weights.tobytes(), "squares": model.squares.tobytes(), "bias": model.bias, "slope": model.slope, "offset": model.offset}
        yield pa.RecordBatch.from_pylist([row], schema=_MODEL)

    found = chosen.select("id", "text", "y").mapInArrow(featured, f"id {id_type}, y int, x binary").dropDuplicates(["id"])
    ddl = "weights binary, squares binary, bias double, slope double, offset double"
    got = found.repartition(1).mapInArrow(fitted, ddl).collect()  # one row of fixed size
    if not got:
        return _constant(n1, n0)
    r = got[0]
    return Model(np.frombuffer(r["weights"], np.float32), np.frombuffer(r["squares"], np.float32), r["bias"], r["slope"], r["offset"])


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: how likely label 1 is, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        features, held = Features(), shared.value
        return lambda b: [[held.score(features.of(t)) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]]

    return add_columns(df, f"`{out}` double", make)
