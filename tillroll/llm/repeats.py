"""Exact removal of repeated byte strings, by a depth-limited radix sort of suffixes.

Method: suffixes are told apart by their first ``threshold`` bytes only, in
most-significant-digit passes; a group with one member leaves the sort at
once, and equal groups after the last pass are exactly the repeated strings.

A digit is a stretch of the string that is compared by hash. The first digit
is the string's least k-byte window (by hash, leftmost if equal): neighbouring
suffixes mostly share it, so a run of them goes through the pass as one row,
the anchor. Rows that agree in the digit and in all the bytes of their run are
one class: every member but the earliest is repeated, and only the earliest
goes on. A group of several classes is cut into runs of ``RUN`` suffixes,
whose common bytes are the second digit, and those into single suffixes, whose
whole string is the last digit. A pass is one shuffle sorted by digit, which
is read as a stream: memory does not depend on the size of a group.

Strings are compared by two 64-bit hashes, of the digit and of the run.

Defined results: a null text is the empty text; matches never cross texts;
rows with a null id neither lose bytes nor take them from others; rows that
repeat an id are one document (a string at the same place is not earlier); an
empty table gives no rows; other columns pass through, and columns named like
the outputs are replaced. A very long text is worked on in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import Scratch, add_columns, split_by_ids
from tillroll.llm.shingles import mix

THRESHOLD = 100
# Bytes of the first digit, suffixes of a run in the second pass, bytes of a text worked on at once.
K = 32
RUN = 8
SEGMENT = 1 << 19

_rng = np.random.default_rng(0xD16175)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) << 1 | 1
_POWER = np.ones(0, np.uint64)
_INVERSE = np.ones(0, np.uint64)
_C = [np.uint64(int(c) | 1) for c in _rng.integers(0, 2**63, 3, dtype=np.uint64)]
_K_TERM = np.uint64(K * int(_C[0]) % 2**64)


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`_hash` takes any stretch's hash."""
    global _POWER, _INVERSE
    if len(_POWER) < len(raw) + 1:
        n = 2 * len(raw) + 1024
        one = np.ones(1, np.uint64)
        _POWER = np.concatenate([one, np.cumprod(np.full(n, _BASE % 2**64, np.uint64))])
        _INVERSE = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 2**64), np.uint64))])
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64) * _C[0])


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def anchors(raw: np.ndarray, threshold: int) -> dict[str, np.ndarray]:
    """Of one segment: place, first and last suffix, and the two hashes of every run."""
    sums = _sums(raw)
    at = np.arange(len(raw) - K + 1)
    low = mix((sums[K:] - sums[:-K]) * _INVERSE[: len(at)] + _K_TERM)
    # The place in the low bits makes the leftmost of equal windows the least.
    packed = (low & ~np.uint64((1 << 20) - 1)) | at.astype(np.uint64)
    place = (_sliding_min(packed, threshold - K + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    p = place[first]
    run = _hash(sums, first, last + threshold)
    run = mix(run ^ ((p - first).astype(np.uint64) * _C[1] + (last - first).astype(np.uint64) * _C[2]))
    return {"core": low[p], "span": run, "lo": first, "hi": last, "p": p}


def digits(raw: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, threshold: int) -> dict[str, np.ndarray]:
    """The runs of ``width`` suffixes (by distance to the anchor) into which given runs are cut."""
    sums = _sums(raw)
    near, far = (p - hi) // width, (p - lo) // width
    n = far - near + 1
    of = np.repeat(np.arange(len(p)), n)
    part = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + near[of]
    p, lo, hi = p[of], lo[of], hi[of]
    closest, farthest = part * width, np.minimum(part * width + width - 1, threshold - K)
    first, last = np.maximum(lo, p - farthest), np.minimum(hi, p - closest)
    core = mix(_hash(sums, p - closest, p - farthest + threshold) ^ (part.astype(np.uint64) * _C[1]))
    run = _hash(sums, first, last + threshold)
    run = mix(run ^ ((p - first).astype(np.uint64) * _C[1] + (last - first).astype(np.uint64) * _C[2]))
    return {"core": core, "span": run, "lo": first, "hi": last, "p": p}


_ROWS = pa.schema([("core", pa.int64()), ("span", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("p", pa.int64())])
_ROWS_DDL = "core bigint, span bigint, doc bigint, th bigint, lo bigint, hi bigint, p bigint"
_CLASSED = pa.schema([("goes_on", pa.bool_()), *list(_ROWS)[2:]])
_CLASSED_DDL = "goes_on boolean, doc bigint, th bigint, lo bigint, hi bigint, p bigint"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _batch(parts: list[tuple[int, int, dict[str, np.ndarray]]]) -> pa.RecordBatch:
    sizes = [len(x["p"]) for _, _, x in parts]
    whole = {k: np.concatenate([x[k] for _, _, x in parts]) for k in ("core", "span", "lo", "hi", "p")}
    whole["doc"] = np.repeat(np.array([d for d, _, _ in parts], np.int64), sizes)
    whole["th"] = np.repeat(np.array([t for _, t, _ in parts], np.int64), sizes)
    return pa.RecordBatch.from_arrays([pa.array(whole[f.name].astype(np.int64, copy=False)) for f in _ROWS], schema=_ROWS)


def _shifted(rows: dict[str, np.ndarray], by: int) -> dict[str, np.ndarray]:
    return rows | {k: rows[k] + by for k in ("lo", "hi", "p")}


def _gathered(parts: Iterator[tuple[int, int, dict[str, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[2]["p"])
        if size >= 1 << 16:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _first_pass(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for doc, th, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = np.frombuffer(data, np.uint8)
                for at in range(0, len(raw) - threshold + 1, SEGMENT):
                    yield doc, th, _shifted(anchors(raw[at : at + SEGMENT + threshold - 1], threshold), at)

    return _gathered(parts())


def _next_pass(batches: Iterator[pa.RecordBatch], width: int, threshold: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for i in range(batch.num_rows):
                doc, th, data = (batch.column(c)[i].as_py() for c in range(3))
                raw = np.frombuffer(data, np.uint8)
                runs = batch.column(3)[i].values
                p, lo, hi = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("p", "lo", "hi"))
                segment = lo // SEGMENT
                for s in np.unique(segment):
                    own, at = segment == s, max(0, int(s) * SEGMENT - threshold)
                    part = raw[at : (int(s) + 1) * SEGMENT + 3 * threshold]
                    yield doc, th, _shifted(digits(part, p[own] - at, lo[own] - at, hi[own] - at, width, threshold), at)

    return _gathered(parts())


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by core, span, doc and lo: repeated runs, and each class's first if its core has other classes."""
    core = span = doc = lo = None  # of the running class's first row
    count, waiting = 0, None  # classes of the running core (up to 2), and its first one while it is the only one
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        rows = {f.name: batch.column(i).to_numpy() for i, f in enumerate(batch.schema)}
        at = np.arange(n)
        new_core, new_class = np.ones(n, bool), np.ones(n, bool)
        new_core[1:] = rows["core"][1:] != rows["core"][:-1]
        new_class[1:] = new_core[1:] | (rows["span"][1:] != rows["span"][:-1])
        if core is not None and rows["core"][0] == core:
            new_core[0], new_class[0] = False, rows["span"][0] != span
        head = np.maximum.accumulate(np.where(new_class, at, 0))
        first_doc, first_lo = rows["doc"][head], rows["lo"][head]
        if not new_class[0]:
            before = at < (np.argmax(new_class) if new_class.any() else n)
            first_doc, first_lo = np.where(before, doc, first_doc), np.where(before, lo, first_lo)
        again = ~new_class & ((rows["doc"] != first_doc) | (rows["lo"] != first_lo))

        run = np.cumsum(new_core)  # 0: the core that runs on from the batch before
        firsts = np.flatnonzero(new_class)
        counts = np.bincount(run[firsts], minlength=run[-1] + 1)
        runs_on = not new_core[0]
        if runs_on:
            counts[0] += count
        elif waiting is not None:
            waiting = None  # its core had no other class
        several = counts >= 2
        chosen = firsts[several[run[firsts]]]
        out = [np.concatenate([np.zeros(int(again.sum()), bool), np.ones(len(chosen), bool)])]
        order = np.concatenate([np.flatnonzero(again), chosen])
        out += [rows[f.name][order] for f in list(_CLASSED)[1:]]
        if waiting is not None and several[0]:
            out = [np.append(x, w) for x, w in zip(out, [True, *waiting])]
            waiting = None
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CLASSED)], schema=_CLASSED)

        end = int(run[-1])
        if not several[end] and counts[end] and not (end == 0 and runs_on and waiting is not None):
            only = firsts[run[firsts] == end]
            if len(only):
                waiting = [rows[f.name][only[0]] for f in list(_CLASSED)[1:]]
        count = int(min(2, counts[end]))
        core, span, doc, lo = rows["core"][-1], rows["span"][-1], first_doc[-1], first_lo[-1]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(body).alias("th"), body.cast("binary").alias("data"))


def repeated_runs(df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, start, end): stretches covered by strings that also start earlier (they may overlap).

    ``th`` is the hash of the row's text, which tells rows of one id apart.
    """
    if threshold <= K:
        raise ValueError(f"the threshold must be over {K} bytes")
    scratch = Scratch(df.sparkSession, "repeats")
    texts = _texts(df, id_col, text_col).filter("doc is not null")

    def one_pass(rows: DataFrame, name: str) -> DataFrame:
        ordered = rows.repartition("core").sortWithinPartitions("core", "span", "doc", "lo")
        return scratch.keep(ordered.mapInArrow(_classes, _CLASSED_DDL), name)

    long_enough = texts.filter(F.octet_length("data") >= threshold).select("doc", "th", "data")
    # Whole copies of a text with a smaller id go without a sort: only that one's suffixes enter it.
    named = long_enough.select("doc", "th", F.md5("data").alias("md5"), F.octet_length("data").cast("bigint").alias("end"))
    firsts = named.groupBy("th", "md5").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    copies = scratch.keep(named.join(firsts, ["th", "md5"]).filter("doc > first").select("doc", "th", "end").distinct(), "copies")
    touched, rest = split_by_ids(long_enough, "doc", copies.select("doc"))
    single = touched.join(copies.select("doc", "th"), ["doc", "th"], "left_anti").unionByName(rest)
    passes = [one_pass(single.mapInArrow(lambda b: _first_pass(b, threshold), _ROWS_DDL), "first")]
    for width in (RUN, 1):
        # What goes on of a text is at most one row for each of its anchors or suffixes.
        runs = passes[-1].filter("goes_on").groupBy("doc", "th").agg(F.collect_set(F.struct("p", "lo", "hi")).alias("runs"))
        runs = scratch.keep(runs, "runs")
        chosen, _ = split_by_ids(long_enough, "doc", runs.select("doc"))
        again = chosen.join(runs, ["doc", "th"]).select("doc", "th", "data", "runs").dropDuplicates(["doc", "th"])
        passes.append(one_pass(again.mapInArrow(lambda b, w=width: _next_pass(b, w, threshold), _ROWS_DDL), f"run{width}"))
    found = passes[0].filter("not goes_on")
    for p in passes[1:]:
        found = found.unionByName(p.filter("not goes_on"))
    runs = found.select("doc", "th", F.col("lo").alias("start"), (F.col("hi") + threshold).alias("end"))
    return runs.unionByName(copies.select("doc", "th", F.lit(0).cast("bigint").alias("start"), "end"))


def cut(data: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``data``, the number of removed bytes and of maximal removed runs."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for start, stop in sorted(runs):
        if start > end:
            spans += 1
            kept.append(data[at:start])
            removed += stop - start
        elif stop > end:
            removed += stop - end
        end = max(end, stop)
        at = end
    return b"".join(kept) + data[at:], removed, spans


def remove_repeats(
    df: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False
) -> DataFrame:
    """``df`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that are left of each text.

    With ``as_text``, ``kept`` is a string, without the rest of a character
    of which only some bytes are left.
    """
    scratch = Scratch(df.sparkSession, "cuts")
    added = ["n_bytes", "n_removed", "n_spans", "kept", "_doc", "_th", "_runs"]
    rows = df.select(*[c for c in df.columns if c not in added or c in (id_col, text_col)])
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumns({"_doc": F.col(id_col).cast("bigint"), "_th": F.xxhash64(body)})
    found = repeated_runs(df, threshold, id_col, text_col)
    runs = scratch.keep(
        found.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("_runs")), "runs"
    )

    touched, whole = split_by_ids(rows, "_doc", runs.select("doc"))
    named = runs.withColumnsRenamed({"doc": "_doc", "th": "_th"})

    def make():
        def work(batch: pa.RecordBatch) -> list:
            data = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            runs = batch.column(batch.schema.get_field_index("_runs")).to_pylist()
            out = [cut(d or b"", [(r["start"], r["end"]) for r in rs or []]) for d, rs in zip(data, runs)]
            kept = [x[0].decode("utf-8", "ignore") if as_text else x[0] for x in out]
            return [[x[1] for x in out], [x[2] for x in out], kept]

        return work

    zero = F.lit(0).cast("bigint")
    cuts = add_columns(touched.join(named, ["_doc", "_th"], "left"), f"n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}", make)
    rest = whole.withColumns({"n_removed": zero, "n_spans": zero, "kept": body if as_text else body.cast("binary")})
    both = cuts.drop("_runs").unionByName(rest)
    return both.withColumn("n_bytes", F.octet_length(body).cast("bigint")).drop("_doc", "_th")
