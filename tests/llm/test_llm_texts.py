"""License scan, personal data, repeats, near-duplicate texts and quality against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.llm import jaccard, licenses, pii, quality, repeats, shingles
from tillroll.llm import queries as Q

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    None, "", "a@b.c-d_x@e.f.g. ..@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111x12 34", "+1 (234) 555-1234 +12 +1234567890123456 é日+49 30 1234567.",
    "MIT License mit-license Apache license GENERAL public LICENSE mit mit license license", "Kmit license ſ",
    "x@y." + "a." * 20000 + "z", "1 " * 20000, "4" * 30000, "a@b" * 3000, "mit license " * 3000,
]


def odd_texts(n):
    rng = random.Random(3)
    bits = ["1", "23", "4111111111111111", " ", "-", ".", "@", "a", "b.c", "é", "日", "+", "(", "255", "mit ", "license ", "MIT", "general public license", "apache"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def odd_frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, None, "again", 2), (None, texts[2], "no id", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_words int").repartition(4)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_personal_data_spans(spark):
    texts = odd_texts(600)
    df = odd_frame(spark, texts)
    got = pii.find(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert [(s.start, s.rank, s.end, s.kind) for s in r.spans if s.kind in pii.BASE] == base_spans(r.text or "")
    assert pii.find(df.limit(0)).collect() == []
    plan = pii.find(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_added_kinds_and_context(spark):
    rows = [
        (1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "pay to GB82 WEST 1234 5698 7654 33 now"),
        (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "my card 4111111111111111 or"),
    ]
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [("iban", 0.8)], 2: [], 3: [("ssn", 0.6)], 4: [], 5: [("card", 1.0)]}


DE, GB = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


IBANS = [
    (f"{DE} Please call", [DE]), (f"{DE} I agree", [DE]), (f"{GB} BIC NWBKGB2L", [GB]), (f"é {DE} A1 B2 C3 D4 E5 F6 G7 H8x", [DE]),
    ("DE89370400440532013000 EUR 50", ["DE89370400440532013000"]), ("DE89370400440532013000 12 items", ["DE89370400440532013000"]),
    (f"IBAN {DE} {GB} BIC", [DE, GB]), (f"REF1 AB12 {DE} OK", [DE]), (f"{DE}.{GB}, {DE}", [DE, GB, DE]), (f"{DE}\n{GB}", [DE, GB]),
    (f"{DE}x", []), (f"{DE}9", []), (f"x{DE}", []), ("DE89 3704 0044 0532 0130 01 EUR", []), ("DE89 3704", []),
    ("ZZ66 0000 0000 0000 0000 Please", ["ZZ66 0000 0000 0000 0000"]), ("NO93 8601 1117 947", ["NO93 8601 1117 947"]),
    ("MT84 MALT 0110 0001 2345 MTLC AST0 01S AND MORE", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]), (f"{GB} " * 200, [GB] * 200),
]


def test_ibans_end_where_they_are_valid(spark):
    got = pii.find(spark.createDataFrame([(t,) for t, _ in IBANS], "text string").coalesce(1)).collect()
    assert [(r.text, [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"]) for r in got] == IBANS


def test_mask_replaces_spans(spark):
    rows = [(1, "é a@b.cd x +1 (234) 555-1234, 1.2.3.4"), (2, None), (3, "clean"), (4, "4111111111111111")]
    got = {r.doc_id: r.text for r in pii.mask(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got == {1: "é [EMAIL] x [PHONE], [IP]", 2: None, 3: "clean", 4: "[CARD]"}


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_license(text):
    words = WORDS.findall(text.translate(LOW))
    starts, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = odd_texts(400) + ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software"]
    df = odd_frame(spark, texts)
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(r.text or "")
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    best = next(r for r in got if (r.text or "").startswith("Permission"))
    assert (best.base_labels, best.labels, best.score) == ("", "mit", 1.0)
    assert licenses.scan(df.limit(0)).collect() == []
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def repeat_rows():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 900))) for _ in range(12)]
    rows = []
    for i in range(160):
        kind, t = rng.random(), rng.choice(base)
        if kind < 0.3:
            pass
        elif kind < 0.6:
            t = list(t)
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = "z"
            t = "".join(t)
        elif kind < 0.7:
            t = "ab" * rng.randint(1, 400)
        elif kind < 0.8:
            t = "".join(rng.choice("xyz") for _ in range(rng.randint(0, 20))) + "a" * rng.randint(0, 500)
        elif kind < 0.95:
            cut, other = rng.randrange(len(t)), rng.choice(base)
            t = t[cut:] + other[: rng.randrange(len(other))] + t[:cut]
        else:
            t = rng.choice([None, ""])
        rows.append((i * 3, t))
    # One text longer than a segment, with a late copy of an early stretch and of another text.
    long = "".join(rng.choice("pqrstuvw \n") for _ in range(repeats.SEGMENT + 3000))
    rows.append((1000, long + long[100:400] + (base[0] * 2)[:300]))
    return rows


def brute_repeats(rows, size):
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - size + 1):
            w = data[s : s + size]
            if w in seen:
                gone[s : s + size] = b"\1" * size
            else:
                seen[w] = True
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, kept string, core int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(df).collect()}
    assert got == brute_repeats(rows, repeats.THRESHOLD)


def test_repeats_of_equal_and_null_ids(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, t), (1, t), (None, t), (2, "x" + t + "y"), (3, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in got)
    assert out == [(0, 300, 0, 0, t), (1, 300, 0, 0, t), (1, 300, 0, 0, t), (2, 302, 300, 1, "xy"), (3, 0, 0, 0, "")]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(none).collect() == []


@pytest.mark.parametrize("size", [1, 3, 4, 8])
def test_classes_do_not_depend_on_batches(size):
    import pyarrow as pa

    rng = random.Random(size)
    rows = sorted((rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 5), 0, rng.randint(0, 5) * 10, 0, 0) for _ in range(60))
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
    whole = pa.RecordBatch.from_arrays(columns, schema=repeats._ROWS)
    parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
    flat = lambda bs: sorted(tuple(r.values()) for b in repeats._classes(iter(bs)) for r in b.to_pylist())
    assert flat(parts) == flat([whole])
    first, spans = {}, collections.defaultdict(set)
    for r in rows:
        first.setdefault(r[:2], r)
        spans[r[0]].add(r[1])
    again = [r for r in rows if (r[2], r[4]) != (first[r[:2]][2], first[r[:2]][4])]
    on = [r for r in first.values() if len(spans[r[0]]) > 1]
    want = sorted([(False, *r[2:]) for r in again] + [(True, *r[2:]) for r in on])
    assert flat([whole]) == want


def near_rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for group in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([8, 60, 120]))]
        for _ in range(rng.choice([2, 5, 30])):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        rows.append(" ".join(own[:4] + passage + own[4:]))
    rows += ["one two three", "ONE  two\tthree", "one two", "one", None, "", " \n\t", "Ünïcode Éa b c d e", "ünïcode éa b c d e"] * 2
    rows += ["the " * 3000, "the " * 50]
    rng.shuffle(rows)
    return [(3 * i, t) for i, t in enumerate(rows)]


def brute_near(rows):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for doc, text in rows:
        w = word.findall((text or "").encode().translate(lower))
        sets[doc] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 4)  # read when the plan is built: groups are cut in parts
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], "no id", 2)], "doc_id bigint, text string, token string, n int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df.repartition(4)).collect()]
    assert {r[0]: r[1:] for r in got if r[0] is not None} == brute_near(rows)
    assert [r[2] for r in got if r[0] is None] == [None] and len(got) == len(rows) + 1


def test_near_duplicates_of_an_empty_table(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@pytest.mark.parametrize("step, known", [(1, 1 << 16), (3, 1 << 16), (100, 1 << 16), (2, 3)])
def test_groups_hold_every_shared_token(step, known, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "KNOWN_ROWS", known)
    rng = random.Random(step)
    rows = sorted({(rng.randint(0, 30), rng.randint(0, 9)) for _ in range(90)} | {(40, d) for d in range(20)})
    table = [(t, d, 10, 0) for t, d in rows]
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), jaccard._TOKENS)], schema=jaccard._TOKENS)
    parts = [whole.slice(i, step) for i in range(0, whole.num_rows, step)]
    groups = collections.defaultdict(set)
    for batch in jaccard._grouped(iter(parts), 75):
        for r in batch.to_pylist():
            groups[r["grp"]].add(r["doc"])
    by = collections.defaultdict(set)
    for t, d in rows:
        by[t].add(d)
    want = {frozenset(ds) for ds in by.values() if len(ds) > 1}
    got = {frozenset(ds) for ds in groups.values()}
    assert got == want if known > 100 else all(any(w <= g for g in got) for w in want)


@pytest.mark.parametrize("step, copies", [(4, 6), (5, 7), (9, 12), (100, 3)])
def test_groups_hold_a_token_whose_rows_repeat(step, copies, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "KNOWN_ROWS", 8)
    table = [(1, 3, 10, 0), (1, 4, 10, 0)] + [(7, d, 10, 0) for d in range(6) for _ in range(copies)] + [(9, 3, 10, 0), (9, 4, 10, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*table), jaccard._TOKENS)], schema=jaccard._TOKENS)
    parts = [whole.slice(i, step) for i in range(0, whole.num_rows, step)]
    groups = collections.defaultdict(set)
    for batch in jaccard._grouped(iter(parts), 75):
        for r in batch.to_pylist():
            groups[r["grp"]].add(r["doc"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4, 5], [3, 4]]


@pytest.mark.parametrize("n", [100, 12_300_000, 21_500_000, 2**31 - 1])
def test_long_texts_pass_the_length_and_place_filter(n):
    n1, n2, first, last = (np.array([x], np.int32) for x in (n, n - 1, 0, n - 2))
    assert jaccard._may_link(n1, first, n2, first, 75).all() and jaccard._may_link(n1, first, n1, first, 75).all()
    assert not jaccard._may_link(n1, last, n2, last, 75).any() and not jaccard._may_link(n1, first, n2 // 2, first, 75).any()


@pytest.mark.parametrize("seed", range(3))
def test_bucket_counts_never_drop_similar_sets(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.3, 1)], rng.integers(0, 2**63, int(rng.integers(0, n + 1)), dtype=np.uint64)]))
        if len(y):
            shared = len(np.intersect1d(x, y))
            similar = 100 * shared >= 75 * (len(x) + len(y) - shared)
            assert not similar or jaccard.may_be_similar(jaccard.bucket_counts(x), jaccard.bucket_counts(y), len(x), len(y), 75)


def test_word_hashes_follow_words():
    a, b = shingles.word_hashes(b"One two  THREE\x0b\x85"), shingles.word_hashes("one TWO three \x85".encode("latin-1"))
    assert len(a) == 4 and a[:3].tolist() == b[:3].tolist()
    assert len(set(shingles.word_hashes(b"ab ba a b aa bb").tolist())) == 6


def test_quality_learns_and_scores(spark, small_dir):
    got = {r.doc_id: r for r in Q.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    marks = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = [(got[d].score, y) for d, y in zip(marks.doc_id, marks.quality) if got[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    wins = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y == 1 and z == 0]
    assert np.mean(wins) > 0.97
    assert np.mean([got[d].predicted for d, y in zip(marks.doc_id, marks.quality) if y == 1]) > 0.98


def test_quality_of_odd_rows(spark):
    texts = ["good text number %d" % i for i in range(20)] + ["b@d &&& t###xt %%%%%% %d" .replace("%d", str(i)) for i in range(20)]
    rows = [(i, t, 0.5, "x") for i, t in enumerate(texts)] + [(100, None, 0.1, ""), (None, "no id", 0.1, ""), (5, "again", 0.2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double, y string")
    marks = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (4, 7, 0), (6, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(df, marks)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    good = [r.score for r in got if r.doc_id is not None and r.doc_id < 20 and r.text != "again"]
    bad = [r.score for r in got if r.doc_id is not None and 20 <= r.doc_id < 40]
    assert min(good) > max(bad)
    assert quality.score(df.limit(0), model).collect() == []
    none = quality.fit(df, marks.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    one = quality.fit(df, marks.filter("quality = 1"))
    assert len({r.score for r in quality.score(df, one).collect()}) == 1
    same = quality.fit(df.filter(F.col("doc_id") < 0), marks)
    assert len({r.score for r in quality.score(df, same).collect()}) == 1


def test_features_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "some words and some more words é日 " * 50
    whole = quality.Features().of(text).tolist()
    monkeypatch.setattr(quality, "PIECE", 13)
    assert quality.Features().of(text).tolist() == whole


def objective(w, bias, rows, scaled, signs, costs):
    margins = np.array([y * (w[x] @ v + bias) for x, v, y in zip(rows, scaled, signs)])
    return 0.5 * (w @ w + bias * bias) + float((costs * np.maximum(0, 1 - margins)).sum())


def dual_optimum(rows, scaled, signs, costs, size, steps=20_000):
    """The dual's least value by projected gradient steps on the whole matrix (bias: a last feature of ones)."""
    x = np.zeros((len(rows), size + 1))
    for i, (at, v) in enumerate(zip(rows, scaled)):
        x[i, at] = v
    x[:, -1] = 1.0
    q = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, rate = np.zeros(len(rows)), 1.0 / np.linalg.eigvalsh(q).max()
    for _ in range(steps):
        alpha = np.clip(alpha - rate * (q @ alpha - 1), 0, costs)
    return float(alpha.sum() - 0.5 * alpha @ q @ alpha)


@pytest.mark.parametrize("seed", range(3))
def test_dual_descent_reaches_the_optimum(monkeypatch, seed):
    """Primal value of the descent's weights against the dual's optimum: no gap after many epochs, a small one as used."""
    rng = np.random.default_rng(seed)
    size, n = 40, 60
    rows = [np.sort(rng.choice(size, rng.integers(1, 9), replace=False)) for _ in range(n)]
    scaled = [v / np.linalg.norm(v) for v in (rng.normal(size=len(x)) for x in rows)]
    signs = np.where(rng.random(n) < 0.4, 1.0, -1.0)
    costs = np.where(signs > 0, 1.3, 0.6)
    best = dual_optimum(rows, scaled, signs, costs, size)
    used = objective(*quality.descend(rows, scaled, signs, costs, size), rows, scaled, signs, costs)
    monkeypatch.setattr(quality, "EPOCHS", 400)
    many = objective(*quality.descend(rows, scaled, signs, costs, size), rows, scaled, signs, costs)
    assert best - 1e-6 <= many <= best * 1.0005 + 1e-6
    assert many - 1e-9 <= used <= best * 1.10


def test_class_ratios_equal_brute_force(monkeypatch):
    """Log-count ratios of the rows fitted, counted one by one; the weights are the descent's, scaled by them."""
    rng = np.random.default_rng(2)
    size = 1 << quality.BITS
    labels = rng.integers(0, 2, 50)
    rows = [np.unique(rng.integers(0, 300, 12) + 100 * y) for y in labels]
    seen = {}

    def kept(r, scaled, signs, costs, n):
        seen.update(rows=r, scaled=scaled, signs=signs, costs=costs)
        seen["found"] = descend(r, scaled, signs, costs, n)
        return seen["found"]

    descend = quality.descend
    monkeypatch.setattr(quality, "descend", kept)
    model = quality.train(rows, labels, int(labels.sum()), int((1 - labels).sum()))
    fitted = [i for i in range(50) if i % quality.KEPT]
    counts = {0: np.ones(size), 1: np.ones(size)}
    for i in fitted:
        for feature in rows[i].tolist():
            counts[int(labels[i])][feature] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    assert [r.tolist() for r in seen["rows"]] == [rows[i].tolist() for i in fitted]
    for i, v in zip(fitted, seen["scaled"]):
        want = ratio[rows[i]]
        assert np.allclose(v, want / np.sqrt((want * want).sum()))
    assert seen["signs"].tolist() == [1.0 if labels[i] else -1.0 for i in fitted]
    # Both classes weigh the same in all.
    assert np.isclose(seen["costs"][seen["signs"] > 0].sum(), seen["costs"][seen["signs"] < 0].sum())
    w, bias = seen["found"]
    assert np.allclose(model.weights, (w * ratio).astype(np.float32)) and np.allclose(model.squares, (ratio * ratio).astype(np.float32))
    assert model.bias == bias
    # A text's margin is that of its scaled indicators.
    x = rows[0]
    assert np.isclose(model.margin(x), w[x] @ (ratio[x] / np.linalg.norm(ratio[x])) + bias, atol=1e-5)
