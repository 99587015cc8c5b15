"""Source mixing, token alignment and collocations against brute force."""

import bisect
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillroll.llm import alignment, collocations, mixing
from tillroll.llm import queries as Q
from tillroll.llm.bpe import byte_alphabet
from tillroll.llm.common import Scratch

BYTE, PIECE = public_tokenizers.path(Q.BYTE_BPE), public_tokenizers.path(Q.PIECE_BPE)
CLASH = "chunk bigint, slot int, pair bigint, size string, copies int, block string, skey string, gid int, n string"


def clashing(df):
    """``df`` with columns named like the operators' own."""
    for i, part in enumerate(CLASH.split(", ")):
        name, kind = part.split(" ")
        df = df.withColumn(name, F.lit(str(i)).cast(kind))
    return df


# Mixing.


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Sources' targets by sharing the excess again until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    rest, target, free = share * sum(sizes.values()), {}, list(names)
    while free:
        total = sum(weight[k] for k in free)
        above = [k for k in free if rest * weight[k] / total >= most * sizes[k] - 1e-9]
        if not above:
            return target | {k: rest * weight[k] / total for k in free}
        for k in above:
            target[k] = most * sizes[k]
            free.remove(k)
        rest = share * sum(sizes.values()) - sum(target.values())
    return target


def brute_tilt(sizes, target):
    """The tilt that meets a target, by bisection."""
    sizes = np.array(sizes, float)
    low, high = -200.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        words = (sizes * 2 / (1 + np.exp(-mid * np.log1p(sizes)))).sum()
        low, high = (mid, high) if words < target else (low, mid)
    return (low + high) / 2


def odd_documents(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = ["a", "B", "é", None, "z", ""][int(min(5, rng.integers(0, 9) // 1.5))] if i % 3 else "hot"
        size = int(rng.integers(0, 60)) if i % 97 else 3000
        rows.append((int(i), " ".join(["w\x0bx"] * (size // 2)) + (" y" if size % 2 else ""), source))
    rows += [(None, None, "a"), (None, "a b", None), (7, "again again", "hot"), (7, "again again", "hot"), (-1, "", "empty")]
    return rows


def test_mix_meets_targets_and_equals_brute_force(spark):
    df = clashing(spark.createDataFrame(odd_documents(), "doc_id bigint, text string, source string").repartition(7))
    got = mixing.mix(df).toPandas()
    rows = pd.DataFrame(odd_documents(), columns=["doc_id", "text", "source"])
    rows["size"] = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows.text]
    assert len(got) == len(rows)
    sizes = {None if k != k or k is None else k: int(v) for k, v in rows.groupby("source", dropna=False)["size"].sum().items()}
    targets = brute_targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        key = None if source != source or source is None else source
        assert set(part.source_size) == {sizes[key]}
        assert part.target.iloc[0] == pytest.approx(targets[key], rel=1e-12)
        # Within half a word, or what the smallest document left cannot settle.
        assert abs(part.taken.sum() - targets[key]) <= max(1, part["size"][part["size"] > 0].min() if sizes[key] else 1)
        assert (part.taken <= 2 * part["size"]).all() and (part.copies >= 0).all()
        if 0 < targets[key] < 2 * sizes[key]:
            tilt = brute_tilt(part["size"], targets[key])
            assert np.allclose(part.rate, 2 / (1 + np.exp(-tilt * np.log1p(part["size"]))), atol=1e-6)
            # Copies follow the rates: less than one copy off for each size, and one document's words besides.
            off = (part.copies - part.rate).groupby(part["size"]).sum().abs()
            assert (off * off.index).sum() <= off.index.to_numpy().sum() + off.index.max()


def test_mix_reruns_agree_on_other_partitions(spark):
    df = spark.createDataFrame(odd_documents(), "doc_id bigint, text string, source string")
    ways = [mixing.mix(df.repartition(n)).select("doc_id", "source", "size", "target", "taken") for n in (1, 9)]
    first, second = (sorted((tuple(r) for r in way.collect()), key=repr) for way in ways)
    assert first == second


def test_mix_of_nothing_and_of_one_source(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c", None), (2, "d", None), (3, None, None)], empty.schema)
    got = {r.doc_id: r for r in mixing.mix(one).collect()}
    assert [got[i].size for i in (1, 2, 3)] == [3, 1, 0] and got[1].target == 6.0
    assert sum(r.taken for r in got.values()) == 6
    assert mixing.mix(spark.createDataFrame([(1, "", "a")], empty.schema)).collect()[0].target == 0.0


def test_targets_with_other_weights(spark):
    classes = spark.createDataFrame([("sa", 10, 3), ("sb", 1, 100), ("sc", 5, 1), ("n", 7, 2)], "skey string, size bigint, n bigint")
    got = {r.skey: r.target for r in mixing.source_targets(classes, (3, 1), (2, 1), 3).collect()}
    want = brute_targets({"a": 30, "b": 100, "c": 5, None: 14}, (3, 1), 2.0, 3)
    assert {("n" if k is None else "s" + k): pytest.approx(v) for k, v in want.items()} == got


def test_repeat_gives_the_mixture(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing.mix(df).cache()
    out = mixing.repeat(df, mixed)
    assert out.columns == df.columns
    assert out.select(F.sum(mixing.word_count("text"))).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_mix_has_no_python(spark, small_dir):
    plan = Q.op11_source_mixing(spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan and "Arrow" not in plan


# Alignment.

ODD_TEXTS = [
    None, "", " ", "▁x y", "😀👨‍👩 a\x00b  \t\n  c", "a" * 5000 + " " * 3000 + "क्" * 500,
    "hello <|endoftext|> <s> é", "hello world", "hello world", "<0x41> <unk>", "ｆｕｌｌ ①", "x " * 4000, "\n\n  \n" * 40,
]


def brute_align(rows):
    library, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    found, docs = [], defaultdict(set)
    for at, (doc, text) in enumerate(rows):
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in library.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append((doc, 0, 0, 0, [], ""))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        both = sorted(set(a_end) & set(b_end))
        groups = [([], []) for _ in both]
        for i, end in zip(a, a_end):
            groups[bisect.bisect_left(both, end)][0].append(i)
        for i, end in zip(b, b_end):
            groups[bisect.bisect_left(both, end)][1].append(i)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        for pair in set(links):
            docs[pair].add(at)
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc, len(a), len(b), len(both), links, listed))
    count = {pair: len(s) for pair, s in docs.items()}
    best = Counter()
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    return [
        (d, a, b, g, len(ls), hashlib.sha256(s.encode()).hexdigest() if s else "", sum(count[x] == best[x[0]] for x in ls), sum(count[x] for x in ls))
        for d, a, b, g, ls, s in found
    ], count


@pytest.mark.parametrize("tight", [False, True])
def test_alignment_equals_brute_force(spark, small_dir, tight, monkeypatch):
    if tight:  # small chunks, wide groups by distinct ids, in this process
        monkeypatch.setattr(alignment, "CHUNK_ENTRIES", 50)
        monkeypatch.setattr(alignment, "WIDE", 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").limit(60).collect()]
    rows += list(enumerate(ODD_TEXTS, 10**6)) + [(None, "null id"), (10**6, "hello world")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    want, count = brute_align(rows)
    if tight:
        tokens = alignment.load(BYTE, PIECE)
        found = alignment.Aligned(tokens, [t for _, t in rows])
        wide, wide_links = found.entries(5)
        monkeypatch.setattr(alignment, "WIDE", 10**9)
        plain, plain_links = found.entries(5)
        assert wide.tolist() == plain.tolist() and wide_links.tolist() == plain_links.tolist()
        return
    docs, pairs = alignment.align(df, BYTE, PIECE, with_groups=True)
    columns = ["doc_id", *alignment._COUNTS, "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r) for r in docs.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    assert {(r.a_id, r.b_id): r.docs for r in pairs.collect()} == count
    listed = docs.filter("n_groups > 0").select("groups", "groups_sha256").collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in listed)


def test_postings_round_trip():
    """Bitmaps, plain and listed, and their planes give every (pair, document, links) back."""
    rng = np.random.default_rng(5)
    entries = {}
    for pair in range(40):
        share = rng.choice([0.01, 0.2, 0.9])
        for slot in np.flatnonzero(rng.random(700) < share).tolist():
            entries[pair << 16 | slot] = int(rng.choice([1, 1, 1, 2, 3, 9]))
    keys = np.array(sorted(entries))
    rows = alignment.postings(keys, np.array([entries[k] for k in keys.tolist()]), 700)
    assert 0 < sum(rows["dense"].to_pylist()) < len(rows["pair"])
    got = {}
    for pair, dense, docs, planes, n, links in zip(*(rows[c].to_pylist() for c in ("pair", "dense", "docs", "planes", "pair_docs", "pair_links"))):
        read = alignment._numbers if dense else (lambda b: np.frombuffer(b, "<u2"))
        for slot in read(docs).tolist():
            got[pair << 16 | slot] = 1
        assert len(read(docs)) == n
        for k, plane in enumerate(planes):
            for slot in read(plane).tolist():
                got[pair << 16 | slot] += 1 << k
        assert sum(v for key, v in got.items() if key >> 16 == pair) == links
    assert got == entries


def test_alignment_of_nothing(spark):
    docs, pairs = alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), BYTE, PIECE)
    assert docs.count() == 0 and pairs.count() == 0
    docs, _ = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), BYTE, PIECE)
    assert sorted((r.doc_id, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in docs.collect()) == [(1, 0, 0, 0, ""), (2, 0, 0, 0, "")]


def test_ranks_equal_the_library_on_all_letters():
    library, tokens = Tokenizer.from_file(BYTE), alignment.load(BYTE, PIECE)
    library.encode_special_tokens = True
    for start in range(0, 0x3000, 8):
        text = "".join(f" a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}  's{chr(c)}" for c in range(start, start + 8))
        assert tokens.encode_a(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in ("ab" * 200_000, " " * 300_000 + "x", "\t " * 100_000):
        assert tokens.encode_a(text).tolist() == library.encode(text, add_special_tokens=False).ids


# Collocations.


def brute_collocations(rows, longest, least, inside, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    dropped = {
        (q[0], *q[1 + i : 1 + i + k])
        for q, a in candidates.items()
        for k in range(2, len(q) - 1)
        for i in range(len(q) - k)
        if 100 * a >= inside * f[(q[0], *q[1 + i : 1 + i + k])]
    }
    by_lang = defaultdict(list)
    for p, a in candidates.items():
        if p not in dropped:
            cuts = [(10**6 * a * a // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            by_lang[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: 1 + k]], f[(p[0], *p[1 + k :])]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in by_lang.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


ODD_ROWS = [
    (None, "A b A b A b a b, a b c a b c." * 9), ("und", "x\ty z" * 12), ("en", None), (None, ""), ("", "é É é\x85É " * 11), ("q", "..!\n"),
    ("zz", "a b c " * 12), ("zz", "\x1ca\x1c b" * 12), ("en", "word " * 700), ("en", "one"), ("en", "one"),
]


@pytest.mark.parametrize("longest,least,inside,top,block", [(3, 10, 50, 2000, 1 << 20), (3, 2, 70, 5, 40), (5, 10, 50, 2000, 900), (2, 3, 50, None, 200)])
def test_collocations_equal_brute_force(spark, small_dir, longest, least, inside, top, block):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()] + ODD_ROWS
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    got = collocations.collocations(df, longest=longest, least=least, inside=inside, top=top, block_words=block)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, longest, least, inside, top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    a, l, r = 9 * 10**13, 4 * 10**14, 8 * 10**14
    df = spark.createDataFrame([(a, [l, r, l], [r, l, l])], "a bigint, s array<bigint>, e array<bigint>")
    got = df.select(collocations._cuts(F.col("a"), F.col("s"), F.col("e")).alias("c")).first().c
    assert (got.score, got.k, got.l, got.r) == (10**6 * a * a // (l * r), 0, l, r)


def test_occurrences_are_persisted_sorted(spark):
    """Blocks hold the relation by piece and position, and every occurrence once."""
    rows = [("en", "a b. c a"), ("fr", "a b"), ("en", "b")]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    blocks = Scratch(spark, "t").keep(
        df.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(collocations._gather(100), collocations._WORDS_DDL)
    )
    rows = blocks.collect()
    words = {(r.block, r.local): bytes(r.w).decode() for r in rows if r.local is not None}
    places = Counter()
    for r in rows:
        if r.places is not None:
            piece, pos, item = (c.tolist() for c in collocations.unpack(bytes(r.places)))
            at = list(zip(piece, pos))
            assert at == sorted(set(at)) and len(at) == r.size
            places.update((r.lang, words[r.block, i], p) for i, p in zip(item, pos))
    assert places == Counter({("en", "a", 0): 1, ("en", "b", 1): 1, ("en", "c", 0): 1, ("en", "a", 1): 1, ("fr", "a", 0): 1, ("fr", "b", 1): 1, ("en", "b", 0): 1})


@pytest.mark.parametrize("seed", range(6))
def test_groups_are_counted_across_batches(seed):
    """Sorted rows cut anywhere: totals, members and numbers as a plain grouping gives them."""
    rng = np.random.default_rng(seed)
    rows = sorted((str(rng.integers(0, 4)), int(rng.integers(0, 5)), here, int(rng.integers(1, 4))) for here in range(300))
    schema = pa.schema([("a", pa.string()), ("b", pa.int64()), ("here", pa.int64()), ("gid", pa.int64()), ("f", pa.int64())])
    groups, out, at = collocations._Groups(schema, 2, 25), [], 0
    while at < len(rows):
        size = int(rng.integers(0, 3 if seed % 2 else 60))
        part, at = rows[at : at + size], at + size
        cols = list(zip(*part)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["a", "b", "here", "n"])
        out += [r for b in groups.add(batch) for r in b.to_pylist()]
    out += [r for b in groups.end() for r in b.to_pylist()]
    total, first = Counter(), {}
    for a, b, here, n in rows:
        total[a, b] += n
        first.setdefault((a, b), here)
    kept = {k for k, n in total.items() if n >= 25}
    assert 0 < len(kept) < len(total)
    assert sorted((r["a"], r["b"], r["gid"], r["f"]) for r in out if r["f"] is not None) == sorted((*k, first[k], total[k]) for k in kept)
    assert sorted((r["here"], r["gid"]) for r in out if r["f"] is None) == sorted((h, first[a, b]) for a, b, h, _ in rows if (a, b) in kept)
