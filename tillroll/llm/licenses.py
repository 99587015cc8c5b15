"""License scans by a positional index of rare words.

Native: every step is a DataFrame expression. The templates' words are few, so
their postings are literals; how rare a word is comes from document counts
over the whole corpus (one pass, one number for each template word). Of each
phrase the two rarest words are looked up in a file; a word at place p that
stands at place q of the phrase puts the phrase's start at p - q, and starts on
which both words agree are kept (postings intersected by relative position).
There the whole mandatory phrase must stand, word for word. A template is
longer than its mandatory phrase: the share of its words found in place
around it is the match's score.

Words: runs of ASCII letters and digits and of all non-ASCII characters, with
A-Z in lower case.

Defined results: a null text is the empty text (no words, empty labels, score
0, null places); rows are independent, so ties, repeated rows and empty tables
need no rule; other columns pass through, and columns named like the outputs
are replaced.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label, the mandatory phrase, and a text around it (which holds the phrase)."""

    label: str
    phrase: str
    text: str = ""
    base: bool = False


# Base phrases, then sentences by which licenses are stated.
TEMPLATES = [
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", "mit license", "released under the mit license"),
    Template("apache", "apache license version 2 0", "licensed under the apache license version 2 0"),
    Template("gpl", "gnu general public license", "licensed under the gnu general public license version 3"),
    Template("mit", "permission is hereby granted free of charge",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license",
             "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "lesser general public license", "under the terms of the gnu lesser general public license"),
    Template("agpl", "affero general public license", "under the terms of the gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    Template("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    Template("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BREAKS), "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_counts(df: DataFrame, text: str, templates: list[Template]) -> dict[str, int]:
    """In how many rows each template word stands (at most one number for each word of the templates)."""
    known = sorted({w for t in templates for w in t.phrase.split()})
    found = df.select(F.explode(F.array_intersect(words(F.col(text)), _literals(known))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def scan(df: DataFrame, text: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    counts = document_counts(df, text, templates)
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = ["_lic_words", "_lic_hits", "_lic_at", "_lic_base"]
    df = df.select(*[c for c in df.columns if c not in own and (c not in added or c == text)])

    phrases = list(dict.fromkeys(t.phrase for t in templates))
    probes = {}
    for phrase in phrases:
        places: dict[str, int] = {}
        for at, word in enumerate(phrase.split()):
            places.setdefault(word, at)
        # The rarest word has the highest inverse document frequency; equal ones go by name.
        ranked = sorted(places, key=lambda w: (counts.get(w, 0), w))
        # A word that stands twice in the phrase gives starts for its first place only, which the true start is among.
        probes[phrase] = [(w, places[w]) for w in ranked[:2]]

    rarest = sorted({p[0][0] for p in probes.values()})
    looked = sorted({w for p in probes.values() for w, _ in p})
    df = df.withColumn("_lic_words", words(F.col(text)))
    body = F.col("_lic_words")
    marked = F.filter(F.transform(body, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(looked))
    none = F.array().cast("array<struct<w:string,i:int>>")
    df = df.withColumn("_lic_hits", F.when(F.arrays_overlap(body, _literals(rarest)), marked).otherwise(none))
    hits, nowhere = F.col("_lic_hits"), F.array().cast("array<int>")

    def starts_by(word: str, place: int) -> Column:
        return F.transform(F.filter(hits, lambda x: x["w"] == word), lambda x: x["i"] - place)

    def starts(phrase: str) -> Column:
        exact = phrase.split()
        by_word = [starts_by(word, place) for word, place in probes[phrase]]
        agreed = reduce(F.array_intersect, by_word)
        whole = F.filter(agreed, lambda s: F.when(s >= 0, F.slice(body, s + 1, F.lit(len(exact))) == _literals(exact)).otherwise(False))
        return F.when(F.size(hits) > 0, whole).otherwise(nowhere)

    df = df.withColumn("_lic_at", F.struct(*[starts(p).alias(f"p{i}") for i, p in enumerate(phrases)]))

    def at(t: Template) -> Column:
        return F.col("_lic_at")[f"p{phrases.index(t.phrase)}"]

    def share(t: Template) -> Column:
        """Share of the template's words in place around the best start of its phrase."""
        full = (t.text or t.phrase).split()
        lead = next(i for i in range(len(full)) if full[i : i + len(t.phrase.split())] == t.phrase.split())

        def around(s: Column) -> Column:
            same = [F.when(F.get(body, s - lead + i) == w, 1).otherwise(0) for i, w in enumerate(full)]
            return reduce(lambda a, b: a + b, same)

        return F.coalesce(F.array_max(F.transform(at(t), around)), F.lit(0)) / len(full)

    base = [t for t in templates if t.base]
    df = df.withColumn("_lic_base", F.concat(*[at(t) for t in base]) if base else nowhere)
    places = F.col("_lic_base")

    def label_list(chosen: list[Template]) -> Column:
        named = F.array(*[F.when(F.size(at(t)) > 0, F.lit(t.label)) for t in chosen]) if chosen else F.array().cast("array<string>")
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(named))), ",")

    longer = [t for t in templates if not t.base] or base
    score = F.greatest(F.lit(0.0), F.lit(0.0), *[share(t) for t in longer], *[F.when(F.size(at(t)) > 0, 0.5).otherwise(0.0) for t in base])
    return df.withColumns({
        "n_words": F.size(body).cast("bigint"),
        "n_base": F.size(places).cast("bigint"),
        "first_word": F.array_min(places).cast("bigint"),
        "last_word": F.array_max(places).cast("bigint"),
        "base_labels": label_list(base),
        "labels": label_list(templates),
        "score": F.when(F.size(hits) > 0, score).otherwise(0.0),
    }).drop(*own)
