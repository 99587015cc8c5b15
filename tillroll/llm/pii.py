"""Personal data: proposed by regular expressions, confirmed by validators, scored by context.

Native: every step is a DataFrame expression. A kind's pattern cuts the text
into what lies between the matches (``split``) and the matches themselves
(``regexp_extract_all``); running sums of their lengths are the places, in
code points. Validators: Luhn for cards, length and mod 97 for IBANs, ranges for
IP parts, digit counts for phones. Words near a span raise its score; spans that
reach ``THRESHOLD`` are reported, and the base kinds always do.

The patterns are written so that the regex engine runs in linear time and
without recursion on any text (possessive loops; a match starts where a run
starts or the match before it ended), with the same matches as the plain ones.
The IBAN pattern matches only a head (country and check digits) and looks ahead
at the run of capitals and digits that follows, at most 34 and one more: what
follows an IBAN may look like a part of it. Every end of a word in the run is
tried: at the country's length in ``IBAN_LENGTHS``, or for a country that is not
listed the longest of 15 to 34 that passes mod 97. IBANs may so overlap.

Defined results: a null text is the empty text (no spans); rows are
independent, so ties, repeated rows and empty tables need no rule; other
columns pass through, and columns named like the outputs are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, their patterns, first scores and context words.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Kinds whose pattern matches a head of so many characters; its first group is the run to cut the span from.
HEADS = {"iban": 4}
# Characters of an IBAN by country, as in the ISO 13616 registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
BASE = ("email", "ip", "card", "phone")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|credit|visa|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account",
    "ssn": "ssn|social security",
}
NEARBY, BONUS, THRESHOLD = 40, 0.3, 0.5
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
_BLOCK = 64
_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def luhn(number: Column) -> Column:
    """True where a text of digits passes the Luhn check."""
    n = F.length(number)
    digits = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(number, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an IBAN's rearranged number leaves 1."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _iban(run: Column) -> Column:
    """The IBAN that a run starts with: its longest part up to the end of a word that is valid, or null."""
    lengths = F.create_map(*[F.lit(x) for item in IBAN_LENGTHS.items() for x in item])
    words = F.split(run, r"\x20")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))

    def valid(part: Column) -> Column:
        n = F.length(F.regexp_replace(part, r"\x20", ""))
        listed = F.coalesce(F.try_element_at(lengths, F.substr(part, F.lit(1), F.lit(2))), n)
        # A small letter, or a 35th character, stands behind a run that ends inside a word.
        return n.between(15, 34) & (n == listed) & ~part.rlike("[a-z]") & mod97(part)

    return F.get(F.filter(parts, valid), F.lit(0))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(IP_PARTS)
    if kind == "card":
        return F.length(_digits(found)).between(14, 19) & luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        return found.isNotNull()
    return F.lit(True)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), _plus)


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: array of (start, rank, end, kind, score), by start, then kind as listed."""
    kinds = list(PATTERNS)
    own = [f"_pii_{k}_{x}" for k in kinds for x in ("found", "step", "block", "base")]
    df = df.select(*[c for c in df.columns if c != out and c not in own])
    body = F.coalesce(F.col(text), F.lit(""))

    def col(kind: str, part: str) -> Column:
        return F.col(f"_pii_{kind}_{part}")

    df = df.withColumns({f"_pii_{k}_found": F.regexp_extract_all(body, F.lit(p), F.lit(int(k in HEADS))) for k, p in PATTERNS.items()})
    steps = {}
    for k, p in PATTERNS.items():
        n = F.size(col(k, "found"))
        gaps = F.transform(F.split(body, p, -1), F.length)
        widths = F.array_repeat(F.lit(HEADS[k]), n) if k in HEADS else F.transform(col(k, "found"), F.length)
        before = F.concat(F.array(F.lit(0)), F.slice(widths, F.lit(1), F.greatest(n - 1, F.lit(0))))
        steps[f"_pii_{k}_step"] = F.when(n > 0, F.zip_with(F.slice(gaps, F.lit(1), n), before, _plus)).otherwise(F.array().cast("array<int>"))
    df = df.withColumns(steps)
    # Running sums in blocks of 64: block totals, totals before a block, then places inside it.

    def block_sums(k: str) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(col(k, "step")) / _BLOCK).cast("int"))
        return F.transform(numbers, lambda b: _sum(F.slice(col(k, "step"), b * _BLOCK + 1, F.lit(_BLOCK))))

    def sums_before(k: str) -> Column:
        return F.transform(col(k, "block"), lambda x, b: _sum(F.slice(col(k, "block"), F.lit(1), b)))

    df = df.withColumns({f"_pii_{k}_block": block_sums(k) for k in kinds})
    df = df.withColumns({f"_pii_{k}_base": sums_before(k) for k in kinds})

    def starts(k: str) -> Column:
        def inside(base: Column, b: Column) -> Column:
            steps = F.slice(col(k, "step"), b * _BLOCK + 1, F.lit(_BLOCK))
            return F.transform(steps, lambda x, i: base + _sum(F.slice(steps, F.lit(1), i + 1)))

        return F.flatten(F.transform(col(k, "base"), inside))

    def spans(k: str) -> Column:
        def scored(x: Column) -> Column:
            end = x["start"] + F.length(x["found"])
            around = F.concat_ws(
                " ",
                F.substr(body, F.greatest(x["start"] - NEARBY + 1, F.lit(1)), F.least(x["start"], F.lit(NEARBY))),
                F.substr(body, end + 1, F.lit(NEARBY)),
            )
            near = F.lower(around).rlike(rf"\b(?:{CONTEXT[k]})\b")
            score = F.least(F.lit(SCORES[k]) + F.when(near, BONUS).otherwise(0.0), F.lit(1.0))
            return F.struct(
                x["start"].alias("start"), F.lit(kinds.index(k)).alias("rank"), end.alias("end"), F.lit(k).alias("kind"),
                score.alias("score"),
            )

        cut = _iban if k == "iban" else (lambda m: m)
        placed = F.zip_with(starts(k), col(k, "found"), lambda s, m: F.struct(s.alias("start"), cut(m).alias("found")))
        valid = F.filter(placed, lambda x: _valid(k, x["found"]))
        none = F.array().cast(f"array<{_SPAN}>")
        return F.when(F.size(col(k, "found")) > 0, F.transform(valid, scored).cast(f"array<{_SPAN}>")).otherwise(none)

    each = [spans(k) for k in kinds]
    found = F.array_sort(F.filter(reduce(F.concat, each), lambda x: x["score"] >= THRESHOLD))
    return df.withColumn(out, found).drop(*own)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets (overlapping spans by the first one's)."""
    body = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        shown = F.concat(acc["out"], F.substr(body, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], shown).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1)))
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))
