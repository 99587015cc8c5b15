"""Python-style number formats and label cuts as Spark columns.

``format_number`` rounds half-to-even on the exact binary value, as Python's
``format`` does; ``format_string('%.1f')`` rounds half-up and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fmt_grouped(col: Column, decimals: int = 0) -> Column:
    """Python ``f"{v:,.{decimals}f}"``."""
    return F.format_number(col.cast("double"), decimals)


def fmt_fixed(col: Column, decimals: int) -> Column:
    """Python ``f"{v:.{decimals}f}"`` (no thousands separator)."""
    return F.regexp_replace(F.format_number(col.cast("double"), decimals), ",", "")


def fmt_percent(col: Column, decimals: int = 1) -> Column:
    """Python ``f"{v:.{decimals}%}"``."""
    return F.concat(fmt_fixed(col.cast("double") * F.lit(100.0), decimals), F.lit("%"))


def fmt_signed(col: Column, decimals: int = 1) -> Column:
    """Python ``f"{v:+.{decimals}f}"``."""
    body = fmt_fixed(col, decimals)
    return F.when(F.startswith(body, F.lit("-")), body).otherwise(F.concat(F.lit("+"), body))


def cut_label(col: Column, width: int = 22, mark: str = "…") -> Column:
    """First ``width`` characters, with ``mark`` appended when text was cut."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit(mark))).otherwise(col)


def month_label(month_key: Column) -> Column:
    """``'2010-03'`` → ``'Mar 2010'``; null when the key is not a month."""
    parsed = F.try_to_timestamp(month_key, F.lit("yyyy-MM"))
    return F.date_format(parsed, "MMM yyyy")
