"""Exact money and ratio arithmetic.

Money is carried as decimals: a line amount is ``quantity × price`` with the
price at 4 decimals, sums are exact, and rounding happens once at the end.
Ratios of counts are rounded half-to-even on the exact fraction with integer
arithmetic, so the result does not depend on the order of a floating sum or
on how a double happens to sit next to a tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_TYPE = T.DecimalType(18, 4)
SALES_TYPE = T.DecimalType(18, 2)
# Casts use type names: one call into the JVM each, where a type object costs
# a schema round trip (this matters for the many casts of the exact rounding).
_PRICE = "decimal(18,4)"
_INT38 = "decimal(38,0)"
_AMOUNT = "decimal(38,4)"


def line_amount(quantity: Column, price: Column) -> Column:
    """Exact ``quantity × price`` as decimal(38,4); null if either is null."""
    return quantity.cast(_INT38) * price.cast(_PRICE).cast(_AMOUNT)


def unscaled(amount: Column, scale: int = 4) -> Column:
    """An exact decimal times ``10**scale`` as an integer-valued decimal(38,0)."""
    return (amount.cast(_AMOUNT) * F.lit(10**scale)).cast(_INT38)


def ratio_half_even(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half-to-even to ``digits`` decimals, as a double.

    ``num`` and ``den`` hold whole numbers; ``den`` must be positive, else the
    result is null. The quotient and remainder are exact (decimal(38,0)).
    """
    scale = 10**digits
    n = F.abs(num.cast(_INT38)) * F.lit(scale).cast(_INT38)
    n = n.cast(_INT38)
    d = F.when(den > 0, den.cast(_INT38))
    r = (n % d).cast(_INT38)
    q = ((n - r) / d).cast(_INT38)
    twice = (r * F.lit(2)).cast(_INT38)
    bump = F.when(twice > d, F.lit(1)).when(twice < d, F.lit(0)).otherwise(q % F.lit(2))
    rounded = (q + bump).cast(_INT38)
    signed = F.when(num.cast(_INT38) < 0, -rounded).otherwise(rounded)
    return signed.cast("double") / F.lit(float(scale))


def pct_half_even(count: Column, total: Column, digits: int = 2) -> Column:
    """``round(count / total * 100, digits)`` for counts."""
    return ratio_half_even(count.cast(_INT38) * F.lit(100), total, digits)


def money_double(amount: Column, digits: int = 2) -> Column:
    """Round an exact decimal amount half-to-even and hand it out as a double."""
    return F.bround(amount, digits).cast("double")


def mean_money(total: Column, count: Column, digits: int = 2) -> Column:
    """Exact mean of a decimal sum over a count, rounded half-to-even."""
    return ratio_half_even(unscaled(total, 4), count.cast(_INT38) * F.lit(10**4), digits)
