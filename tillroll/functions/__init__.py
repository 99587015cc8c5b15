"""Column helpers shared by the operators (null rules, exact rounding, formats)."""

from tillroll.functions.nulls import not_true, is_missing, normalize_null_tokens, PANDAS_NULL_TOKENS
from tillroll.functions.numeric import (
    PRICE_TYPE,
    SALES_TYPE,
    line_amount,
    ratio_half_even,
    pct_half_even,
    unscaled,
    money_double,
    mean_money,
)
from tillroll.functions.text import fmt_grouped, fmt_fixed, fmt_percent, fmt_signed, cut_label, month_label

__all__ = [
    "not_true",
    "is_missing",
    "normalize_null_tokens",
    "PANDAS_NULL_TOKENS",
    "PRICE_TYPE",
    "SALES_TYPE",
    "line_amount",
    "ratio_half_even",
    "pct_half_even",
    "unscaled",
    "money_double",
    "mean_money",
    "fmt_grouped",
    "fmt_fixed",
    "fmt_percent",
    "fmt_signed",
    "cut_label",
    "month_label",
]
