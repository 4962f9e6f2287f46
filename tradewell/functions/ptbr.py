"""Brazilian number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewell.functions.numbers import plain_number_text

_LEADING_NUMBER = r"^[\s\u00a0]*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def format_brl(amount: Column) -> Column:
    """``R$ 1.234,56``; a missing amount reads ``R$ 0,00``."""
    grouped = F.format_number(F.coalesce(amount.cast("double"), F.lit(0.0)), 2)
    return F.concat(F.lit("R$ "), F.translate(grouped, ",.", ".,"))


def parse_brl(text: Column) -> Column:
    """Number in a Brazilian text: dots are grouping, the first comma is the decimal
    mark, ``R$`` is dropped, and the leading number counts; no number gives 0."""
    no_dots = F.replace(text, F.lit("."), F.lit(""))
    dotted = F.regexp_replace(no_dots, r"^([^,]*),", "$1.")
    bare = F.regexp_replace(dotted, r"R\$[\s\u00a0]?", "")
    return F.coalesce(F.regexp_extract(bare, _LEADING_NUMBER, 1).try_cast("double"), F.lit(0.0))


def decimal_comma(number: Column) -> Column:
    """Plain number text with a decimal comma."""
    return F.regexp_replace(plain_number_text(number), r"\.", ",")


def slug(title: Column, fallback: str) -> Column:
    """File name of a title: whitespace runs become ``_``, lower case."""
    named = F.lower(F.regexp_replace(title, r"\s+", "_"))
    return F.when(F.length(title) > 0, named).otherwise(F.lit(fallback))
