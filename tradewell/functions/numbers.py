"""Money arithmetic in exact decimals.

Amounts are summed as decimals of six places and rounded once, half-up, at the end. Such sums
do not depend on the order of the rows, and half-up division of whole numbers gives one answer
on every engine, so a total is the same after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """Whole cents of one amount, rounded half-up; NaN becomes NULL."""
    return (F.round(exact(amount), 2) * 100).cast("bigint")


def exact(amount: Column) -> Column:
    """The amount as a decimal; NaN becomes NULL."""
    return amount.try_cast("decimal(20,6)")


def cents_sum(amount: Column) -> Column:
    """Whole cents of the exact sum."""
    return whole_cents(F.sum(exact(amount)))


def whole_cents(total: Column) -> Column:
    return (F.round(total, 2) * 100).cast("bigint")


def cents_avg(total: Column, n: Column) -> Column:
    """Whole cents of the mean, from an exact sum and a count."""
    millionths = (total * 1_000_000).cast("decimal(38,0)")
    return half_up_div(millionths, n.cast("decimal(20,0)") * 10_000)


def from_cents(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def half_up_div(total: Column, n: Column) -> Column:
    """``total / n`` rounded half away from zero, whole numbers in and out."""
    half_up = F.call_function("div", F.abs(total) * 2 + n, n * 2)
    return F.when(n > 0, F.when(total < 0, -half_up).otherwise(half_up))


def money_sum(amount: Column) -> Column:
    return from_cents(cents_sum(amount))


def money_avg(amount: Column) -> Column:
    """Mean of the non-null amounts, rounded half-up to cents."""
    a = exact(amount)
    return from_cents(cents_avg(F.sum(a), F.count(a)))


def round_money(c: Column) -> Column:
    """Round a raw double half-up to two decimals."""
    return F.round(c.cast("double"), 2)


def plain_number_text(c: Column) -> Column:
    """Shortest decimal text without an exponent: ``1234.5``, ``1000000``, ``0.1``."""
    short = F.regexp_replace(c.cast("string"), r"\.0$", "")
    wide = F.regexp_replace(c.try_cast("decimal(38,6)").cast("string"), r"\.?0+$", "")
    magnitude = F.abs(c)
    return F.when(
        (magnitude < F.lit(1e7)) & ((magnitude >= F.lit(1e-3)) | (magnitude == 0)), short
    ).otherwise(wide)


def float_text(c: Column) -> Column:
    """As :func:`plain_number_text`, with at least one decimal: ``12.5``, ``0.0``."""
    text = plain_number_text(c)
    return F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))


def fixed_text(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded from the exact binary value."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))
