"""Text and date cleaning, and sentence templates."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewell.functions.numbers import fixed_text

_PLACEHOLDER = re.compile(r"\{(\w+)\}")
_WHITESPACE = " \t\n\r\f\x0b"


def title_text(c: Column) -> Column:
    return F.initcap(F.trim(c))


def code_text(c: Column) -> Column:
    return F.upper(F.trim(c))


def lower_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def strip_text(c: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(c, F.lit(_WHITESPACE))


def parse_date(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Date of a text; a text that is no date gives NULL, also in ANSI mode."""
    return F.try_to_date(c, pattern)


def ts_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def score_text(c: Column) -> Column:
    """Four decimals, as hits are listed."""
    return fixed_text(c, 4)


def with_date_parts(df: DataFrame, date_col: str, prefix: str = "order") -> DataFrame:
    day = F.col(date_col)
    return df.withColumns(
        {
            f"{prefix}_year": F.year(day),
            f"{prefix}_month": F.month(day),
            f"{prefix}_year_month": F.date_format(day, "yyyy-MM"),
        }
    )


def fill_template(
    template: str, values: Mapping[str, Column] | None = None, null_text: str = "None"
) -> Column:
    """A text column from ``"... {name} ..."``; names not in ``values`` are columns."""
    values = values or {}
    parts: list[Column] = []
    at = 0
    for hole in _PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[at : hole.start()]))
        value = values.get(hole[1], F.col(hole[1]))
        parts.append(F.coalesce(value.cast("string"), F.lit(null_text)))
        at = hole.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)
