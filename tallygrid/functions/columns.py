"""Functions users of embedded SQL engines expect, as Spark column expressions.

Where Spark has the same function under the same name and meaning, use
`pyspark.sql.functions`; these are the ones that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallygrid.types import quoted

# Strftime codes and the date_format pattern letters that mean the same
STRFTIME_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%p": "a", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%f": "SSSSSS", "%%": "%",
}


def total(value: Column) -> Column:
    """Sum as a double, 0.0 over nothing."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def group_concat(value: Column, separator: str = ",", distinct: bool = False) -> Column:
    """Texts joined in ascending order, NULL left out.

    The result is one cell; `distinct` bounds it by the number of different
    values.
    """
    text = value.cast("string")
    gathered = F.collect_set(text) if distinct else F.collect_list(text)
    return F.when(F.size(gathered) > 0, F.concat_ws(separator, F.sort_array(gathered)))


def quantile(column: str, p: float) -> Column:
    """The smallest value with at least a share `p` of the rows up to it.

    Holds the distinct values of a group; for groups of any size see
    `plans.counted_quantiles.grouped_quantiles`.
    """
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {quoted(column)})")


def quantile_cont(value: Column, p: float) -> Column:
    """The interpolated quantile; the remark at `quantile` holds here too."""
    return F.percentile(value.cast("double"), F.lit(p))


percentile = quantile_cont


def first_by(value: Column, order: Column) -> Column:
    """The value of the first row in the given order."""
    return F.min_by(value, order)


def last_by(value: Column, order: Column) -> Column:
    return F.max_by(value, order)


def list_all(value: Column) -> Column:
    """All values in ascending order, NULL kept (and last)."""
    entry = F.struct(value.isNull().alias("missing"), value.alias("value"))
    return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"])


def log(value: Column) -> Column:
    """Logarithm to base 10."""
    return F.log10(value)


def concat(*values: Column) -> Column:
    """Texts joined, NULL left out."""
    return F.concat_ws("", *[v.cast("string") for v in values])


def upper(text: Column) -> Column:
    """Upper case letter by letter: `ß` becomes `ẞ` and not two letters."""
    return F.upper(F.replace(text, F.lit("ß"), F.lit("ẞ")))


def divide(a: Column, b: Column) -> Column:
    """Division as doubles, NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def iif(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def time_of(timestamp: Column) -> Column:
    """The time of day as text."""
    return F.date_format(timestamp, "HH:mm:ss")


def datetime_of(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def date_pattern(format_text: str) -> str:
    """A strftime format as a date_format pattern; other letters become literals."""
    out, literal = [], ""
    for part in re.findall(r"%.|[^%]|%", format_text, re.DOTALL):
        if part not in STRFTIME_CODES and part.startswith("%"):
            raise ValueError(f"unknown format code: {part}")
        if part in STRFTIME_CODES and part != "%%":
            out += [_quoted_literal(literal), STRFTIME_CODES[part]]
            literal = ""
        else:
            literal += part[-1]
    return "".join([*out, _quoted_literal(literal)])


def _quoted_literal(text: str) -> str:
    plain = not re.search(r"[^\W\d_]|['\[\]{}#]", text)
    return text if plain else "'" + text.replace("'", "''") + "'"


def strftime(timestamp: Column, format_text: str) -> Column:
    return F.date_format(timestamp, date_pattern(format_text))


def quote(value: Column) -> Column:
    """The text as a SQL literal, single quotes doubled."""
    return F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
