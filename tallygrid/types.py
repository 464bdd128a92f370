"""Type categories of columns, and small column helpers used everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, STRING = "integer", "float", "string"
DATETIME, BOOLEAN, OTHER = "datetime", "boolean", "other"

_CATEGORIES = (
    (INTEGER, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)),
    (FLOAT, (T.FloatType, T.DoubleType, T.DecimalType)),
    (STRING, (T.StringType, T.CharType, T.VarcharType)),
    (DATETIME, (T.DateType, T.TimestampType, T.TimestampNTZType)),
    (BOOLEAN, (T.BooleanType,)),
)


def category(data_type: T.DataType) -> str:
    """integer, float, string, datetime, boolean or other."""
    for name, classes in _CATEGORIES:
        if isinstance(data_type, classes):
            return name
    return OTHER


def is_numeric(data_type: T.DataType) -> bool:
    return category(data_type) in (INTEGER, FLOAT)


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def field(df: DataFrame, name: str) -> T.StructField:
    for candidate in df.schema.fields:
        if candidate.name == name:
            return candidate
    raise ValueError(f"no such column: {name}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if category(f.dataType) == STRING]


def clean(value: Column, digits: int = 4) -> Column:
    """NaN and infinities become NULL, everything else is rounded."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.round(value, digits))


def clean_sql(value: str, digits: int = 4) -> str:
    """`clean` as SQL text."""
    return f"CASE WHEN NOT (isnan({value}) OR abs({value}) = double('inf')) THEN round({value}, {digits}) END"


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent with two decimals, 0 when there is nothing."""
    share = F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
    return F.round(F.coalesce(share, F.lit(0.0)), 2)


# What a number may look like as text (sign, digits with single
# underscores between them, fraction, exponent, or a named special value).
NUMBER_TEXT = (
    r"^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:[eE][+-]?\d+)?"
    r"|\.\d+(?:_\d+)*(?:[eE][+-]?\d+)?"
    r"|[nN][aA][nN]|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"
)


def text_to_double(text: Column, mostly_numbers: bool = False) -> Column:
    """Text as a double, NULL when it is not a number.

    A plain cast would take `1d` and hexadecimal floats and refuse `1_000`, so
    the pattern decides. A cast that fails is slow: text of unknown kind is
    matched first. For `mostly_numbers` the cast comes first, and only text that
    fails it or holds one of the letters in question is matched.
    """
    matched = F.when(
        F.rlike(text, F.lit(NUMBER_TEXT)), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "").try_cast("double")
    )
    if not mostly_numbers:
        return matched
    direct = text.try_cast("double")
    return F.when(direct.isNotNull() & ~F.rlike(text, F.lit("[dDfFxX]")), direct).otherwise(matched)
