"""CSV export: one folder of part files with a header each, written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.session import setting
from tallygrid.types import category, col


def _writable(df: DataFrame) -> DataFrame:
    """Timestamps as `date time` text, nested values as text."""
    shown = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) or category(f.dataType) == "other":
            value = value.cast("string")
        shown.append(value.alias(f.name))
    return df.select(*shown)


def export_csv(df: DataFrame, path: str, limit: int | None = None, sep: str = ",", encoding: str = "UTF-8") -> str:
    """Write `df`; NULL is an empty field, an empty text is `""`.

    `limit` is the row cap of a view export; without it the result is whole.
    """
    if limit is not None:
        df = df.limit(limit)
    _writable(df).write.options(
        header=True, sep=sep, quote='"', escape='"', emptyValue='""', nullValue="", encoding=encoding,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path


def export_encoded(df: DataFrame, path: str, encoding: str) -> str:
    """`export_csv` in any character set the JVM knows."""
    with setting(df.sparkSession, "spark.sql.legacy.javaCharsets", "true"):
        return export_csv(df, path, encoding=encoding)
