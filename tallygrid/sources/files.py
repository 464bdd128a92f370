"""Files behind a path: existence and sizes, from a listing that reads no content."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """`(path, length)` of every file; raises FileNotFoundError when there is none."""
    try:
        return spark.read.format("binaryFile").load(path).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
