"""Spark session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    # lets users keep writing "column name" for identifiers
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # WITH RECURSIVE ends when a step gives no rows, not after a number of steps or rows
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
}


def unbound_recursion(spark: SparkSession) -> None:
    """Let WITH RECURSIVE run as deep as it goes, in a session that `build_session` has not made."""
    for key in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(key, SETTINGS[key])


def build_session(app_name: str = "tallygrid", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the library is tested with.

    `master` stays unset on a cluster, where spark-submit names it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` of the session.

    Where it is unset, a local master gets a temporary folder; on a cluster there is no
    safe guess, so it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tallygrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/tallygrid/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tallygrid_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tallygrid-code-"), "tallygrid.zip")  # read by the driver only
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(archive)
    context._tallygrid_shipped = True


def map_arrow(frame: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """`mapInArrow` by functions of this package."""
    ship(frame.sparkSession)
    return frame.mapInArrow(function, schema)


def map_pandas(frame: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """`mapInPandas` by functions of this package."""
    ship(frame.sparkSession)
    return frame.mapInPandas(function, schema)
