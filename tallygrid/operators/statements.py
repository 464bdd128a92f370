"""Data and column changes written as statements, recognised from Spark's own parsed plan.

Spark runs INSERT, UPDATE, DELETE and ALTER on tables of catalogs that support them.
A workbench table is a view on written files, so its changes go to `operators.changes`;
this module only tells what a statement asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Change:
    """A change of one table: `kind` is a method of `Workbench`, called with `arguments`."""

    kind: str
    table: str
    arguments: tuple[Any, ...] = ()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str | None:
    """The name a statement gives for its table; None for one in another catalog or schema."""
    kind = node.getClass().getSimpleName()
    if kind == "SubqueryAlias":
        return _name(node.child())
    parts = node.nameParts() if kind == "UnresolvedIdentifier" else getattr(node, "multipartIdentifier", lambda: None)()
    return parts.apply(0) if parts is not None and parts.size() == 1 else None


def _condition(option) -> Any:
    return F.expr(option.get().sql()) if option.isDefined() else None


def _inserted(spark: SparkSession, plan) -> tuple[DataFrame, list[str]]:
    rows = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query()), spark)
    return rows, [str(c) for c in _items(plan.userSpecifiedCols())]


def change_of(spark: SparkSession, sql: str, tables: set[str]) -> Change | None:
    """The change that a statement makes to one of `tables`; None for any other statement."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    if kind not in ("InsertIntoStatement", "UpdateTable", "DeleteFromTable", "AddColumns", "RenameColumn", "DropColumns", "DropTable"):
        return None
    node = plan.child() if kind == "DropTable" else plan.table()
    name = _name(node)
    if name not in tables:
        return None
    if kind == "InsertIntoStatement":
        return None if plan.overwrite() else Change("insert", name, _inserted(spark, plan))
    if kind == "UpdateTable":
        found = {a.key().sql().strip("`"): F.expr(a.value().sql()) for a in _items(plan.assignments())}
        return Change("update", name, (found, _condition(plan.condition())))
    if kind == "DeleteFromTable":
        text = plan.condition().sql()
        return Change("delete", name, (None if text == "true" else F.expr(text),))
    if kind == "AddColumns":
        return Change("add_column", name, tuple(
            (c.colName(), c.dataType().sql()) for c in _items(plan.columnsToAdd())))
    if kind == "RenameColumn":
        return Change("rename_column", name, (plan.column().name().apply(0), plan.newName()))
    if kind == "DropColumns":
        return Change("drop_column", name, tuple(c.name().apply(0) for c in _items(plan.columnsToDrop())))
    return Change("drop_table", name)
