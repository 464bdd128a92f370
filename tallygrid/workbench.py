"""The user-facing registry: loaded tables, saved views, queries and profiles."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions.scalar_sql import register_functions
from tallygrid.operators import changes, distribution as dist, profile
from tallygrid.operators.adhoc_profile import profile_sql_column, profile_sql_columns, top_values
from tallygrid.operators.catalog import catalog_columns, free_name, search, table_name_for
from tallygrid.operators.columns import COLUMN_QUERIES
from tallygrid.operators.query import FAILURES, PAGE_ROWS, ResultPage, fetch, parse
from tallygrid.operators.sql_text import adapted
from tallygrid.operators.statements import Change, change_of
from tallygrid.plans.paging import WrittenRows, write_rows
from tallygrid.plans.versions import TableVersion
from tallygrid.session import unbound_recursion
from tallygrid.sources.csv_export import export_csv
from tallygrid.sources.csv_lines import line_facts
from tallygrid.sources.csv_load import LoadedCsv, load_csv
from tallygrid.sources.files import delete_folder, exists
from tallygrid.types import quoted


@dataclass
class Table:
    """A registered table. `version` changes with every write to it."""

    name: str
    file_path: str
    row_count: int
    columns: list[dict[str, str]]
    file_size: int
    encoding: str
    version: int
    rows: TableVersion | None
    loaded: LoadedCsv | None = None


@dataclass
class LoadStatus:
    path: str
    table_name: str | None
    row_count: int
    error: str | None = None


def _stored_page(stored: WrittenRows | TableVersion, limit: int, offset: int) -> ResultPage:
    shown = stored.page(limit, offset)
    rows = [list(r) for r in shown.collect()]
    return ResultPage(shown.columns, rows, len(rows), stored.row_count)


class Workbench:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, Table] = {}
        self._views: dict[str, str] = {}
        self._profiles: dict[tuple[str, int], DataFrame] = {}
        self._results: dict[str, tuple[WrittenRows, list[str]]] = {}
        self._versions = 0
        register_functions(spark)
        unbound_recursion(spark)

    # loading -----------------------------------------------------------------

    def load_csv(self, path: str | list[str], table_name: str | None = None, **how: Any) -> Table:
        """Load a CSV file (or several of one layout) as a table."""
        first = path if isinstance(path, str) else path[0]
        taken = set(self._tables)
        name = free_name(table_name, taken) if table_name else table_name_for(first, taken)
        loaded = load_csv(self.spark, path, **how)
        return self._register(name, TableVersion.of(loaded.rows, loaded.schema, self.spark), first, loaded)

    def load_files(self, paths: list[str]) -> list[LoadStatus]:
        """Load a list of files; one that fails is reported and passed over. All are looked at in one pass, and loaded one by one."""
        out = []
        there = [p for p in paths if exists(self.spark, p)]
        try:
            facts = {f.file: f for f in line_facts(self.spark, there)} if there else {}
        except FAILURES:  # then each is looked at by itself, and fails by itself
            facts = {}
        for path in paths:
            try:
                table = self.load_csv(path, facts=facts)
                out.append(LoadStatus(path, table.name, table.row_count))
            except (PySparkException, OSError, ValueError) as error:
                out.append(LoadStatus(path, None, 0, str(error)))
        return out

    def create_table(self, name: str, source: DataFrame | str) -> Table:
        """A table from a DataFrame or a query, written as Parquet."""
        df = parse(self.spark, source) if isinstance(source, str) else source
        if name in self._tables:
            raise ValueError(f"table exists: {name}")
        written = write_rows(df, "table")
        return self._register(name, TableVersion.of(written, written.frame().schema, self.spark), "", None)

    def _register(self, name: str, rows: TableVersion, path: str, loaded: LoadedCsv | None) -> Table:
        rows.frame().createOrReplaceTempView(quoted(name))
        self._forget_results()
        self._versions += 1
        columns = [{"name": f.name, "dtype": f.dataType.simpleString()} for f in rows.schema.fields]
        table = Table(
            name, path, rows.row_count, columns, loaded.file_size if loaded else 0, loaded.plan.encoding if loaded else "UTF-8",
            self._versions, rows, loaded,
        )
        self._tables[name] = table
        return table

    # catalog -----------------------------------------------------------------

    def tables(self) -> list[Table]:
        """Registered tables, then those that statements made."""
        made = [t.name for t in self.spark.catalog.listTables() if not t.isTemporary and t.name not in self._tables]
        return [*self._tables.values(), *map(self._made_by_statement, made)]

    def table_info(self, name: str) -> Table | None:
        if name in self._tables or not self.spark.catalog.tableExists(quoted(name)) or name in self._views:
            return self._tables.get(name)
        return self._made_by_statement(name)

    def _made_by_statement(self, name: str) -> Table:
        frame = self.spark.table(quoted(name))
        columns = [{"name": f.name, "dtype": f.dataType.simpleString()} for f in frame.schema.fields]
        return Table(name, "", frame.count(), columns, 0, "UTF-8", 0, None)

    def _names(self) -> list[str]:
        made = [t.name for t in self.spark.catalog.listTables() if not t.isTemporary]
        return list(dict.fromkeys([*self._tables, *made]))

    def table(self, name: str) -> DataFrame:
        """A registered table, or one a statement such as CREATE TABLE made."""
        if name not in self._tables and not self.spark.catalog.tableExists(quoted(name)):
            raise ValueError(f"no such table: {name}")
        return self.spark.table(quoted(name))

    def rejects(self, name: str) -> DataFrame:
        """The rows left out when the table was loaded."""
        loaded = self._tables[name].loaded
        if loaded is None:
            return self.spark.createDataFrame([], "file string, line string, reason string")
        return loaded.rejects()

    def columns(self) -> DataFrame:
        return catalog_columns(self.spark, {n: self.table(n) for n in self._names()})

    def search(self, text: str) -> DataFrame:
        """Tables and views whose name contains the text."""
        rows = [(n, "table") for n in self._names()] + [(n, "view") for n in self._views]
        return search(self.spark.createDataFrame(rows, "name string, kind string"), text, "name")

    def save_view(self, name: str, sql: str) -> bool:
        """Create or replace a view; false when the query is not valid.

        The view keeps its text, so it follows later versions of its tables.
        """
        try:
            text = adapted(self.spark, sql.strip().removesuffix(";"))
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {quoted(name)} AS {text}")
        except PySparkException:
            return False
        self._views[name] = sql
        self._forget_results()
        return True

    def views(self) -> dict[str, str]:
        return dict(self._views)

    def restore_views(self, views: dict[str, str]) -> list[str]:
        """Save views that may build on each other; returns those that could not be."""
        waiting = dict(views)
        while True:
            saved = [name for name, sql in waiting.items() if self.save_view(name, sql)]
            for name in saved:
                del waiting[name]
            if not saved or not waiting:
                return list(waiting)

    def delete_view(self, name: str) -> bool:
        self.spark.catalog.dropTempView(name)
        self._views.pop(name, None)
        self._forget_results()
        return True

    def drop_table(self, name: str) -> bool:
        """Drop a table, also one that a statement made; false when there is none."""
        table = self._tables.pop(name, None)
        self.clear_profiles(name)
        self._forget_results()
        if table is None:
            if not self.spark.catalog.tableExists(quoted(name)):
                return False
            self.spark.sql(f"DROP TABLE {quoted(name)}")
            return True
        self.spark.catalog.dropTempView(name)
        for folder in {*(table.rows.folders if table.rows else ()), *([table.loaded.folder] if table.loaded else ())}:
            delete_folder(self.spark, folder)
        return True

    def release_versions(self, name: str) -> int:
        """Delete what only earlier versions of a table read; who still reads one of these is cut off."""
        table = self._tables[name]
        unused = table.rows.unused()
        for folder in unused:
            delete_folder(self.spark, folder)
        table.rows = replace(table.rows, folders=table.rows.folders - unused)
        return len(unused)

    def compact(self, name: str) -> Table:
        """Write a table of many changes as one part."""
        return self._change(name, lambda rows: rows.rewritten(rows.frame()))

    def clear_all(self) -> bool:
        for name in list(self._views):
            self.delete_view(name)
        for name in list(self._tables):
            self.drop_table(name)
        return True

    def _forget_results(self) -> None:
        for stored, _ in self._results.values():
            delete_folder(self.spark, stored.path)
        self._results.clear()

    # queries -----------------------------------------------------------------

    def execute(self, sql: str, limit: int = PAGE_ROWS, offset: int = 0) -> ResultPage:
        """A page of a statement's result; changes of workbench tables are carried out as their methods are.

        A result that is longer than the first page asked for is written once, and all its pages are
        read from there, so they fit each other. It is kept until a table or view changes.
        """
        started = time.perf_counter()
        try:
            page = self._execute(sql, limit, offset)
        except FAILURES as error:
            page = ResultPage(error=str(error))
        page.execution_time = time.perf_counter() - started
        return page

    def _execute(self, sql: str, limit: int, offset: int) -> ResultPage:
        text = adapted(self.spark, sql.strip().removesuffix(";"))
        change = change_of(self.spark, text, set(self._tables))
        if change:
            self._carry_out(change)
            return ResultPage()
        if sql not in self._results:
            df = parse(self.spark, sql)
            if not df.columns:
                self._forget_results()  # a statement may have changed what results rest on
                return ResultPage()
            if not offset:
                rows = [list(r) for r in df.limit(limit + 1).collect()]
                if len(rows) <= limit:
                    return ResultPage(df.columns, rows, len(rows), len(rows))
            # results may repeat a name or have columns without a type
            kept = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
            untyped = {c: F.col(c).cast("string") for c, t in kept.dtypes if t == "void"}
            self._results[sql] = (write_rows(kept.withColumns(untyped) if untyped else kept), df.columns)
        stored, names = self._results[sql]
        page = _stored_page(stored, limit, offset)
        page.columns = names
        return page

    def _carry_out(self, change: Change) -> None:
        if change.kind == "insert":
            rows, columns = change.arguments
            if columns:  # named columns, the others NULL
                if len(columns) != len(rows.columns):
                    raise ValueError(f"{len(rows.columns)} values for {len(columns)} columns")
                self._change(change.table, lambda old: old.insert(changes.insert_named(old.frame().limit(0), rows, columns)))
            else:
                self._change(change.table, lambda old: old.insert(changes.insert(old.frame().limit(0), rows, by_position=True)))
        elif change.kind == "add_column":
            for column, data_type in change.arguments:
                self.add_column(change.table, column, data_type)
        elif change.kind == "drop_column":
            for column in change.arguments:
                self.drop_column(change.table, column)
        else:
            getattr(self, change.kind)(change.table, *change.arguments)

    def table_data(self, name: str, limit: int = PAGE_ROWS, offset: int = 0) -> ResultPage:
        """A page of a stored table in load order; reads only the rows' own files."""
        table = self._tables.get(name)
        if table is None:
            return ResultPage(error=f"no such table: {name}")
        if table.rows is None:
            return fetch(self.table(name), limit, offset)
        return _stored_page(table.rows, limit, offset)

    def column_query(self, name: str, column: str, kind: str) -> DataFrame:
        """One of the ready-made column queries by its name."""
        return COLUMN_QUERIES[kind](self.table(name), column)

    def export_csv(self, sql_or_table: str, path: str, is_sql: bool = False) -> bool:
        try:
            export_csv(parse(self.spark, sql_or_table) if is_sql else self.table(sql_or_table), path)
        except (PySparkException, ValueError):
            return False
        return True

    def export_view(self, name: str, path: str, limit: int | None = None) -> str:
        return export_csv(self.spark.table(quoted(name)), path, limit)

    # profiles ----------------------------------------------------------------

    def analyze_table(self, name: str, force_refresh: bool = False) -> DataFrame:
        """The profile of a table, one row per column, kept until the table changes.

        What is kept is the rows themselves, which no lost executor takes away.
        """
        df = self.table(name)
        if name not in self._tables:  # Spark's own table: no version to keep a profile for
            return profile.profile_table(df, name)
        key = (name, self._tables[name].version)
        if force_refresh:
            self.clear_profiles(name)
        if key not in self._profiles:
            made = profile.profile_table(df, name)
            self._profiles[key] = self.spark.createDataFrame(made.collect(), made.schema)
        return self._profiles[key]

    def clear_profiles(self, name: str | None = None) -> None:
        for key in [k for k in self._profiles if name is None or k[0] == name]:
            del self._profiles[key]

    def analyze_column(self, name: str, column: str) -> DataFrame:
        return profile.profile_column(self.table(name), column)

    def analyze_column_from_sql(self, sql: str, column: str) -> tuple[DataFrame, DataFrame]:
        """Profile and top values of a column of a query result."""
        df = parse(self.spark, sql)
        return profile_sql_column(df, column), top_values(df, column)

    def analyze_columns_from_sql(self, sql: str, columns: list[str] | None = None) -> DataFrame:
        """Profiles of several columns (or all) of a query result, from one run of the query."""
        df = parse(self.spark, sql)
        return profile_sql_columns(df, columns if columns is not None else df.columns)

    def missing_report(self, name: str) -> tuple[DataFrame, DataFrame]:
        """The report per column and the summary of the table."""
        df = self.table(name)
        return profile.missing_report(df), profile.missing_summary(df)

    def numeric_summary(self, name: str) -> DataFrame:
        return profile.numeric_summary(self.table(name))

    def column_distribution(self, name: str, column: str, bins: int = dist.BINS) -> DataFrame:
        return dist.distribution(self.table(name), column, bins)

    # changes -----------------------------------------------------------------

    def _change(self, name: str, change: Callable[[TableVersion], TableVersion]) -> Table:
        """Make a table's next version; earlier ones stay for those who read them (see `release_versions`)."""
        old = self._tables[name]
        rows = change(old.rows)
        self.clear_profiles(name)
        # rejects, size and encoding stay those of the load
        return self._register(name, rows, old.file_path, old.loaded)

    def insert(self, name: str, rows: DataFrame | str) -> Table:
        """Add rows: a DataFrame by column name, `VALUES` or `SELECT` text by position. Only they are written."""
        by_position = isinstance(rows, str)
        added = parse(self.spark, rows) if by_position else rows
        return self._change(name, lambda old: old.insert(changes.insert(old.frame().limit(0), added, by_position)))

    def update(self, name: str, assignments: dict[str, Column], where: Column | None = None) -> Table:
        """New values for the rows for which `where` is true; only they are written, and stand at the end."""
        return self._change(name, lambda old: old.update(lambda rows: changes.update(rows, assignments), where))

    def delete(self, name: str, where: Column | None = None) -> Table:
        """Take out the rows for which `where` is true; bit maps of their places are written."""
        return self._change(name, lambda old: old.delete(where))

    def add_column(self, name: str, column: str, data_type: str, default: Column | None = None) -> Table:
        """A new column; without a default no data is written."""
        made = changes.add_column(self.table(name), column, data_type, default)
        return self._change(name, lambda old: old.add_column(column, data_type) if default is None else old.rewritten(made))

    def rename_column(self, name: str, old: str, new: str) -> Table:
        """A new name; no data is written."""
        changes.rename_column(self.table(name), old, new)
        return self._change(name, lambda rows: rows.rename_column(old, new))

    def drop_column(self, name: str, column: str) -> Table:
        """A column less; no data is written."""
        changes.drop_column(self.table(name), column)
        return self._change(name, lambda rows: rows.drop_column(column))
