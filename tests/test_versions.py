"""Tables that change without being rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from tallygrid import Workbench
from tallygrid.plans.paging import ROW_ID


@pytest.fixture
def bench(spark):
    bench = Workbench(spark)
    bench.create_table("t", spark.range(10_000, numPartitions=4).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("s")))
    yield bench
    bench.clear_all()


def written(bench, folder):
    path = folder.removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def ids(bench, text="SELECT id FROM t"):
    return sorted(r[0] for r in bench.spark.sql(text).collect())


def test_an_insert_writes_its_rows_only(bench):
    before = bench.table_info("t").rows
    assert bench.insert("t", "VALUES (20000L, 3L, 'new'), (20001L, NULL, NULL)").row_count == 10_002
    after = bench.table_info("t").rows
    assert after.parts[0] is before.parts[0] and len(after.parts) == 2
    assert written(bench, after.parts[1].rows.path) < written(bench, before.parts[0].rows.path) / 5
    assert [tuple(r) for r in bench.table_data("t", 5, 9_999).data] == [(9_999, 9_999 % 7, "x"), (20000, 3, "new"), (20001, None, None)]


def test_a_delete_writes_bit_maps(bench):
    old = bench.table("t")
    assert bench.delete("t", F.col("id") == 4321).row_count == 9_999
    part = bench.table_info("t").rows.parts[0]
    assert bench.spark.read.parquet(part.gone).count() == 1 and part.rows is bench.table_info("t").rows.parts[0].rows
    bench.delete("t", (F.col("id") >= 100) & (F.col("id") < 9_900) & (F.col("k") != 3))
    gone = {4321, *(i for i in range(100, 9_900) if i % 7 != 3)}
    assert ids(bench) == [i for i in range(10_000) if i not in gone]
    assert old.count() == 10_000  # who reads an earlier version keeps it
    left = ids(bench)
    for offset in (0, 90, 700, len(left) - 3):
        assert [r[0] for r in bench.table_data("t", 10, offset).data] == left[offset : offset + 10]
    assert bench.table_info("t").row_count == len(left) and bench.delete("t", F.lit(None)).row_count == len(left)
    assert bench.delete("t").row_count == 0 and bench.table_data("t").data == [] and bench.table("t").columns == ["id", "k", "s"]
    assert bench.insert("t", "VALUES (1L, 2L, 'y')").row_count == 1


def test_an_update_writes_changed_rows_only(bench):
    assert bench.update("t", {"k": F.col("id"), "s": F.lit("z")}, F.col("id") % 1000 == 5).row_count == 10_000
    rows = bench.table_info("t").rows
    assert [p.row_count for p in rows.parts] == [9_990, 10]
    assert sorted(map(tuple, bench.spark.sql("SELECT id, k FROM t WHERE s = 'z'").collect())) == [(i, i) for i in range(5, 10_000, 1000)]
    assert ids(bench) == list(range(10_000))
    bench.update("t", {"k": F.lit(0)})
    assert bench.execute("SELECT COUNT(*), SUM(k) FROM t").data == [[10_000, 0]]
    assert bench.update("t", {"k": F.lit(1)}, F.lit(False)).row_count == 10_000


def test_columns_change_without_data(bench):
    folders = bench.table_info("t").rows.folders
    bench.add_column("t", "note", "string")
    bench.rename_column("t", "s", "note2")
    bench.drop_column("t", "k")
    bench.rename_column("t", "id", "k")
    assert bench.table_info("t").rows.folders == folders and bench.table("t").columns == ["k", "note2", "note"]
    bench.insert("t", "VALUES (-1L, 'b', 'c')")
    assert bench.execute("SELECT * FROM t WHERE k < 1 ORDER BY k").data == [[-1, "b", "c"], [0, "x", None]]
    bench.add_column("t", "twice", "bigint", F.col("k") * 2)
    assert bench.execute("SELECT SUM(twice) FROM t").data == [[9_999 * 10_000 - 2]]
    with pytest.raises(ValueError):
        bench.add_column("t", "twice", "int")


def test_old_versions_are_released(bench):
    for k in range(3):
        bench.delete("t", F.col("id") == k)
        bench.insert("t", f"VALUES ({k}L, 0L, 'again')")
    assert ids(bench) == list(range(10_000)) and len(bench.table_info("t").rows.parts) == 4
    assert bench.release_versions("t") > 0 and bench.release_versions("t") == 0
    assert ids(bench) == list(range(10_000))
    assert bench.compact("t").row_count == 10_000 and len(bench.table_info("t").rows.parts) == 1
    folders = bench.table_info("t").rows.folders
    bench.drop_table("t")
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)


def test_random_changes_equal_plain_ones(bench):
    import random

    random.seed(5)
    rows = {i: i % 7 for i in range(10_000)}
    for _ in range(8):
        low = random.randrange(10_000)
        kind = random.choice(["delete", "update", "insert"])
        where = (F.col("id") >= low) & (F.col("id") < low + 800) & (F.col("k") % 2 == 0)
        hit = [i for i, k in rows.items() if low <= i < low + 800 and k % 2 == 0]
        if kind == "delete":
            bench.delete("t", where)
            for i in hit:
                del rows[i]
        elif kind == "update":
            bench.update("t", {"k": F.col("k") + 1}, where)
            rows |= {i: rows[i] + 1 for i in hit}
        else:
            new = max(rows) + 1
            bench.insert("t", f"SELECT id, 4L, 's' FROM range({new}, {new + 50})")
            rows |= {i: 4 for i in range(new, new + 50)}
        assert bench.table_info("t").row_count == len(rows)
    assert {r.id: r.k for r in bench.table("t").collect()} == rows
    paged = [r[0] for offset in range(0, len(rows), 1000) for r in bench.table_data("t", 1000, offset).data]
    assert sorted(paged) == sorted(rows) and len(paged) == len(rows)
    assert ROW_ID not in bench.table("t").columns


def test_pages_of_a_table_with_rejects_read_their_blocks(spark, tmp_path, monkeypatch):
    """Every tenth line is a reject, so ids have gaps; blocks of 64 ids."""
    from tallygrid.plans import paging, versions

    for module in (paging, versions):
        monkeypatch.setattr(module, "BLOCK_SHIFT", 6)
    path = tmp_path / "gaps.csv"
    path.write_text("a,b\n" + "".join(f"{i},x,y\n" if i % 10 == 9 else f"{i},x\n" for i in range(5000)))
    bench = Workbench(spark)
    bench.load_csv(str(path), "gaps")
    kept = [i for i in range(5000) if i % 10 != 9]
    rows = bench.table_info("gaps").rows
    assert not rows.parts[0].rows.dense and max(n for _, n in rows.parts[0].rows.partitions) <= 64
    for offset in (0, 57, 58, 2000, 4495, 4500):
        assert [r[0] for r in bench.table_data("gaps", 20, offset).data] == kept[offset : offset + 20]
    plan = rows.page(20, 2000)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(__row_id" in plan and "LessThan(__row_id" in plan
    bench.delete("gaps", F.col("a") < 1000)
    assert [r[0] for r in bench.table_data("gaps", 20, 50).data] == [i for i in kept if i >= 1000][50:70]
    bench.clear_all()


def test_recursion_goes_as_deep_as_it_has_to(bench):
    page = bench.execute("WITH RECURSIVE q(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM q WHERE n < 800) SELECT COUNT(*), MAX(n) FROM q")
    assert page.error is None and page.data == [[800, 800]]
    bench.create_table("edges", "SELECT id AS a, id + 1 AS b FROM range(150)")
    page = bench.execute("WITH RECURSIVE r(x) AS (SELECT 0L UNION ALL SELECT b FROM r JOIN edges ON x = a) SELECT COUNT(*) FROM r")
    assert page.error is None and page.data == [[151]]
