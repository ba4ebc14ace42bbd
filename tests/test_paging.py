"""Pages of stored orders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from regionlens.operators import ranking
from regionlens.operators.paging import store_in_order
from regionlens.operators.ranking import ascending, descending


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 5000, numPartitions=6).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 13).alias("v"))


def order():
    return [descending("v"), ascending("id")]


def test_pages_are_those_of_the_full_order(table, tmp_path):
    stored = store_in_order(table, order(), str(tmp_path / "s"), slice_rows=300)
    for number, size in ((1, 10), (31, 10), (7, 45), (500, 10)):
        want = sorted(tuple(r) for r in ranking.page(table, order(), number, size).collect())
        assert sorted(tuple(r) for r in stored.page(number, size).collect()) == want and len(want) == size
    assert stored.page(501).count() == 0
    assert stored.page(334, 15).count() == 5
    assert stored.rows(299, 302).count() == 4
    assert stored.page(1).columns == ["id", "v", "row"]


def test_a_page_far_down_reads_one_slice(table, tmp_path):
    stored = store_in_order(table, order(), str(tmp_path / "s"), slice_rows=50)
    page = stored.page(400)
    assert page.count() == 10
    page.collect()
    plan = page._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "PartitionFilters" in plan.toString()
    assert plan.collectLeaves().apply(0).metrics().apply("numPartitions").value() == 1


def test_names_and_empty_tables(table, tmp_path):
    with pytest.raises(ValueError):
        store_in_order(table, order(), str(tmp_path / "a"), row="v")
    assert store_in_order(table.limit(0), order(), str(tmp_path / "b")).page(1).count() == 0


def test_a_larger_table_has_larger_slices_and_not_more(table, tmp_path):
    stored = store_in_order(table, order(), str(tmp_path / "s"), slice_rows=3, slices=7)
    assert len(list((tmp_path / "s").glob("_slice=*"))) == 7 and stored.slice_rows == 715
    for number, size in ((1, 10), (72, 10), (143, 5), (500, 10)):  # 715 and 716 lie in two slices
        want = sorted(tuple(r) for r in ranking.page(table, order(), number, size).collect())
        assert sorted(tuple(r) for r in stored.page(number, size).collect()) == want and len(want) == size
