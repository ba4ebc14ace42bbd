"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries
from regionlens.operators.skew import HOT_SHARE


@pytest.fixture
def shuffled(spark):
    """Plans as for tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(spark, folder, name) -> str:
    return queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["entity_trend", "national_avg_supply", "map_entity_year", "program_award_mix", "zone_year_metrics", "leaders_zone",
     "fact_zone_year_code", "occupations_top_rows", "pivot_onehot"],
)
def test_facts_are_read_once_and_hashed(shuffled, folder, name):
    text = plan(shuffled, folder, name)
    table = "orders" if name == "pivot_onehot" else "lineitem"
    assert len(re.findall(rf"FileScan[^\n]*{table}.parquet", text)) == 1
    assert "SortAggregate" not in text and "SinglePartition" not in text


def test_one_hot_is_one_shuffle(shuffled, folder):
    assert plan(shuffled, folder, "pivot_onehot").count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["leaders_zone_posts", "leaders_entity_total", "paged_table", "search_entity_regex"])
def test_top_lists_are_merged_not_sorted(shuffled, folder, name):
    assert "TakeOrderedAndProject" in plan(shuffled, folder, name)


def test_lines_are_summed_before_they_are_joined(shuffled, folder):
    text = plan(shuffled, folder, "zone_year_metrics")
    scan = text.index("lineitem.parquet")
    above = [m.group(1) for m in re.finditer(r"(partial_sum|SortMergeJoin|Exchange)", text[:scan])]
    assert above[-1] == "partial_sum"


def test_only_code_tables_are_broadcast_by_hint(shuffled, folder):
    text = plan(shuffled, folder, "program_award_mix")
    for match in re.finditer(r"BroadcastExchange[^\n]*\n([^\n]*)\n", text):
        assert "LocalTableScan" in match.group(1) or "Filter" in match.group(1) or "Project" in match.group(1)
    assert text.count("BroadcastExchange") == 2 and text.count("LocalTableScan") == 2


def pushed(spark, folder, name) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = queries()[name](spark, folder)._jdf.queryExecution().explainString(mode)
    return "\n".join(re.findall(r"PushedFilters: .*", text))


def test_filters_reach_the_scan(spark, folder):
    scan = pushed(spark, folder, "scan_project_filter")
    assert "EqualTo(l_returnflag,R)" in scan and "GreaterThanOrEqual(l_shipdate,1997" in scan
    orders = pushed(spark, folder, "leaders_zone")
    assert "Or(LessThan(o_orderdate,2001" in orders and "GreaterThanOrEqual(o_orderdate,2002" in orders
    assert "EqualTo(l_returnflag,R)" in pushed(spark, folder, "program_award_mix")


def test_hot_keys_are_few():
    assert 1 / HOT_SHARE <= 1000


def test_hot_part_is_summed_before_it_is_joined(spark, tmp_path):
    """A part that a third of all lines mention reaches the join with the parts as a few sums, not as lines."""
    from pyspark.sql import functions as F

    from regionlens.plans.facts import Tables, focus_by_program

    rows = spark.range(0, 120_000, numPartitions=12)
    rows.select(
        F.col("id").alias("l_orderkey"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 2000).cast("long").alias("l_partkey"),
        (F.col("id") % 10).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"),
        F.lit("R").alias("l_returnflag"),
        F.lit("1997-01-01").cast("timestamp_ntz").alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    parts = spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.concat(F.lit("n"), "id").alias("p_name"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(10).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        result = focus_by_program(Tables(spark, str(tmp_path)))
        total = sum(r.focus for r in result.collect())
        text = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert total == 120_000
    assert text.rindex("SortMergeJoin", 0, text.index("== Initial Plan ==")) < text.index("partial_sum")
    assert result.where("title = 'n5'").count() == 70


def test_lines_are_dealt_out_before_sums_that_hardly_shrink_them(spark, folder):
    """Completions by unit, part, line number and year are nearly as many as the lines: no split holds a sum of its own in memory."""
    from regionlens.operators.skew import dealt_out
    from regionlens.plans.facts import Tables
    from regionlens.plans.raw import inputs, raw_completions

    t = Tables(spark, folder)
    text = raw_completions(t)._jdf.queryExecution().executedPlan().toString()
    scan = text.index("lineitem.parquet")
    assert re.findall(r"partial_sum|REPARTITION_BY_NUM", text[:scan])[-1] == "REPARTITION_BY_NUM"
    assert inputs(t).postings._jdf.queryExecution().executedPlan().toString().count("partial_sum") == 1
    lines = t.read("lineitem")
    spread = dealt_out(lines, "l_suppkey", "l_partkey", rows=1000)
    assert spread.rdd.getNumPartitions() == -(-lines.count() // 1000) and spread.exceptAll(lines).isEmpty()


def exchanges(node):
    """All exchanges of a plan, with their column types and what lies below them."""
    if "Exchange" in node.nodeName():
        kinds = [node.output().apply(i).dataType().simpleString() for i in range(node.output().size())]
        yield kinds, node.toString()
    for i in range(node.children().size()):
        yield from exchanges(node.children().apply(i))


@pytest.mark.parametrize("name", ["fact_zone_year_code", "occupations_top_rows", "program_award_mix", "zone_year_metrics"])
def test_no_text_crosses_an_exchange_with_the_fact(shuffled, folder, name):
    root = queries()[name](shuffled, folder)._jdf.queryExecution().executedPlan()
    below = [kinds for kinds, text in exchanges(root) if "lineitem.parquet" in text and "HashAggregate" not in text.split("lineitem.parquet")[0].split("FileScan")[0]]
    raw = [kinds for kinds, text in exchanges(root) if "lineitem.parquet" in text and text.count("HashAggregate") <= 1]
    assert raw and not [k for k in [*below, *raw] if "string" in k]
