"""Plan-shape assertions: the scale properties the design relies on."""

import re

from pyspark.sql import functions as F

from quire.operators import chunks, clean, sections
from quire.sources import profile

from conftest import SF001

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
                          plan))


def test_prefix_sections_and_long_form_are_row_local(spark):
    part = spark.read.parquet(f"{SF001}/part.parquet").select(F.col("p_name").alias("name"))
    rules = [("a", "prefix", "red"), ("a", "exclude", "red rod"), ("b", "name", "hot rod")]
    assert exchanges(plan_of(sections.sections_by_prefix(part, rules))) == 0
    cust = spark.read.parquet(f"{SF001}/customer.parquet")
    long = sections.sections_long(cust, ["c_custkey"], {"s": ["c_name", "c_acctbal"]})
    assert "Join" not in plan_of(long)


def test_cap_threshold_reaches_the_scan(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    sub = chunks.first_rows(li, 1000, KEYS)
    pushed = plan_of(sub).split("PushedFilters: [")[1].split("]")[0]
    assert "LessThanOrEqual(l_orderkey" in pushed


def test_profile_is_one_grouped_count_without_columns(spark):
    tables = {t: spark.read.parquet(f"{SF001}/{t}.parquet") for t in ["orders", "lineitem", "part"]}
    plan = plan_of(profile.dataset_profile(spark, tables))
    assert exchanges(plan) == 1
    assert all(m == "" for m in re.findall(r"FileScan parquet \[([^\]]*)\]", plan))


def test_section_projection_keeps_codegen(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    plan = plan_of(clean.stringify_cells(sections.project_section(li, KEYS, ["l_tax", "l_shipdate"])))
    assert re.search(r"\*\(\d+\) Project", plan)


def test_cell_rules_keep_rows_where_they_are(spark):
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    assert exchanges(plan_of(clean.numeric_or_text(clean.stringify_cells(li)))) == 0
