"""Joins that move nothing, and years that are not read."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import colocated, matching


def test_no_exchange(spark):
    held = colocated.Archive(spark, buckets=4)
    held.add("meta", spark.range(100).select(F.col("id").alias("ark"), F.concat(F.lit("t"), "id").alias("title")))
    held.add("page_map", spark.range(300).select((F.col("id") % 100).alias("ark"), (F.col("id") / 100).cast("int").alias("pos"), F.col("id").cast("int").alias("ordre"), F.when(F.col("id") % 2 == 0, "A").alias("pagination_type")))
    held.add("entries", spark.range(150).where("id % 100 < 40").select((F.col("id") % 100).alias("ark"), F.lit("x").alias("entry")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = colocated.issue_contents(held)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 60 + 80 and all(r["views"] == 3 for r in rows)
    assert sum(r["entry"] is None for r in rows) == 60
    assert {r["ark"]: r["last_pno"] for r in rows}[3] == 3 and {r["ark"]: r["last_pno"] for r in rows}[2] == 202
    held.close()
    with pytest.raises(KeyError):
        held.table("meta")


def test_other_years_are_not_read(spark, tmp_path):
    issues = spark.range(1000).select((F.col("id") % 20).alias("series"), F.col("id").alias("issue"), (F.col("id") % 50 + 1900).cast("int").alias("year"))
    lying = colocated.by_year(issues, "year", str(tmp_path / "by year"))
    serials = spark.createDataFrame([(1, [1905]), (2, [1907, 1906]), (3, []), (4, [70_000])], "serial long, years array<int>")
    found = colocated.issues_wanted(serials, "years", "serial", lying, "series", "year")
    want = matching.possible_issues(serials, "years", "serial", issues, "series", "year")
    assert sorted(map(tuple, found.select("serial", "wanted", "issue").collect())) == sorted(map(tuple, want.select("serial", "wanted", "issue").collect()))
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
