"""Every part as a target, against a search in Python."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scriptorium.functions import text
from scriptorium.operators import matching
from scriptorium.plans import catalogue

# equal names that differ in size and type, more than 50 candidates, a null name
PARTS = [(1, "red bolt", 3, "A"), (2, "red bolt", 9, "A"), (3, "red bolt", 3, "B"), (4, "blue nut", 4, "B"), (5, None, 9, "A"), *[(k, f"other {k % 7}", k % 5, "A") for k in range(10, 75)]]


def scored(target, candidate):
    title = None if target[1] is None else text.indel_ratio(target[1], candidate[1]) / 100
    number = float(target[2] in range(candidate[2], candidate[2] + 3))
    values = [v for v in (title, number) if v is not None]
    return title, number, sum(values) / len(values), len(values)


def candidates(target):
    return [(c[0], *scored(target, c)) for c in sorted(PARTS, key=lambda p: p[0]) if c[3] == target[3]]


def seen(target):
    out, top = [], 0
    for n, c in enumerate(candidates(target)[:50]):
        out.append(c)
        top = max(top, c[3])
        if n >= 4 and top > 0.7:
            break
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(PARTS, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{path}/part.parquet")
    return path


def rows(spark, folder, name, *columns):
    return sorted(map(tuple, catalogue.QUERIES[name](spark, folder).select(*columns).collect()))


def test_every_part_is_a_target(spark, folder):
    keys = lambda rows: {r[0] for r in rows}
    found = catalogue.QUERIES["match_scores"](spark, folder).collect()
    assert keys(found) == keys(PARTS)
    want = {(p[0], c[0]): c[1:] for p in PARTS for c in candidates(p)}
    assert len(found) == len(want)
    for r in found:
        title, number, score, n = want[r["target"], r["pos"]]
        assert (r["s_title"], r["s_number"], r["n_scored"]) == (title, number, n) and r["score"] == pytest.approx(score, abs=1e-6)


def test_best_and_seen_of_every_part(spark, folder):
    assert rows(spark, folder, "early_exit", "target", "pos", "seen") == sorted((p[0], c[0], n) for p in PARTS for n, c in enumerate(seen(p)))
    assert rows(spark, folder, "match_best", "target", "pos") == sorted((p[0], max(seen(p), key=lambda c: (c[3], -c[0]))[0]) for p in PARTS)


def test_entry_has_every_part(spark):
    assert __spark_entry__.entry(spark).select("target").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()


def shuffled(spark):
    """Rows that all stages so far have written for others."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_are_not_shuffled(spark, tmp_path):
    """360,000 pairs of 600 names, from few rows; rows that repeat a key or have none count each."""
    parts = [(k, f"part {k}", k % 7, "A") for k in range(598)] + [(3, "part 3", 1, "A"), (None, "part 4", None, "A"), (7, "part", 1, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    before = shuffled(spark)
    found = catalogue.QUERIES["match_scores"](spark, str(tmp_path)).cache()
    assert found.count() == 600 * 600 and found.where("target = 3 AND pos = 3").count() == 4 and found.where("target IS NULL AND pos IS NULL").count() == 1
    assert shuffled(spark) - before < 20_000
    found.unpersist()


def test_a_frequent_name_is_packed_in_parts(spark):
    """8,000 equal names and sizes, 2,000 or so a side: no row holds a whole side's keys, and no pair is lost."""
    rows = spark.range(8000).select("id", F.lit("A").alias("type"), F.lit("part").alias("name"), F.lit(1).alias("size"))
    met = matching.cells_of_pairs(rows, "type", "id", "name", "size").select(*[F.aggregate(F.col(c), F.lit(0), lambda n, h: n + F.size(h["keys"])).alias(c) for c in ("t_held", "c_held")])
    most, pairs = met.agg(F.max(F.greatest("t_held", "c_held")), F.sum(F.col("t_held").cast("long") * F.col("c_held"))).first()
    assert most < 1.5 * matching.PACK_ROWS and pairs == 8000 * 8000


def test_means_are_rounded_before_sizes_are_paired(spark, folder):
    """Rounding costs more than all else, so it is done once a pair of names."""
    plan = catalogue.QUERIES["match_scores"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    spread = [k for k, line in enumerate(plan) if "Generate explode(c_held" in line]
    rounded = [k for k, line in enumerate(plan) if "round(" in line]
    assert spread and rounded and min(rounded) > max(spread)
