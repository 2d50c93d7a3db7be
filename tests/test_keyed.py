"""A store that is updated: segments, compaction, two writers, streams that run again."""

import random

import pytest
from pyspark.sql import types as T

from scriptorium.operators import keyed
from scriptorium.streaming import upserts

SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("key", T.LongType()), T.StructField("value", T.StringType()), T.StructField("version", T.LongType())])


def rows_of(seed, n=200):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randint(0, 30), f"v{rng.randint(0, 9)}", rng.randint(0, 1000)) for _ in range(n)]


def latest(rows):
    held = {}
    for name, key, value, version in rows:
        held[name, key] = max(held.get((name, key), (-1, "")), (version, value))
    return sorted((name, key, value, version) for (name, key), (version, value) in held.items())


def got(frame):
    return sorted(map(tuple, frame.select("name", "key", "value", "version").collect()))


def test_puts_and_compactions(spark, tmp_path):
    store = keyed.KeyedStore.create(spark, str(tmp_path / "s"), SCHEMA, ["name", "key"], "version", buckets=4)
    assert got(store.read()) == [] and store.manifest() == keyed.Manifest()
    seen = []
    for k in range(4):
        other = keyed.KeyedStore(spark, str(tmp_path / "s"))
        for writer in (store, other):
            more = rows_of((k, writer is other).__hash__())
            seen += more
            writer.put(spark.createDataFrame(more, SCHEMA))
        assert got(store.read()) == latest(seen)
        if k % 2:
            assert store.compact()
            assert got(other.read()) == latest(seen)
    assert store.manifest().number == 2 and store.segments(store.manifest()) == []
    wanted = spark.createDataFrame([("a", 3), ("a", 3), ("b", 5), ("c", 1)], "name string, key long")
    seen.append(("b", 5, "new", 5000))
    store.put(spark.createDataFrame([seen[-1]], SCHEMA))
    assert got(store.lookup(wanted)) == [r for r in latest(seen) if r[:2] in {("a", 3), ("b", 5)}]
    plan = store.lookup(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    store = keyed.KeyedStore.create(spark, str(tmp_path / "s"), SCHEMA, ["name", "key"], "version", buckets=2)
    seen = rows_of(1)
    store.put(spark.createDataFrame(seen, SCHEMA))
    second = keyed.KeyedStore(spark, str(tmp_path / "s"))
    create = second._created

    def late(made):
        """While the second has written its generation, the first finishes, and a writer adds rows."""
        assert store.compact()
        store.put(spark.createDataFrame([("a", 1, "late", 9999)], SCHEMA))
        return create(made)

    monkeypatch.setattr(second, "_created", late)
    assert not second.compact()
    assert got(second.read()) == latest([*seen, ("a", 1, "late", 9999)])
    assert len(list((tmp_path / "s" / "generations").iterdir())) == 1
    (tmp_path / "s" / "manifests" / "000000000002.json").write_text('{"number": 2')  # a compaction that died
    (tmp_path / "s" / "segments" / "half").mkdir()  # a writer that died
    assert got(store.read()) == latest([*seen, ("a", 1, "late", 9999)])
    with pytest.raises(ValueError, match="version"):
        keyed.KeyedStore.create(spark, str(tmp_path / "t"), SCHEMA, ["key"], "key")


def test_a_stream_is_written_once(spark, tmp_path):
    store = keyed.KeyedStore.create(spark, str(tmp_path / "s"), SCHEMA, ["name", "key"], "version", buckets=2)
    seen = [rows_of(k, 60) for k in range(3)]
    for k, rows in enumerate(seen):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        store.upsert(stream, "in", str(tmp_path / "state")).awaitTermination()
        assert got(store.read()) == latest([r for part in seen[: k + 1] for r in part])
    store.put(spark.createDataFrame(seen[2], SCHEMA), "in-2")  # the last batch again
    store.compact()
    store.put(spark.createDataFrame(seen[2], SCHEMA), "in-2")
    assert got(store.read()) == latest([r for part in seen for r in part])
    assert store.segments(store.manifest()) == []


def test_changes_of_a_stream(spark, tmp_path):
    spark.conf.set(*upserts.PROVIDER)
    try:
        seen = [rows_of(k, 50) for k in range(3)]
        for rows in seen:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = []
        upserts.changes(stream, ["name", "key"], "version").writeStream.outputMode("update").foreachBatch(lambda batch, number: out.extend((number, *r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(upserts.PROVIDER[0])
    log = [r[1:] for r in out]
    every = [r for part in seen for r in part]
    assert {(r[0], r[1], r[3]) for r in latest(log)} == {(r[0], r[1], r[3]) for r in latest(every)}
    versions = {}
    for _, name, key, _, version in sorted(out, key=lambda r: r[0]):
        assert version > versions.get((name, key), -1)
        versions[name, key] = version
    with pytest.raises(ValueError, match="providerClass"):
        upserts.changes(stream, ["key"], "version")
