"""Counts of a stream while it runs."""

from scriptorium.operators import report
from scriptorium.streaming import progress


def test_counts_of_a_stream(spark, tmp_path):
    rows = [(k, [True, False, None][k % 3]) for k in range(50)]
    frame = spark.createDataFrame(rows, "id long, status boolean")
    frame.repartition(5).write.parquet(str(tmp_path / "in"))
    seen, during = progress.Progress(spark, expected=100), []
    assert seen.counts() == {"total": 0, "matched": 0, "failed": 0, "unmatched": 0, "progress": 0}
    stream = progress.watched(spark.readStream.schema("id long, status boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.foreachBatch(lambda batch, number: during.append(batch.count())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen.wait(5)
    seen.close()
    want = report.status_counts(frame).first().asDict()
    assert seen.counts() == {k: want[k] for k in ("total", "matched", "failed", "unmatched")} | {"progress": 0.5}
    assert len(during) == 5 == len(seen.batches)
