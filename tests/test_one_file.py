"""One ordered file: whole, in order, once, and nothing beside it."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import one_file


def test_parts_in_order(spark, tmp_path):
    rng = random.Random(1)
    texts = [(k, rng.choice(["", None, f"line {k}\n", "é" * rng.randint(0, 300) + "\n"])) for k in range(3000)]
    rng.shuffle(texts)
    rows = spark.createDataFrame(texts, "pos long, value string").repartition(6)
    path = tmp_path / "report.txt"
    one_file.write_in_order(rows, "pos", "value", str(path))
    assert path.read_text() == "".join(t or "" for _, t in sorted(texts, key=lambda x: x[0]))
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.txt"]
    one_file.write_in_order(rows.limit(0), "pos", "value", str(path))
    assert path.read_text() == ""
    with pytest.raises(Exception, match="FileExistsError|exists"):
        one_file.write_in_order(rows, "pos", "value", str(path), mode="append")
    assert path.read_text() == ""


def test_a_task_that_fails_leaves_no_trace(spark, tmp_path):
    path = tmp_path / "report.txt"
    path.write_text("old")
    rows = spark.range(100).select(F.col("id").alias("pos"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").alias("value"))
    with pytest.raises(Exception, match="no"):
        one_file.write_in_order(rows, "pos", "value", str(path))
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["report.txt"]


def test_of_two_attempts_one_counts(tmp_path):
    writer = one_file._Writer({"path": str(tmp_path / "f")}, True)
    fs, root = one_file.file_system(writer.parts)
    fs.create_dir(root)
    for name, text in (("1-a", b"second "), ("1-b", b"second "), ("0-a", b"first "), ("2-a", b"half of wh")):
        with fs.open_output_stream(f"{root}/{name}") as sink:
            sink.write(text)
    writer.commit([one_file.Part(1, "1-b", 7), None, one_file.Part(0, "0-a", 6)])
    assert (tmp_path / "f").read_text() == "first second " and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError, match="strings"):
        one_file.OneText({"path": "x"}).writer(__import__("pyspark").sql.types.StructType(), True)
