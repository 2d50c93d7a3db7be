import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_rows import messy_rows  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """The rows as a table with more columns, whose names clash with the operators' own."""
    names = ["id", "block", "shard", "n", "score", "row", "norm", "ids", "decoded", "items", "spans", "node", "keep_id", "n_words", "kept", "train"]
    rows = [(i, t, *[None if k % 2 else "x"] * len(names)) for k, (i, t) in enumerate(messy_rows())]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
