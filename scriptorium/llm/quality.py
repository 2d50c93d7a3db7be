"""Quality by compression.

Two zstandard dictionaries are built, from texts labelled good and bad.  A text
is compressed with either, in independent blocks of BLOCK bytes or somewhat more,
so that it does not become its own dictionary.  The size with the bad dictionary
less that with the good one, over their sum, is large where the text is like the
good ones.  That difference of the whole text, and that of its bad blocks (the
tenth percentile over its blocks, which does not sink as texts get longer), go
through a logistic curve fitted on labelled rows that no dictionary has seen,
which gives the chance of label 1.

The fit reads at most SAMPLE labelled rows of either label, the first by a hash
of their ids, and SAMPLE_BYTES of them, each as a whole text; a score reads every whole
text and nothing but the text.  Null texts are empty, and an empty text gets the
share of label 1.  Labels that contradict each other for a document count as 0;
null labels or ids do not count.  Without labels of both kinds, every score is
the share of label 1, or 0.5 if there are none.  Rows that repeat are scored each on
its own; an empty table gives an empty result, and a fit over none the share.  A score
column replaces a column of that name; other columns come along as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.llm.arrays import column_bytes

SAMPLE = 2000
#: Bytes of text of either label that the driver holds while it fits.
SAMPLE_BYTES = 64 << 20
BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    slopes: tuple[float, float]
    intercept: float
    share: float
    block: int = BLOCK

    def sizes(self) -> Sizes:
        return Sizes(self)

    def scores(self, features: np.ndarray, empty: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(features @ np.array(self.slopes) + self.intercept)))
        return np.where(empty | (not self.good), self.share, p)


class Sizes:
    """Compressed sizes under both dictionaries; made once in a worker."""

    def __init__(self, model: CompressionClassifier):
        self.block, self.both = model.block, []
        for raw in (model.good, model.bad):
            held = zstandard.ZstdCompressionDict(raw) if raw else None
            if held:
                held.precompute_compress(level=LEVEL)
            self.both.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, text: memoryview) -> tuple[float, float]:
        """(bad - good) / (bad + good) in compressed bytes: of all blocks, and the tenth percentile of single ones."""
        good = bad = 0
        each = []
        n = max(1, len(text) // self.block)
        for i in range(n):
            part = text[i * len(text) // n : (i + 1) * len(text) // n]
            g, b = len(self.both[0].compress(part)), len(self.both[1].compress(part))
            good, bad = good + g, bad + b
            each.append((b - g) / (b + g))
        each.sort()
        at = (n - 1) / 10
        low = each[int(at)]
        return (bad - good) / (bad + good), low + (each[min(int(at) + 1, n - 1)] - low) * (at - int(at))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; texts too few or too short to train on serve as they are, whole."""
    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts).ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and intercept by Newton's method with a slight ridge on the slopes."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    design = np.column_stack([x / scale, np.ones(len(x))])
    b, ridge = np.zeros(design.shape[1]), np.array([*[1e-3] * x.shape[1], 1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge * b
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge), slope)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple((b[:-1] / scale).tolist()), float(b[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> CompressionClassifier:
    """Learn from the labelled rows that are given; keep held-out rows out of `labels`.

    Of either label, `sample` rows are read at most, in the order of a hash of their ids, and of those as many
    whole texts as have `sample_bytes` together; a text longer than that is left out.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    marks = marks.select("id", "label", F.xxhash64(F.col("id").cast("string"), F.lit(5)).alias("order"))
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    chosen = [marks.where(F.col("label") == k).orderBy("order", "id").limit(sample) for k in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 2 x sample ids at most
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = texts.join(few, "id").groupBy("id", "label", "order").agg(F.min("text").alias("text")).withColumn("bytes", F.octet_length("text").cast("long")).where(F.col("bytes") <= sample_bytes)
    so_far = F.sum("bytes").over(W.partitionBy("label").orderBy("order", "id"))
    rows = read.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).orderBy("order", "id").collect()
    by = {k: [r["text"].encode() for r in rows if r["label"] == k and r["text"]] for k in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return CompressionClassifier(b"", b"", (0.0, 0.0), 0.0, share)
    model = CompressionClassifier(_dictionary(by[1][::2]), _dictionary(by[0][::2]), (0.0, 0.0), 0.0, share)
    sizes = model.sizes()
    x, y, weight = [], [], []
    for k in (0, 1):
        rest = by[k][1::2]
        x += [sizes.features(memoryview(t)) for t in rest]
        y += [k] * len(rest)
        weight += [max(totals[k], 1) / len(rest)] * len(rest)
    w = np.array(weight)
    model.slopes, model.intercept = _logistic(np.array(x), np.array(y, float), w * (len(w) / w.sum()))
    return model


def score_documents(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column (0 to 1), which replaces one of that name."""
    kept = docs.drop(score_col)
    place = kept.columns.index(text_col)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches):
        sizes = shared.value.sizes()
        for batch in batches:
            data, offs = column_bytes(batch.column(place))
            view = memoryview(data)
            found = np.array([sizes.features(view[a:b]) for a, b in zip(offs, offs[1:], strict=False)], float).reshape(-1, 2)
            score = shared.value.scores(found, np.diff(offs) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, score_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())]))
