"""A stored inverted index of texts, and ranked pages of what it finds.

A text's number tells its segment of SEGMENT texts and its place there.  The places
that hold a word in a segment are a block: ascending, as differences of one or two
bytes in runs of RUN, with the first place of every run beside them to skip by,
and how often each text holds the word.  A block never has more than SEGMENT places, so a word
that is everywhere is many blocks, on many tasks.  Blocks lie sorted by word, in
folders by a hash of it, so a search reads the folders of its words.

A search first looks up, without places, which segments have all words of a query; of those
it fetches the blocks.  A segment's are intersected from the rarest on: what is left is
sought in the runs that can hold it, and others are not decoded.

Words are lower-case, parted by white space.  Null texts have none.  A query without words
finds nothing.  Rows that repeat a key are texts of their own.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.folder import new_folder, written

SEGMENT = 1 << 16
RUN = 128
SHARDS = 32
_HEAD, _ONE = struct.Struct("<II"), struct.Struct("<IIHBBB")


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A block of ascending places below SEGMENT, and a count for each."""
    if len(places) == 1 and counts[0] < 256:  # most words
        return _ONE.pack(1, 1, places[0], 0, 0, counts[0])
    step = np.diff(places, prepend=places[:1])
    runs = -(-len(places) // RUN)
    step = np.concatenate([step, np.zeros(runs * RUN - len(step), step.dtype)]).reshape(runs, RUN)
    step[:, 0] = 0
    wide = step.max(1) > 255
    held = [row.astype("<u2" if w else "u1")[: len(places) - k * RUN].tobytes() for k, (row, w) in enumerate(zip(step, wide, strict=True))]
    size = 1 if counts.max() < 256 else 2 if counts.max() < 1 << 16 else 4
    return b"".join([_HEAD.pack(len(places), size), places[::RUN].astype("<u2").tobytes(), wide.astype("u1").tobytes(), *held, counts.astype(f"<u{size}").tobytes()])


class Block:
    """A block's runs, decoded where they are asked for."""

    def __init__(self, data: bytes):
        self.data = data
        self.size, width = _HEAD.unpack_from(data)
        runs = -(-self.size // RUN)
        at = _HEAD.size
        self.first = np.frombuffer(data, "<u2", runs, at).astype(np.int64)
        at += 2 * runs
        self.wide = np.frombuffer(data, "u1", runs, at).astype(np.int64)
        at += runs
        length = np.full(runs, RUN, np.int64)
        length[-1] = self.size - RUN * (runs - 1)
        self.length = length
        ends = at + np.cumsum(length * (1 + self.wide))
        self.start = ends - length * (1 + self.wide)
        self.counts = np.frombuffer(data, f"<u{width}", self.size, int(ends[-1]))
        self.decoded = 0

    def run(self, k: int) -> np.ndarray:
        self.decoded += 1
        return self.first[k] + np.cumsum(np.frombuffer(self.data, "<u2" if self.wide[k] else "u1", int(self.length[k]), int(self.start[k])), dtype=np.int64)

    def places(self) -> np.ndarray:
        return np.concatenate([self.run(k) for k in range(len(self.first))])

    def among(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending places the block has, and their counts; only runs that could have one are decoded."""
        home = np.searchsorted(self.first, wanted, "right") - 1
        yes, count = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        for k in np.unique(home[home >= 0]):
            own = np.flatnonzero(home == k) if len(wanted) < 64 else np.arange(*np.searchsorted(home, [k, k + 1]))
            held = self.run(int(k))
            at = np.minimum(np.searchsorted(held, wanted[own]), len(held) - 1)
            hit = held[at] == wanted[own]
            yes[own] = hit
            count[own[hit]] = self.counts[k * RUN + at[hit]]
        return yes, count


def intersected(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Places that all blocks have, and their counts in all of them; the rarest block leads."""
    blocks = sorted(blocks, key=lambda b: b.size)
    places, counts = blocks[0].places(), blocks[0].counts.astype(np.int64)
    for block in blocks[1:]:
        if not len(places):
            break
        yes, more = block.among(places)
        places, counts = places[yes], counts[yes] + more[yes]
    return places, counts


def words(column) -> F.Column:
    """Lower-case words, in order."""
    return F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder: texts (number, key), and blocks (word, segment, number of texts, places) by shard."""

    spark: SparkSession
    path: str
    shards: int = SHARDS

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("word string, segment long, texts long, block binary, shard int").parquet(f"{self.path}/blocks")


def build(texts: DataFrame, key: str, text: str, path: str | None = None, shards: int = SHARDS) -> TextIndex:
    """Writes the index of a table's texts to path, or to a folder that goes when the application ends."""
    spark = texts.sparkSession
    path = path or new_folder(spark, "index")
    rows = written(texts.select(F.monotonically_increasing_id().alias("number"), F.col(key).alias("key"), F.col(text).alias("text")), f"{path}/rows")
    each = rows.select("number", F.explode(words(F.col("text"))).alias("word")).groupBy("word", "number").count()
    local = F.pmod("number", F.lit(SEGMENT)).cast("int")
    placed = each.select(F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), "word", F.floor(F.col("number") / SEGMENT).alias("segment"), local.alias("place"), "count")
    # ranges split what one word has, so no task holds all of a word that is everywhere
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, "shard", "word", "segment").sortWithinPartitions("shard", "word", "segment", "place")

    def pack(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def blocks(tables: list[pa.RecordBatch]):
            table = pa.Table.from_batches(tables)
            shard, segment, place, count = (table.column(c).to_numpy() for c in ("shard", "segment", "place", "count"))
            named = table.column("word").combine_chunks().dictionary_encode()
            code = named.indices.to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (segment[1:] != segment[:-1])])) if len(code) else np.zeros(0, np.int64)
            end = [*start[1:].tolist(), len(code)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[start]), named.dictionary.take(pa.array(code[start])), pa.array(segment[start]), pa.array([b - a for a, b in zip(start.tolist(), end, strict=False)], pa.int64()), pa.array([packed(place[a:b], count[a:b]) for a, b in zip(start.tolist(), end, strict=False)], pa.binary())],
                names=["shard", "word", "segment", "texts", "block"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            segment, word = batch.column(2).to_numpy(), batch.column(1)
            change = np.zeros(batch.num_rows, bool)
            change[1:] = (segment[1:] != segment[:-1]) | pa.compute.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            change[0] = last is not None and (word[0].as_py(), int(segment[0])) != last
            last = (word[-1].as_py(), int(segment[-1]))
            opens = np.flatnonzero(change)
            if len(opens):
                cut = int(opens[-1])
                yield from blocks([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from blocks(held)

    made = dealt.mapInArrow(pack, "shard int, word string, segment long, texts long, block binary")
    made.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
    rows.select("number", "key").write.mode("overwrite").parquet(f"{path}/texts")
    return TextIndex(spark, path, shards)


def search(index: TextIndex, queries: DataFrame, query_id: str, query_text: str, first: int = 1, most: int | None = None) -> DataFrame:
    """query_id, key, hits and rank of the texts that hold every word of a query: rank first and on, `most` of them.

    hits says how often the text holds words of the query; of equal ones the lesser key comes first.
    """
    wanted = queries.select(F.col(query_id).alias("query"), F.array_distinct(words(F.col(query_text))).alias("words"))
    wanted = wanted.select("query", F.size("words").alias("number_of_words"), F.explode("words").alias("word")).withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(index.shards)).cast("int"))
    blocks = index.blocks()
    met = blocks.select("shard", "word", "segment").join(wanted, ["shard", "word"])
    whole = met.groupBy("query", "segment").agg(F.count("*").alias("n"), F.max("number_of_words").alias("number_of_words")).where("n = number_of_words").select("query", "segment")
    needed = met.join(whole, ["query", "segment"]).select("query", "segment", "shard", "word")
    fetched = needed.join(blocks.select("shard", "word", "segment", "block"), ["shard", "word", "segment"]).select("query", "segment", "block")
    kind = queries.schema[query_id].dataType
    found = T.StructType([T.StructField("query", kind), T.StructField("number", T.LongType()), T.StructField("hits", T.LongType())])

    def intersect(key: tuple, table: pa.Table) -> pa.Table:
        segment = table.column("segment")[0].as_py()
        places, counts = intersected([Block(b.as_py()) for b in table.column("block")])
        return pa.table([pa.concat_arrays([table.column("query").combine_chunks()[:1]] * len(places)) if len(places) else table.column("query").combine_chunks()[:0], pa.array(segment * SEGMENT + places), pa.array(counts)], names=found.names)

    hits = fetched.groupBy("query", "segment").applyInArrow(intersect, found).join(index.texts(), "number")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.col("hits").desc(), "key", "number")))
    page = ranked.where((F.col("rank") >= first) & (F.col("rank") < first + most if most is not None else F.lit(True)))
    return page.select(F.col("query").alias(query_id), "key", "hits", "rank")
