"""Exact duplicates by content sort.

Rows are dealt by sampled splitters over the first bytes of the normalised
text, then its hash, then the id, so that a large group of copies spreads over
many tasks.  Each task sorts its range on disk if need be, compares neighbours
in full and closes runs of equal texts; it holds no more than the rows of one
hash, and those of its range at most, some RANGE_BYTES.  Only runs that touch an
end of a range can go on elsewhere: these, two or so for each range, are matched
by the SHA-256 of their text.

Null texts count as empty, and all empty texts are copies of each other.  Of
rows with equal text and equal id one stays.  A null id sorts first, so it is the
one that stays.  Texts of any length are compared whole; the splitters hold no
more than PREFIX characters.  An empty table gives an empty result.  Other columns
are read with carry only, and come in a struct, so their names clash with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.shared import Workspace, ranges

PREFIX = 48
#: Bytes of text that one task sorts.
RANGE_BYTES = 128 << 20
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text):
    """Each run of ASCII white space as one space; null as ''."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; with carry, docs' own columns too, in a struct `row`."""
    spark = docs.sparkSession
    space = Workspace(spark, "exact")
    id_type = docs.schema[id_col].dataType
    row_type = docs.schema if carry else T.BooleanType()
    norm = normalised(F.col(text_col))
    # a text crosses the shuffle once: normalised, or within its row and normalised again
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("boolean")
    keyed = docs.select(F.substring(norm, 1, PREFIX).alias("p"), F.xxhash64(norm).alias("h"), F.col(id_col).alias("id"), row.alias("row"), (F.lit(None).cast("string") if carry else norm).alias("norm"))
    dealt = keyed.repartitionByRange(ranges(docs, text_col, RANGE_BYTES), "p", "h", "id")
    if carry:
        dealt = dealt.withColumn("norm", normalised(F.col("row")[text_col]))
    dealt = dealt.sortWithinPartitions("p", "h", "norm", "id").select("id", "row", F.sha2("norm", 256).alias("sha"), "p", "h", "norm")
    out = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("row", row_type),
            T.StructField("sha", T.StringType()),
            T.StructField("keep", id_type),
            T.StructField("size", T.LongType()),
            T.StructField("first", T.BooleanType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("run", T.LongType()),  # set for runs that may go on in another range
        ]
    )

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # rows of the open hash, with whether a run begins
        front = last = text = None
        number = 0

        def settled(rows: list[pa.RecordBatch], ends: bool):
            """Complete runs of the range; all of its first hash, and of its last, may go on elsewhere."""
            nonlocal number
            table = pa.Table.from_batches(rows).combine_chunks()
            begins = np.flatnonzero(table.column("begins").to_numpy())
            size = np.diff(begins, append=table.num_rows)
            of = np.repeat(np.arange(len(begins)), size)
            edge = table.column("front").to_numpy(zero_copy_only=False) | ends
            number += len(begins)
            yield from pa.table(
                [
                    *(table.column(c) for c in ("id", "row", "sha")),
                    table.column("id").take(pa.array(begins[of])),
                    pa.array(size[of]),
                    table.column("begins"),
                    pa.array(np.full(table.num_rows, part, np.int32)),
                    pa.array(number - len(begins) + of, pa.int64(), mask=~edge),
                ],
                names=out.names,
            ).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            p, h, norm = (batch.column(k) for k in (3, 4, 5))
            zone = np.ones(batch.num_rows, bool)
            zone[1:] = pc.or_(pc.not_equal(p[1:], p[:-1]), pc.not_equal(h[1:], h[:-1])).to_numpy(zero_copy_only=False)
            zone[0] = (p[0].as_py(), h[0].as_py()) != last
            begins = zone.copy()
            begins[1:] |= pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
            begins[0] |= norm[0].as_py() != text
            front = front or (p[0].as_py(), h[0].as_py())
            at_front = pc.and_(pc.equal(p, front[0]), pc.equal(h, front[1]))
            last, text = (p[-1].as_py(), h[-1].as_py()), norm[-1].as_py()
            known = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(begins), at_front], names=["id", "row", "sha", "begins", "front"])
            opens = np.flatnonzero(zone)
            if len(opens):
                cut = int(opens[-1])
                if held or cut:
                    yield from settled([*held, known.slice(0, cut)], ends=False)
                held, known = [], known.slice(cut)
            held.append(known)
        if held:
            yield from settled(held, ends=True)

    table = space.write(dealt.mapInArrow(run, out), "runs")
    # runs at the ends of ranges, two or so for each range; only their rows are joined
    edge = table.where("run IS NOT NULL AND first").select("part", "run", "sha", "size", F.col("keep").alias("id"))
    heads = edge.groupBy("sha").agg(F.min(F.struct("part", "run", "id")).alias("head"), F.sum("size").alias("total"))
    ends = edge.select("part", "run", "sha").join(heads, "sha").drop("sha")
    inside = table.where("run IS NULL").withColumns({"head": F.lit(None).cast(heads.schema["head"].dataType), "total": F.lit(None).cast("long")})
    joined = inside.unionByName(table.where("run IS NOT NULL").join(ends, ["part", "run"], "left"))
    heads = F.col("head").isNull() | ((F.col("head.part") == F.col("part")) & (F.col("head.run") == F.col("run")))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("head").isNull(), F.col("keep")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("total", "size").alias("group_size"),
        (F.col("first") & heads).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["row"] if carry else []),
    )
