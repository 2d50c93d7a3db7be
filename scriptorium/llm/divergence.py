"""How far the sources of each language differ in their words, by systolic rotation.

A language keeps the terms that stand in at least LEAST_DOCS of its documents.  Each
group, one source of one language, gives every kept term a smoothed share p in
thousand-millionths, and `floor((p - q)^2 / q)` says what a term adds to its
divergence from another group, or from the whole language, whose share is q.  All of it
is integer arithmetic; shares are long division in thousands, so counts may be as
large as 2^53.

Kept terms are dealt to chunks of some CHUNK_TERMS by a hash, groups to blocks of
BLOCK_GROUPS.  One task builds what one block has in one chunk: it ranks the terms
by a local heap, and leaves the block's vectors, compressed, in the shared folder.
Then blocks rotate: a task keeps a resident block and reads, round by round of a
round-robin tournament, the vectors of the block it meets, one at a time.  Two blocks
meet once in a chunk, at one of the two, which evaluates both directions; a block meets
itself at home.  Absent terms all have one share, so a meeting of two groups costs what
they hold and not what the language has.  Values of chunks are added up at last.

Null languages, sources and texts are ''.  Ids are not read, so null or repeated ones,
and rows that repeat, are documents of their own.  Texts of any length are read whole.
Equal values are ranked by their item's bytes.  Groups without terms have all their pairs;
a language that keeps no term has pairs of value 0.  An empty table gives an empty
result.  Other columns are not read, so their names clash with nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.llm.blocks import pack, small, unpack
from scriptorium.llm.shared import Workspace, file_system, partitions

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 3
TOP_TERMS = 200
CHUNK_TERMS = 1 << 13
BLOCK_GROUPS = 8
#: Different terms of all groups that a task counts before it hands them on, and bytes of text that it splits at once.
COUNT_TERMS = 400_000
PIECE_BYTES = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in pieces that end at no term's middle."""
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE_BYTES:
            cut = _BREAK.search(text, at + PIECE_BYTES)
            end = cut.start() if cut else end
        yield TERM.findall(text[at:end] if at or end < len(text) else text)
        at = end


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs (documents that hold it) of documents' rows; several rows for a term."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed():
            for (lang, source), (n, docs_with) in held.items():
                terms = list(n)
                for k in range(0, len(terms), 1 << 16):
                    part = terms[k : k + (1 << 16)]
                    size = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()), pa.array([docs_with[t] for t in part], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            held.clear()

        many = 0
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text, strict=True):
                n, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in terms_of(body.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs_with.update(own)
                many += len(n) - before
                if many > COUNT_TERMS:
                    yield from flushed()
                    many = 0
        yield from flushed()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), in three steps of long division that fit 64 bits."""
    out, rest = np.zeros(len(count), np.int64), count.astype(np.int64) + 1
    whole, rest = np.divmod(rest, total)
    out = whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def added(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    """What terms of shares p add to the divergence from shares q."""
    away = p - q
    return away * away // q


def opponents(block: int, blocks: int) -> list[int]:
    """Whom a block receives at home, in the order of rounds: half of the others or so.

    Seats stand in a circle around the last one; in each round facing seats meet.
    """
    seats = blocks + blocks % 2
    out = []
    for turn in range(seats - 1):
        if block == seats - 1:
            other = next(k for k in range(seats - 1) if 2 * k % (seats - 1) == turn)
        else:
            other = (turn - block) % (seats - 1)
            other = seats - 1 if other == block else other
        if other < blocks and (min(block, other) == block) == bool((block + other) % 2):
            out.append(other)
    return out


class Vector:
    """A group's shares of a chunk's terms."""

    def __init__(self, source: str, at: np.ndarray, count: np.ndarray, total: int):
        self.source, self.at = source, at.astype(np.int64)
        self.share = shares(count, total) if len(count) else np.zeros(0, np.int64)
        self.absent = int(shares(np.zeros(1, np.int64), total)[0]) if total else 1


def divergences(a: Vector, dense: np.ndarray, present: np.ndarray, b: Vector, size: int) -> tuple[int, int]:
    """Of a from b, and of b from a, over a chunk of `size` terms; dense and present lay a's shares out."""
    p = dense[b.at]
    common = p[present[b.at]]
    neither = size - len(a.at) - len(b.at) + len(common)
    alone, both = added(a.share, b.absent).sum() - added(common, b.absent).sum(), added(p, b.share).sum()
    one = int(both + alone) + neither * ((a.absent - b.absent) ** 2 // b.absent)
    away, gone = (b.absent - a.share) ** 2 // a.share, (b.absent - common) ** 2 // common
    two = int(added(b.share, p).sum() + away.sum() - gone.sum()) + neither * ((b.absent - a.absent) ** 2 // a.absent)
    return one, two


def _name(lang: str, chunk: int, block: int) -> str:
    return f"{hashlib.sha256(lang.encode()).hexdigest()[:40]}-{chunk}-{block}"


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file under a name of its own, then renames it: whoever else made it made the same."""
    fs, root = file_system(folder)
    own = f"{root}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as sink:
        sink.write(data)
    try:
        fs.move(own, f"{root}/{name}")
    except OSError:
        if not fs.get_file_info(f"{root}/{name}").is_file:
            raise
        fs.delete_file(own)


def _get(folder: str, name: str) -> tuple[int, list[Vector]]:
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
        size, rows = unpack(source.read())
    return size, [Vector(source, np.cumsum(steps.astype(np.int64)), count, total) for source, steps, count, total in rows]


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of the language, part `term` the `top` terms above the language's share."""
    spark = docs.sparkSession
    space = Workspace(spark, "divergence")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = space.write(_counted(given).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = space.write(kept, "terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    langs = space.write(langs.withColumn("chunks", F.ceil(F.col("terms") / chunk_terms).cast("long")), "langs")
    place = W.partitionBy("lang", "chunk").orderBy("term")
    kept = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    kept = space.write(kept.select("lang", "term", "total", "chunk", (F.row_number().over(place) - 1).alias("at")), "kept")
    space.drop("terms")
    entries = space.write(counts.join(kept, ["lang", "term"]).select("lang", "source", "chunk", "at", "n", "total"), "entries")
    space.drop("counts")
    seat = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
    groups = given.select("lang", "source").distinct()
    groups = groups.withColumn("block", F.floor(seat / block_groups)).join(entries.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").select("lang", "source", "block", F.max("block").over(W.partitionBy("lang")).alias("last"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_total", "terms", "lang_total")))
    groups = space.write(groups, "groups")
    sizes = kept.groupBy("lang", "chunk").agg(F.count("*").alias("size"))
    # every group stands in every chunk of its language, and in one at least
    seated = groups.join(sizes, "lang", "left").select("lang", F.coalesce("chunk", F.lit(0)).alias("chunk"), "block", "last", "source", "group_total", "terms", "lang_total", F.coalesce("size", F.lit(0)).alias("size"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("total"))
    filled = entries.join(groups, ["lang", "source"]).select("lang", "chunk", "block", "last", "source", "group_total", "terms", "lang_total", F.lit(None).cast("long").alias("size"), "at", "n", "total")
    folder = f"{space.path}/vectors"
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    built = T.StructType([*(T.StructField(c, T.StringType()) for c in ("lang", "source")), *(T.StructField(c, T.LongType()) for c in ("chunk", "block", "last", "at", "value"))])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        lang, chunk, block = (k.as_py() if hasattr(k, "as_py") else k for k in key)
        frame = table.select(["source", "at", "n", "total", "size", "group_total", "terms", "lang_total", "last"]).to_pandas()
        size, last = int(frame["size"].max()), int(frame["last"].iloc[0])
        rows, out = [], [(lang, None, chunk, block, last, None, None)]
        for source, own in frame.groupby("source", sort=True):
            held = own[own["at"].notna()].sort_values("at")
            at, count, whole = (held[c].to_numpy(np.int64) for c in ("at", "n", "total"))
            total = int(own["group_total"].iloc[0] + own["terms"].iloc[0])
            rows.append((source, small(np.diff(at, prepend=0)), small(count), total))
            if len(at):
                p, q = shares(count, total), shares(whole, int(own["lang_total"].iloc[0] + own["terms"].iloc[0]))
                above = p > q
                best = heapq.nsmallest(top, zip((-added(p[above], q[above])).tolist(), at[above].tolist(), strict=True))
                out += [(lang, source, chunk, block, last, place, -value) for value, place in best]
        _put(folder, _name(lang, chunk, block), pack(size, rows))
        columns = zip(*out, strict=True)
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, [pa.string()] * 2 + [pa.int64()] * 5, strict=True)], names=built.names)

    ranked = space.write(seated.unionByName(filled).groupBy("lang", "chunk", "block").applyInArrow(build, built), "built")
    residents = ranked.where("source IS NULL").select("lang", "chunk", "block", "last")
    found = T.StructType([*(T.StructField(c, T.StringType()) for c in ("lang", "source", "item")), T.StructField("value", T.LongType())])

    def meet(batches):
        for batch in batches:
            for lang, chunk, block, last in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                size, home = _get(folder, _name(lang, chunk, block))
                laid = []
                for a in home:
                    dense, present = np.full(size, a.absent, np.int64), np.zeros(size, bool)
                    dense[a.at], present[a.at] = a.share, True
                    laid.append((a, dense, present))
                for other in [block, *opponents(block, last + 1)]:
                    guests = home if other == block else _get(folder, _name(lang, chunk, other))[1]
                    rows = []
                    for k, (a, dense, present) in enumerate(laid):
                        for b in guests[k + 1 :] if other == block else guests:
                            one, two = divergences(a, dense, present, b, size)
                            rows += [(lang, a.source, b.source, one), (lang, b.source, a.source, two)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)], names=found.names)

    met = residents.repartition(partitions(spark), "lang", "chunk", "block").mapInArrow(meet, found)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    heaps = ranked.where("source IS NOT NULL").join(kept.select("lang", "chunk", "at", "term"), ["lang", "chunk", "at"])
    terms = heaps.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    out = [frame.withColumn("rank", F.row_number().over(order)).select("lang", "source", "part", "item", "value", "rank") for frame in (pairs, terms)]
    return out[0].unionByName(out[1].where(F.col("rank") <= top))
