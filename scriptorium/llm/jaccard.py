"""Near duplicates by an exact Jaccard join of word shingles, through parity sketches.

A document's set is its distinct word shingles.  Equal sets are one node from the
start, so copies cost nothing later.  Sizes fall into bands such that sets that
can link lie in one band or in neighbouring ones.  In a band's geometry, which
its own sets and those of the band below take part in, two linked sets differ in
at most d shingles.  A hash deals shingles to d + 1 + spare(d) parts, and a part's
sketch is the XOR of its shingles' hashes: each differing shingle spoils one part
at most, so linked sets have at least 1 + spare(d) equal parts.  A set leaves its
poorest parts out, those of at most c shingles for the largest c with no more
than spare(d) of them.  Equal parts are equally rich, so of two sets' equal parts
the greater c rules out spare(d) at most, and one is left that both put forward.
That keeps sets apart that share no more than a line.  Sets that share a part
meet in a bucket, wherever the sketches' hash sends it.

A second sketch, one bit flipped for each shingle, rules pairs out: its Hamming
distance never exceeds the difference of the sets.  What it leaves is verified
with whole sets, in rounds, each for the buckets that are not in one component
yet.  First a bucket's hub, the set that is in most buckets, against the others,
by names alone, which joins groups of near copies at a cost in proportion to their
size.  Then each set outside a bucket's largest component against its nearest ones
in other components, more of them in each round, until no pair across components
is left unverified.  So no link that joins components
is lost, and pairs inside a component, which change nothing, are never listed.
A bucket of more than SLICE sets is split into pairs of slices.  Where sets meet
what is known of their bucket, one of many sets is dealt to several tasks, DEAL sets
or so to each.

Null and empty texts, and texts without words, have no shingles and link with
nothing.  Texts of fewer words than a shingle have one, the whole sequence.
Equal rows link with each other like any copies, and rows without an id link like
any others; a component without any id has null for its least id.  Shingles count
as equal when their 64-bit hashes are.  Documents with the same id but different
texts share a component only if the texts link.  Texts of any length are whole
sets.  An empty table gives an empty result; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.arrays import NOT_BLANK, Words, chunks, mix, run_hashes, tidy
from scriptorium.llm.blocks import MESSAGE, layout, messages, pack, received, runs_of, shard_of, small
from scriptorium.llm.components import components as connected
from scriptorium.llm.shared import Workspace

#: Bits of the second sketch for a set: a power of two, one for a shingle at least.
LEAST_BITS = 512
#: Pairs of which Hamming distances are held at once.
PAIRS_AT_ONCE = 1 << 21
#: Sets of a bucket that are compared in one task, at most twice as many.
SLICE = 1024
#: Sets of a bucket that a join by bucket sends to one place.
DEAL = 128
#: Rounds of verification after the first: so many of the nearest sets, at last all.
ROUNDS = (4, 32, None)
#: The most bits of the filter that keeps unneeded texts out of a shuffle; 16 MB.
FILTER_BITS = 1 << 27


def spare(d: int) -> int:
    """Parts beyond pigeonhole, of which so many may stay out."""
    return 2 + d // 8


class Bands:
    """Size bands for a threshold of `percent` hundredths."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def most(self, a: int, b: int) -> int:
        """Shingles in which linked sets of a and b shingles can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def parts(self, band: int) -> int:
        """Parts of a band's geometry; 0 where only equal sets can link."""
        self.of(self.low[band] if band < len(self.low) else 1 << 40)
        while len(self.low) < band + 2:
            self.low.append(100 * self.low[-1] // self.percent + 1)
        high = self.low[band + 1] - 1
        d = self.most(high, high)
        return d + 1 + spare(d) if d else 0

    def spared(self, band: int) -> int:
        high = self.low[band + 1] - 1
        return spare(self.most(high, high))


@lru_cache(8)
def _bands(percent: int) -> Bands:
    return Bands(percent)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of every row."""
    grams, out, rows = run_hashes(words.hash, k), [], words.rows.tolist()
    for a, b in zip(rows, rows[1:], strict=False):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix(run_hashes(words.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def node_of(s: np.ndarray) -> np.uint64:
    """A set's name."""
    return mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], np.uint64))[0]


def part_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of all sets, and the place of the set of each."""
    bands = _bands(percent)
    own = [bands.of(len(s)) for s in sets]
    jobs = [(i, g, n, bands.spared(g)) for i, band in enumerate(own) for g in (band, band + 1) if len(sets[i]) and (n := bands.parts(g))]
    if not jobs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which, geometry, count, most = (np.array(x, np.int64) for x in zip(*jobs, strict=True))
    base = np.cumsum(count) - count
    length = np.array([len(sets[i]) for i in which], np.int64)
    flat = np.concatenate([sets[i] for i in which])
    spread = mix(flat ^ np.repeat(geometry.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), length))
    part = np.repeat(base, length) + ((spread >> np.uint64(32)) * np.repeat(count, length).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(count.sum())
    value, members = np.zeros(total, np.uint64), np.bincount(part, minlength=total)
    np.bitwise_xor.at(value, part, mix(spread + np.uint64(1)))
    job = np.repeat(np.arange(len(jobs)), count)
    place = (np.arange(total) - base[job]).astype(np.uint64)
    keys = mix(value ^ mix((geometry[job].astype(np.uint64) << np.uint64(40)) + place))
    keep, poor, c = np.ones(total, bool), np.ones(len(jobs), bool), 0
    while poor.any():  # sets that may leave out their parts of at most c shingles
        few = members <= c
        poor = np.bincount(job, weights=few, minlength=len(jobs)) <= most
        keep &= ~(few & poor[job])
        c += 1
        if c > members.max(initial=0):
            break
    return keys[keep], which[job[keep]]


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit flipped for each shingle, in a power of two of bits, one for a shingle and LEAST_BITS at least."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ np.uint64(0x9FB21C651E98DF25)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def folded(drawn: list[bytes]) -> np.ndarray:
    """Sketches as rows of one size: a larger one's halves laid on each other are the smaller one's bits."""
    size = min(map(len, drawn))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0) for x in drawn])


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """id, key, n, node and sketch of each row; node and sketch are null without shingles."""

    def run(batches):
        for rows, data, offs in chunks(batches, "text"):
            sets = shingle_sets(Words(data, offs, NOT_BLANK, lower=True), shingle)
            node = [int(node_of(s).view(np.int64)) if len(s) else None for s in sets]
            drawn = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(drawn, pa.binary())], names=["id", "key", "n", "node", "sketch"])

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("key", "n", "node")), T.StructField("sketch", T.BinaryType())]))


def _sent(docs: DataFrame, shingle: int, percent: int, shards: int) -> DataFrame:
    """Messages from chunks of documents to shards: per set its name, its number of keys there, and 40 bits of each."""

    def run(batches):
        for _, data, offs in chunks(batches, "text"):
            sets = {node_of(s): s for s in shingle_sets(Words(data, offs, NOT_BLANK, lower=True), shingle) if len(s)}
            nodes = np.array(list(sets), np.uint64)
            keys, which = part_keys(list(sets.values()), percent)
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            keys, which = keys[order], which[order]
            out = []
            for s, a, b in runs_of(shard[order]):
                used, count = np.unique(which[a:b], return_counts=True)
                short = keys[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]  # what two keys share by chance is verified, too
                out.append((0, s, pack(np.ascontiguousarray(short), small(count), nodes[used])))
            yield from messages(out).to_batches()

    return docs.select("text").mapInArrow(run, MESSAGE)


def _buckets(key: tuple, table: pa.Table) -> pa.Table:
    """The distinct sets of each bucket that has several; of buckets with the same sets, one."""
    got = [x[2] for x in received(table)]
    keys = np.concatenate([np.pad(k, ((0, 0), (0, 3))).view("<u8").reshape(-1) for k, _, _ in got])
    nodes = np.concatenate([np.repeat(n, c.astype(np.int64)) for _, c, n in got])
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(keys))
    start, size = start[size > 1], size[size > 1]
    if not len(start):
        return pa.table([pa.array([], pa.list_(pa.int64()))], names=["nodes"])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(nodes))])
    _, first = np.unique(np.stack([sums[start + size] - sums[start], size.astype(np.uint64)], 1), axis=0, return_index=True)
    start, size = start[first], size[first]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = nodes[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])].view(np.int64)
    del got, keys, nodes, order, fresh, sums
    tidy()
    return pa.table([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["nodes"])


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each key in a filter."""
    keys = mix(keys.view(np.uint64))
    return [(keys >> np.uint64(s) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 12, 24, 36)]


def _filter(keys: DataFrame, number: int):
    """A Bloom filter of the column `key`, broadcast; of FILTER_BITS at most, whatever the number of keys.

    Fuller, it lets more through, and decides nothing but how much is shuffled.
    """
    bits = min(FILTER_BITS, 1 << max(16, (16 * number).bit_length()))
    step = min(bits, 1 << 20)

    def partial(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(), bits):
                held[at] = True
        for i in range(0, bits, step):
            if held[i : i + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(held[i : i + step]).tobytes()], pa.binary())], names=["at", "bits"])

    def united(key, table):
        made = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bits")])
        return pa.table([pa.array([table.column("at")[0].as_py()], pa.int64()), pa.array([made.tobytes()], pa.binary())], names=["at", "bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for r in keys.select("key").mapInArrow(partial, "at long, bits binary").groupBy("at").applyInArrow(united, "at long, bits binary").collect():
        whole[r["at"] // 8 : (r["at"] + step) // 8] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast((bits, whole))


def _sets(docs: DataFrame, shingle: int, needed) -> DataFrame:
    """node and the set (items, binary) of the rows whose key the filter lets through."""

    def run(batches):
        bits, held = needed.value
        for batch in batches:
            yes = np.ones(batch.num_rows, bool)
            for at in _places(batch.column(0).to_numpy(), bits):
                yes &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            if not yes.any():
                continue
            for _, data, offs in chunks([batch.filter(pa.array(yes))], "text"):
                sets = [s for s in shingle_sets(Words(data, offs, NOT_BLANK, lower=True), shingle) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([int(node_of(s).view(np.int64)) for s in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "items"])

    return docs.select("key", "text").mapInArrow(run, "node long, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                yes.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))
        tidy()

    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _limit(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles in which linked sets of a and b shingles can differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def _close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches do not rule out."""
    one = nodes.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y"))

    def run(batches):
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = folded([x["sketch"], y["sketch"]])
                yes.append(int(np.bitwise_count(p ^ q).sum()) <= _limit(percent, x["n"], y["n"]))
            yield batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of all rows of x to all of y."""
    out = np.zeros((len(x), len(y)), np.int32)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _proposed(percent: int, nearest: int | None):
    """Pairs of two slices' sets, in different components, that may link; null and the bucket if there were more."""

    def run(batches):
        for batch in batches:
            left, right, unasked = [], [], []
            for bucket, p, q, members in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                more = False
                members.sort(key=lambda m: m["n"])
                node, label, n, slice_ = (np.array([m[k] for m in members], np.int64) for k in ("node", "component", "n", "slice"))
                drawn = folded([m["sketch"] for m in members])
                # the largest component's sets do not ask: one end of every pair across components is in another
                kinds, back, count = np.unique(label, return_inverse=True, return_counts=True)
                asks = back != count.argmax()
                step = max(1, PAIRS_AT_ONCE // len(n))
                asking = np.flatnonzero(asks)
                for i in range(0, len(asking), step):
                    rows = asking[i : i + step]
                    low = int(np.searchsorted(n, -(-percent * n[rows[0]] // 100)))
                    high = int(np.searchsorted(n, 100 * n[rows[-1]] // percent, "right"))
                    d = distances(drawn[rows], drawn[low:high])
                    ok = (d <= _limit(percent, n[rows, None], n[None, low:high])) & (label[rows, None] != label[None, low:high])
                    if p != q:
                        ok &= slice_[rows, None] != slice_[None, low:high]
                    if nearest is not None:
                        full = np.flatnonzero(ok.sum(1) > nearest)
                        more |= len(full) > 0
                        for r in full:
                            there = np.flatnonzero(ok[r])
                            ok[r, there[np.argsort(d[r, there], kind="stable")[nearest:]]] = False
                    x, y = np.nonzero(ok)
                    left.append(node[rows[x]])
                    right.append(node[low + y])
                unasked += [bucket] * more
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (left, right))
            rest = ([None] * len(unasked), unasked)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(z, pa.int64()), pa.array(r, pa.int64())]) for z, r in zip((np.minimum(a, b), np.maximum(a, b)), rest, strict=True)], names=["a", "b"])
        tidy()

    return run


def _of_buckets(held: DataFrame, facts: DataFrame) -> DataFrame:
    """held (bucket, node, size, ...) with the facts (bucket, size, ...) of its buckets, and without what has none."""
    number = F.ceil(F.col("size") / DEAL)
    dealt = held.withColumn("slice", F.pmod(F.xxhash64("node"), number))
    copies = facts.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).drop("size")
    return dealt.join(copies, ["bucket", "slice"]).drop("slice")


def _in_slices(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """bucket, p, q and members: for every two slices of every bucket (bucket, node, component, size of the bucket) their sets."""
    number = F.ceil(F.col("size") / SLICE)
    dealt = held.withColumn("slice", F.pmod(F.xxhash64("bucket", "node"), number)).withColumn("other", F.explode(F.sequence(F.lit(0), number - 1)))
    each = dealt.select("bucket", "node", "component", "slice", F.least("slice", "other").alias("p"), F.greatest("slice", "other").alias("q"))
    return each.join(nodes.select("node", "n", "sketch"), "node").groupBy("bucket", "p", "q").agg(F.collect_list(F.struct("node", "component", "n", "sketch", "slice")).alias("members")).select("bucket", "p", "q", "members")


def components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (least id that links reach); links are sets with Jaccard >= percent / 100."""
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    _, shards = layout(given, "text")
    rows = space.write(_rows(given, shingle), "rows")
    buckets = space.write(_sent(given, shingle, percent, shards).groupBy("shard").applyInArrow(_buckets, "nodes array<long>").distinct(), "buckets")
    met = buckets.select(F.explode("nodes").alias("node")).distinct()
    # a copy of a set is as good as another; partial aggregates leave one of each before the shuffle
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "n", "sketch")).alias("one")).join(met, "node", "left_semi")
    nodes = space.write(nodes.select("node", "one.key", "one.n", "one.sketch"), "nodes")
    held = buckets.select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"), F.col("node").alias("component"), F.size("nodes").alias("size"))
    label = spark.createDataFrame([], "node long, component long")
    tried = links = spark.createDataFrame([], "a long, b long")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs; each set is fetched from one document."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        needed = space.write(nodes.select("node", "key").join(ends, "node", "left_semi"), f"needed {name}")
        few = _filter(needed, needed.count())
        sets = _sets(given, shingle, few).groupBy("node").agg(F.min("items").alias("items"))  # both sides of the pairs reuse its exchange
        found = space.write(_verified(pairs, sets, percent), f"links {name}")
        few.unpersist()
        return found

    degree = held.groupBy("node").count().select("node", F.struct("count", "node").alias("rank"))
    hubs = held.join(degree, "node").groupBy("bucket").agg(F.max("rank").alias("rank"), F.max("size").alias("size")).select("bucket", "size", F.col("rank.node").alias("hub"))
    spokes = _of_buckets(held, hubs).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    pairs = space.write(_close(spokes, nodes, percent), "pairs 0")
    for k, nearest in enumerate((0, *ROUNDS)):
        if k:
            proposed = space.write(_in_slices(held, nodes).mapInArrow(_proposed(percent, nearest), "a long, b long").distinct(), f"proposed {k}")
            pairs = space.write(proposed.where("a IS NOT NULL").join(tried, ["a", "b"], "left_anti"), f"pairs {k}")
        if not pairs.isEmpty():
            found = verified(pairs, str(k))
            tried, links = tried.unionByName(pairs), links.unionByName(found)
            if not found.isEmpty():
                joined = connected(links, space, f"round {k}")
                label = space.write(joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()), f"label {k}")
        now = held.drop("component").join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"), "size")
        mixed = now.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.max("size").alias("size")).where("p <> q").select("bucket", "size")
        if k:  # of other buckets every pair across components that sketches leave has been verified
            mixed = mixed.join(proposed.where("a IS NULL").select(F.col("b").alias("bucket")).distinct(), "bucket", "left_semi")
        held = space.write(_of_buckets(now, mixed), f"held {k}")
        if held.isEmpty():
            break
    # the least id of each set, then of each component; sets that link with none are their own
    known = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    linked = known.join(label, "node")
    final = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    ends = space.write(linked.join(final, "component").select("node", "component_id"), "ends")
    alone = known.join(label, "node", "left_anti").select("node", F.col("least").alias("component_id"))
    result = rows.select("id", "n", "node").join(ends.unionByName(alone), "node", "left")
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
