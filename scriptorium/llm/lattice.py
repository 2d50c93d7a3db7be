"""Near-duplicate vectors by lattice hashing, without a loss.

Only vectors of one label and length are compared.  Equal ones are one node from the
start.  Vectors of length 1 are turned by a random orthogonal matrix, whose rows, eight
at a time, are the random projections of as many tables.  Two vectors that link differ
by at most e = sqrt(2 - 2 least), so in one of B tables, by pigeonhole, their projections
differ by no more than e / sqrt(B).  A projection is decoded to the nearest point of a
scaled E8 lattice, and neighbouring lattice cells within half that distance are probed,
too: the midpoint of two such projections lies in a cell that both reach.  So linked
vectors always meet in a cell of one table.

A row of a table holds a cell, a node and a sketch of 16 bytes: other projections, rounded.
In a cell, nodes whose sketches could belong to linked vectors are joined; cells
of more than SLICE nodes are dealt as pairs of slices.  The components of these
joins, clusters, hold every link, and each node is in one cluster at most.  So a
vector is sent to its cluster once, or once for each pair of slices in one of more
than SLICE nodes, and every pair of a cluster is verified once, by blocks of products in
double precision: a task gives each node's number of links and a star of
its own components, never pairs.  The number of links of each member of a cluster of n
nodes takes n^2 / 2 products, which no exact method avoids; copies are not among the n.

Vectors that are null, empty or zero, or hold null or non-finite components, and
vectors without a label, link with nothing.  Vectors of different length never link.  Rows
that repeat, with or without the same id, are vectors of their own.  Null ids
are links like others; a component's id is its least id that is not null, and
a row is kept if its id is that one, null only where all are.  An empty table gives an
empty result.  Other columns are not read, so their names clash with nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.llm.arrays import mix, tidy
from scriptorium.llm.components import components as connected
from scriptorium.llm.shared import Workspace, partitions

LEAST = 0.98
#: A cell's scale, in distances that linked vectors' projections can have in their nearest table.
CELL = 2.1
#: Nodes of a cell, or of a cluster, that one task compares with each other; at most twice as many.
SLICE = 1024
#: Vectors that are decoded at once.
AT_ONCE = 512
#: Nodes of a cell up to which all cells of a batch are compared together.
FEW = 48
#: What rounding may add to a distance, and to a cosine before it is looked at again.
MARGIN, DOUBT = 1e-6, 1e-11
_SEED = 8


@lru_cache(1)
def neighbours() -> np.ndarray:
    """Points of the E8 lattice up to norm 4, the origin first: no others' cells come within 0.44 of the origin's."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) in (0, 2, 4)]
    whole += [tuple(2 * s * (k == j) for k in range(8)) for j in range(8) for s in (-1, 1)]
    halves = list(itertools.product((-0.5, 0.5), repeat=8))
    halves += [tuple(3 * x if k == j else x for k, x in enumerate(v)) for v in halves for j in range(8)]
    points = np.array([v for v in whole + halves if sum(v) % 2 == 0], float)
    return points[np.argsort((points**2).sum(1), kind="stable")]


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of D8, integers of even sum, or of D8 moved by halves."""

    def even(y):
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(1) % 2)
        j = np.abs(off[odd]).argmax(1)
        near[odd, j] += np.where(off[odd, j] < 0, -1, 1)
        return near

    one, two = even(x), even(x - 0.5) + 0.5
    return np.where((((x - one) ** 2).sum(1) <= ((x - two) ** 2).sum(1))[:, None], one, two)


def cells(x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, twice the lattice point) of every cell within `reach` of each row; some that are a little further."""
    around = neighbours()
    norm = (around**2).sum(1)
    nearest = decoded(x)
    off = x - nearest
    along = norm - 2 * (off @ around.T)  # how much further a point is than the nearest one, squared
    hit = (along <= 2 * reach * np.sqrt(norm) + MARGIN) & (along + (off**2).sum(1)[:, None] <= (1 + reach + MARGIN) ** 2)
    row, point = np.nonzero(hit)
    return row, np.rint(2 * (nearest[row] + around[point])).astype(np.int64)


def scaled_rows(rows: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1."""
    rows = scaled_rows(rows)
    return rows / np.sqrt((rows**2).sum(1))[:, None]


@lru_cache(4)
def _turn(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(_SEED).standard_normal((size, size)))[0]


def turned(unit: np.ndarray) -> np.ndarray:
    """Random orthogonal coordinates, as many as the next multiple of eight."""
    size = -(-unit.shape[1] // 8) * 8
    return np.pad(unit, ((0, 0), (0, size - unit.shape[1]))) @ _turn(size)


def table_rows(group: np.ndarray, unit: np.ndarray, least: float, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, sketch) of the cells of some vectors, table by table."""
    places = turned(unit)
    tables = places.shape[1] // 8
    most = max(math.sqrt((2 - 2 * least) / tables), MARGIN)
    scale = most * cell
    odd = mix(np.arange(1, 9, dtype=np.uint64))
    for t in range(tables):
        row, point = cells(places[:, 8 * t : 8 * t + 8] / scale, 0.5 / cell + MARGIN)
        key = mix(mix((point.view(np.uint64) * odd).sum(1, dtype=np.uint64)) ^ mix(group[row] + np.uint64(t)))
        others = [(t + 1 + k) % tables for k in range(2) if k < tables - 1] or [t]
        drawn = np.zeros((len(unit), 16), np.int8)
        for k, o in enumerate(others):
            drawn[:, 8 * k : 8 * k + 8] = np.rint(127 * np.clip(places[:, 8 * o : 8 * o + 8], -1, 1))
        yield row, key, drawn.view(np.int64)[row]


def sketch_bound(least: float) -> float:
    """The squared distance that sketches of linked vectors can have: rounding moves each of 16 numbers by 1/2."""
    return (127 * math.sqrt(2 - 2 * least) + 4 + 1e-3) ** 2


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a column of lists without nulls, for each length."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for k in range(0, len(rows), AT_ONCE):
            part = rows[k : k + AT_ONCE]
            yield part, flat[starts[part][:, None] + np.arange(d)]


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows, filled up with zeros, and their lengths."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max())))
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, size


def whole_runs(batches, keys: int) -> Iterator[pa.Table]:
    """Tables that no run of equal first columns leaves or enters, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in columns) != last
        last = tuple(c[-1] for c in columns)
        opens = np.flatnonzero(change)
        if len(opens):
            cut = int(opens[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _starts(*columns: np.ndarray) -> np.ndarray:
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(change)


def flooded(n: int, near) -> np.ndarray:
    """The first member of each one's component; near(i, rest) says which of the rest link with i."""
    label, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        label[first], todo = first, [first]
        while todo and len(rest):
            yes = near(todo.pop(), rest)
            label[rest[yes]] = first
            todo += rest[yes].tolist()
            rest = rest[~yes]
    return label


def cell_stars(start: np.ndarray, size: np.ndarray, drawn: np.ndarray, bound: float) -> np.ndarray:
    """For each row of sorted cells, a row of its cell that sketches join it with; itself, if none."""
    label = np.arange(int(size.sum()))
    few = np.repeat(size <= FEW, size)
    ends = np.repeat(start + size, size)
    ones, twos = [], []
    for k in range(1, int(size[size <= FEW].max(initial=1))):
        i = np.flatnonzero(few[: len(few) - k] & (np.arange(len(few) - k) + k < ends[: len(few) - k]))
        i = i[((drawn[i] - drawn[i + k]) ** 2).sum(1) <= bound]
        ones.append(i)
        twos.append(i + k)
    one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos))
    while len(one):
        least = np.minimum(label[one], label[two])
        moved = (label[one] != least) | (label[two] != least)
        if not moved.any():
            break
        np.minimum.at(label, one, least)
        np.minimum.at(label, two, least)
    for a, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        own = drawn[a : a + n]
        label[a : a + n] = a + flooded(n, lambda i, rest, own=own: ((own[rest] - own[i]) ** 2).sum(1) <= bound)
    return label


def _sliced(members: DataFrame, by: str, node: str = "node") -> DataFrame:
    """Members of groups, each in every pair of slices (i, j) that its own slice belongs to: one of a group of up to SLICE."""
    counted = members.withColumn("slices", F.ceil(F.count("*").over(W.partitionBy(by)) / SLICE).cast("int"))
    own = F.pmod(F.xxhash64(node), F.col("slices")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    return counted.withColumn("mine", own).withColumn("pair", F.explode(pairs)).select(*members.columns, "mine", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))


def _groups(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, component) of all nodes of links, components' least nodes among them."""
    hung = space.write(connected(links, space, name), f"{name}-groups")
    return hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())


def _clusters(nodes: DataFrame, space: Workspace, least: float, cell: float) -> DataFrame:
    """(node, component) of nodes that share a cell with one whose sketch is near."""
    spark = nodes.sparkSession

    def hashed(batches):
        for batch in batches:
            node, group = (batch.column(k).to_numpy() for k in (0, 1))
            for part, rows in vectors_of(batch.column(2)):
                for row, key, drawn in table_rows(group[part].view(np.uint64), units(rows), least, cell):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), node[part[row]], np.ascontiguousarray(drawn[:, 0]), np.ascontiguousarray(drawn[:, 1]))], names=["key", "node", "s", "t"])
        tidy()

    def joined(keys: int):
        def run(batches):
            bound = sketch_bound(least)
            for table in whole_runs(batches, keys):
                columns = [c.to_numpy() for c in table.columns]
                start = _starts(*columns[:keys])
                node, drawn = columns[keys], np.stack(columns[keys + 1 : keys + 3], 1).view(np.int8).astype(np.float32)
                star = cell_stars(start, np.diff(start, append=len(node)), drawn, bound)
                far = np.flatnonzero(star != np.arange(len(star)))
                pair = np.unique(np.stack([node[far], node[star[far]]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        return run

    rows = nodes.select("node", F.xxhash64("label", F.size("vector")).alias("group"), "vector").mapInArrow(hashed, "key long, node long, s long, t long")
    counted = rows.repartition(partitions(spark), "key").withColumn("many", F.count("*").over(W.partitionBy("key")))
    plain = counted.where(F.col("many").between(2, SLICE)).select("key", "node", "s", "t").mapInArrow(joined(1), "a long, b long")
    hot = _sliced(counted.where(F.col("many") > SLICE).select("key", "node", "s", "t"), "key").select("key", "i", "j", "node", "s", "t")
    hot = hot.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(joined(3), "a long, b long")
    return _groups(plain.unionByName(hot), space, "near")


def _linked(unit: np.ndarray, rows: np.ndarray, kind: np.ndarray, mine: np.ndarray, least: float, whole: bool) -> np.ndarray:
    """Which vectors of a run link: of equal kind, and of different slices unless the run is a whole one."""
    cosine = unit @ unit.T
    yes = cosine >= least
    for i, j in np.argwhere(np.abs(cosine - least) <= DOUBT):
        x, y = rows[i], rows[j]
        yes[i, j] = math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y)) >= least
    yes &= kind[:, None] == kind
    if not whole:
        yes &= mine[:, None] != mine
    np.fill_diagonal(yes, False)
    return yes


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, cell: float = CELL) -> DataFrame:
    """Per row: id, n_links (other rows linked with it directly), component_id (least id that links lead to) and kept (whether that is its own)."""
    if not 0 < least <= 1 or cell < 1.2:
        raise ValueError("least lies in (0, 1], and cell is 1.2 or more")
    spark, space = vectors.sparkSession, Workspace(vectors.sparkSession, "lattice")
    id_type = vectors.schema[id_col].dataType
    given = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = given.where(F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False)))
    nodes = good.groupBy("label", "vector").agg(F.count("*").alias("times"), F.min("id").alias("least"))
    nodes = space.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    clusters = _clusters(nodes, space, least, cell)

    def verified(batches):
        for table in whole_runs(batches, 3):
            columns = {c: table.column(c).to_numpy() for c in ("component", "i", "j", "mine", "node", "times")}
            kinds = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            column = table.column("vector").combine_chunks()
            start = _starts(*(columns[c] for c in ("component", "i", "j")))
            for a, n in zip(start.tolist(), np.diff(start, append=table.num_rows).tolist(), strict=True):
                flat, lengths = padded(column.slice(a, n))
                kind = kinds[a : a + n].astype(np.int64) * (int(lengths.max()) + 1) + lengths
                scaled, unit = scaled_rows(flat), units(flat)
                mine, node = columns["mine"][a : a + n], columns["node"][a : a + n]
                yes = _linked(unit, scaled, kind, mine, least, columns["i"][a] == columns["j"][a])
                links = (yes @ columns["times"][a : a + n].astype(float)).astype(np.int64)
                star = flooded(n, lambda i, rest, yes=yes: yes[i, rest])
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[star[some]])], names=["node", "links", "star"])

    dealt = _sliced(clusters.withColumnRenamed("component", "cluster"), "cluster").join(nodes.select("node", "label", "times", "vector"), "node")
    dealt = dealt.select(F.col("cluster").alias("component"), "i", "j", "mine", "node", "times", "label", "vector").repartition(partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = space.write(dealt.mapInArrow(verified, "node long, links long, star long"), "found")
    groups = _groups(found.select(F.col("node").alias("a"), F.col("star").alias("b")), space, "linked")
    ids = groups.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.join(links, "node", "left").join(groups, "node", "left").where("times > 1 OR links IS NOT NULL").join(ids, "component", "left")
    told = space.write(told.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("first", "least").alias("first")), "told")
    out = given.join(told, ["label", "vector"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("first")).cast(id_type)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
