"""Page images as tiles: tone, bounds, spine and crops from aggregates of tiles.

A tile is a row: the image's keys, top and left, height and width, its pixels' tones as
bytes, line by line, and a bit for each that is known (null if all are).  What is asked
of an image is worked out tile by tile with numpy and then summed up: sizes, the 256
bins of its tones, sums of its lines, the box of its ink.  Aggregates cross shuffles,
before which they are combined; tiles are made once and stay where they are, but for
joins with an image's aggregates, which Spark broadcasts where they are small.

No operator here looks at a pixel's neighbours in other lines than through sums of
lines, so tiles have no margins that overlap.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.folder import file_system
from scriptorium.operators import imaging
from scriptorium.sources import images

TILE_LINES, TILE_COLUMNS = 64, 256
_PLACE = "top int, left int, height int, width int, data binary, known binary"


def tiled(lines: DataFrame, keys: list[str], lines_of_tile: int = TILE_LINES, columns_of_tile: int = TILE_COLUMNS) -> DataFrame:
    """Tiles of images given as lines: keys, y, and arrays xs and vs of places and tones."""
    kinds = lines.select(*keys).schema
    schema = T.StructType([*kinds.fields, *T.StructType.fromDDL(_PLACE).fields])
    names = [f.name for f in schema]

    def band(key: tuple, table: pa.Table) -> pa.Table:
        y = table.column("y").to_numpy()
        xs, vs = (table.column(c).combine_chunks() for c in ("xs", "vs"))
        many = np.diff(xs.offsets.to_numpy())
        x, v = (c.flatten().to_numpy(zero_copy_only=False) for c in (xs, vs))
        top = int(y.min()) // lines_of_tile * lines_of_tile
        held, known = (np.zeros((int(y.max()) + 1 - top, int(x.max(initial=-1)) + 1), k) for k in (np.uint8, bool))
        at = np.repeat(y - top, many), x
        held[at], known[at] = v, True
        own, rows = [table.column(k).combine_chunks()[:1] for k in keys], []
        for left in range(0, held.shape[1], columns_of_tile):
            part, mask = held[:, left : left + columns_of_tile], known[:, left : left + columns_of_tile]
            if mask.any():
                rows.append((top, left, *part.shape, part.tobytes(), None if mask.all() else np.packbits(mask).tobytes()))
        place = zip(*rows, strict=True) if rows else [()] * 6
        return pa.table([*(pa.concat_arrays([k] * len(rows)) if rows else k[:0] for k in own), *(pa.array(list(c), t) for c, t in zip(place, [pa.int32()] * 4 + [pa.binary()] * 2, strict=True))], names=names)

    dealt = lines.select(*keys, "y", "xs", "vs", F.floor(F.col("y") / lines_of_tile).alias("band"))
    return dealt.groupBy(*keys, "band").applyInArrow(band, schema)


def _told(tiles: DataFrame, carried: list[str], fields: str, tell: Callable[[np.ndarray, np.ndarray, dict], Iterator[tuple]]) -> DataFrame:
    """carried columns and what tell(tones, known, row) gives for each tile."""
    schema = T.StructType([*tiles.select(*carried).schema.fields, *T.StructType.fromDDL(fields).fields])
    kinds = [f.type for f in _arrow_schema(schema)]

    def run(batches):
        for batch in batches:
            out, origin = [], []
            rest = batch.drop_columns(["data", "known"]).to_pylist()
            for k, (row, data, known) in enumerate(zip(rest, batch.column("data"), batch.column("known"), strict=True)):
                shape = row["height"], row["width"]
                tones = np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)
                mask = np.ones(shape, bool) if not known.is_valid else np.unpackbits(np.frombuffer(known.as_buffer(), np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
                found = list(tell(tones, mask, row))
                out += found
                origin += [k] * len(found)
            columns = zip(*out, strict=True) if out else [()] * (len(kinds) - len(carried))
            own = [batch.column(c).take(pa.array(origin, pa.int64())) for c in carried]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), t) for c, t in zip(columns, kinds[len(carried) :], strict=True))], names=schema.names)

    return tiles.mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def sizes(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, and the least and greatest tone, `low` and `high`."""

    def tell(tones, known, row):
        held = np.argwhere(known).max(0) + 1
        yield row["left"] + int(held[1]), row["top"] + int(held[0]), int(tones[known].min()), int(tones[known].max())

    told = _told(tiles, keys, "width int, height int, low int, high int", tell)
    return told.groupBy(*keys).agg(F.max("width").alias("width"), F.max("height").alias("height"), F.min("low").alias("low"), F.max("high").alias("high"))


def histograms(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tone and n: how many pixels of the image have it."""

    def tell(tones, known, row):
        n = np.bincount(tones[known], minlength=256)
        yield from ((int(k), int(n[k])) for k in np.flatnonzero(n))

    return _told(tiles, keys, "tone int, n long", tell).groupBy(*keys, "tone").agg(F.sum("n").alias("n"))


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Autocontrast of a tone, in an image of tones from low to high."""
    return F.when(high > low, F.floor((v - low) * 255 / (high - low))).otherwise(v).cast("int")


def tables(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys and `table`: what autocontrast, five bits of tone, the tone curve and autocontrast again make of each tone."""
    ends = histogram.groupBy(*keys).agg(F.min("tone").alias("low"), F.max("tone").alias("high"))
    curved = lambda v: imaging.tone(stretch(v, F.col("low"), F.col("high")).bitwiseAND(F.lit(0xF8)))
    # the curve rises, so the ends stay ends
    again = ends.withColumns({"low2": curved(F.col("low")), "high2": curved(F.col("high"))})
    return again.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.greatest(F.lit(0), F.least(F.lit(255), stretch(curved(v), F.col("low2"), F.col("high2"))))).alias("table"))


def mapped(tiles: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles with each tone as the image's table says."""

    def tell(tones, known, row):
        yield row["top"], row["left"], row["height"], row["width"], np.array(row["table"], np.uint8)[tones].tobytes(), None if known.all() else np.packbits(known).tobytes()

    return _told(tiles.join(table, keys), keys, _PLACE, tell)


def filtered(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The tone filter of `imaging.filter_image`."""
    return mapped(tiles, tables(histograms(tiles, keys), keys), keys)


def binarised(tiles: DataFrame, keys: list[str], threshold: int = imaging.BLACK) -> DataFrame:
    """Black and white after autocontrast."""
    ends = sizes(tiles, keys)
    table = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.when(stretch(v, F.col("low"), F.col("high")) > threshold, 255).otherwise(0))
    return mapped(tiles, ends.select(*keys, table.alias("table")), keys)


def crop_bounds(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The box of `imaging.crop_bounds`."""
    margin, grow = imaging.MARGIN, imaging.GROW
    size = sizes(tiles, keys).select(*keys, F.col("width").alias("full_width"), F.col("height").alias("full_height"))

    def tell(tones, known, row):
        y, x = np.arange(row["height"]) + row["top"], np.arange(row["width"]) + row["left"]
        inner = ((y >= margin) & (y < row["full_height"] - margin))[:, None] & ((x >= margin) & (x < row["full_width"] - margin))
        inside = known & inner
        if inside.any():
            ink = np.argwhere(inside & (tones < 255))
            (b, a), (d, c) = (ink.min(0), ink.max(0)) if len(ink) else ((None, None), (None, None))
            yield tuple(None if p is None else int(p) + row[o] + e for p, o, e in ((a, "left", 0), (b, "top", 0), (c, "left", 1), (d, "top", 1)))

    told = _told(tiles.join(size, keys), [*keys, "full_width", "full_height"], "a int, b int, c int, d int", tell)
    box = told.groupBy(*keys, "full_width", "full_height").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.max("c").alias("c"), F.max("d").alias("d"))
    found = box.select(*keys, F.coalesce("a", F.lit(margin)).alias("a"), F.coalesce("b", F.lit(margin)).alias("b"), F.coalesce("c", F.col("full_width") - margin).alias("c"), F.coalesce("d", F.col("full_height") - margin).alias("d"))
    return found.select(*keys, (F.col("a") - grow).alias("ux"), (F.col("b") - grow).alias("uy"), (F.col("c") + grow).alias("lx"), (F.col("d") + grow).alias("ly"))


def line_means(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y and the mean tone of each line."""

    def tell(tones, known, row):
        n, total = known.sum(1), np.where(known, tones, 0).sum(1, dtype=np.int64)
        yield from ((row["top"] + int(k), int(total[k]), int(n[k])) for k in np.flatnonzero(n))

    told = _told(tiles, keys, "y int, total long, n long", tell)
    return told.groupBy(*keys, "y").agg((F.sum("total") / F.sum("n")).alias("mean"))


def spine(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """The spine of `imaging.spine`, from three lines of each image."""
    size = sizes(tiles, keys).select(*keys, F.col("width").alias("full_width"), F.col("height").alias("full_height"))
    middle = F.floor(F.col("full_height") / 2)
    asked = F.filter(F.array(middle - 20, middle, middle + 20), lambda y: (y >= F.col("top")) & (y < F.col("top") + F.col("height")))
    near = tiles.join(size, keys).withColumn("asked", asked).where(F.size("asked") > 0)

    def tell(tones, known, row):
        for y in row["asked"]:
            x = np.flatnonzero(known[y - row["top"]] & (tones[y - row["top"]] < imaging.SPINE_DARK)) + row["left"]
            right = x[x > 0]
            yield int(y), int(x.min()) if len(x) else None, int(row["full_width"] - right.max()) if len(right) else None

    told = _told(near, [*keys, "full_width"], "y int, left int, right int", tell)
    edges = told.groupBy(*keys, F.col("full_width").alias("width"), "y").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    return imaging.spine_of(edges, keys)


def cropped(tiles: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of what lies in a box (ux, uy, lx, ly; right and lower ends exclusive), with places from its corner."""

    def tell(tones, known, row):
        low, high = max(row["uy"] - row["top"], 0), min(row["ly"] - row["top"], row["height"])
        first, last = max(row["ux"] - row["left"], 0), min(row["lx"] - row["left"], row["width"])
        if low < high and first < last and known[low:high, first:last].any():
            mask = known[low:high, first:last]
            yield row["top"] + low - row["uy"], row["left"] + first - row["ux"], high - low, last - first, tones[low:high, first:last].tobytes(), None if mask.all() else np.packbits(mask).tobytes()

    return _told(tiles.join(boxes.select(*keys, "ux", "uy", "lx", "ly"), keys), keys, _PLACE, tell)


def processed(tiles: DataFrame, boxes: DataFrame, keys: list[str], one_bit: Column) -> DataFrame:
    """Tiles inside each image's box, with the tone filter unless the image has one bit."""
    cut = cropped(tiles, boxes, keys)
    told = tables(histograms(cut, keys), keys)
    return mapped(cut, told.withColumn("table", F.when(F.coalesce(one_bit, F.lit(False)), F.sequence(F.lit(0), F.lit(255))).otherwise(F.col("table"))), keys)


def ocr_crop(tiles: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The crop of `imaging.ocr_crop`, from sums of lines."""
    return imaging.ocr_crop_of(line_means(tiles, keys), boxes, keys)


def pixels(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """A row a pixel: keys, y, x, v."""

    def tell(tones, known, row):
        y, x = np.nonzero(known)
        yield from zip((y + row["top"]).tolist(), (x + row["left"]).tolist(), tones[y, x].tolist(), strict=True)

    return _told(tiles, keys, "y int, x int, v int", tell)


def write_images(tiles: DataFrame, name: str, folder: str) -> None:
    """Writes each image, one tile that is known throughout, as `name`.png; a task that runs again replaces its files."""

    def tell(tones, known, row):
        if row["top"] or row["left"]:
            raise ValueError("an image is one tile here")
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        own = f"{root}/.{row[name]}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own, compression=None) as sink:
            sink.write(images.write_png(np.where(known, tones, 255).astype(np.uint8)))
        fs.move(own, f"{root}/{row[name]}.png")
        yield (1,)

    _told(tiles, [name], "written int", tell).write.format("noop").mode("overwrite").save()
