"""Page images as pixel tables: tone, spine, crops, geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter of an embedded image -> its format; fixed values.
IMAGE_FORMATS = {"FlateDecode": "png", "DCTDecode": "jpg", "JPXDecode": "jp2", "CCITTFaxDecode": "tiff"}
SPINE_DARK, GROW, MARGIN, BLACK = 40, 10, 40, 60
#: Page units to a pixel of a page made from an image at 100 dots an inch.
POINTS = 0.72


def image_format(image_filter: Column) -> Column:
    """Format by an image's filter; png without one."""
    return F.when(image_filter.isNull(), "png").otherwise(F.create_map(*[F.lit(x) for pair in IMAGE_FORMATS.items() for x in pair])[image_filter])


def last_image(images: DataFrame, page: list[str]) -> DataFrame:
    """A page's last image; pages without one have an error."""
    out = images.groupBy(*page).agg(F.max_by("image", "ordinal").alias("image"), F.max_by("filter", "ordinal").alias("filter"))
    return out.withColumn("format", F.when(F.col("image").isNotNull(), image_format(F.col("filter")))).withColumn("error", F.when(F.col("image").isNull(), "no image on page"))


def tone(v: Column) -> Column:
    """Darkens below 160, doubles from there on, within a byte."""
    return F.least(F.lit(255), F.when(v < 160, F.bround(v / 1.2)).otherwise(F.bround(2 * v))).cast("int")


def autocontrast(v: Column, keys: list[str]) -> Column:
    """Stretches an image's tones to 0..255."""
    w = Window.partitionBy(*keys)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high > low, F.floor((v - low) * 255 / (high - low))).otherwise(v).cast("int")


def filter_image(pixels: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Autocontrast, five bits of tone, tone curve, autocontrast."""
    first = pixels.withColumn(v, autocontrast(F.col(v), keys))
    curved = first.withColumn(v, tone(F.col(v).bitwiseAND(F.lit(0xF8))))
    return curved.withColumn(v, autocontrast(F.col(v), keys))


def deanomalised(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rounded mean of a group's values within 1.5 standard deviations; the first value if they are all equal."""
    stats = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    held = values.join(stats, keys).where((F.col("sd") == 0) | (F.abs(F.col(value) - F.col("mean")) < 1.5 * F.col("sd")))
    return held.groupBy(*keys).agg(F.bround(F.avg(value)).cast("long").alias("value"))


def binarised(pixels: DataFrame, keys: list[str], threshold: int = BLACK) -> DataFrame:
    """Black and white after autocontrast."""
    return pixels.withColumn("v", F.when(autocontrast(F.col("v"), keys) > threshold, 255).otherwise(0))


def spine(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The side (left, right) of the narrower dark-free margin on the middle rows, its width, and the crop 10 beyond it."""
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    rows = pixels.join(size, keys).where(F.array_contains(F.array(F.floor(F.col("height") / 2) - 20, F.floor(F.col("height") / 2), F.floor(F.col("height") / 2) + 20), F.col("y").cast("long")))
    dark = F.col("v") < SPINE_DARK
    edges = rows.groupBy(*keys, "width", "y").agg(F.min(F.when(dark, F.col("x"))).alias("left"), F.min(F.when(dark & (F.col("x") > 0), F.col("width") - F.col("x"))).alias("right"))
    return spine_of(edges, keys)


def spine_of(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the first dark pixels of the middle rows: keys, width, y, left, right."""
    sides = edges.select(*keys, "width", F.expr("stack(2, 'left', left, 'right', right) as (side, margin)")).where("margin is not null")
    steady = deanomalised(sides, [*keys, "width", "side"], "margin")
    nearest = steady.groupBy(*keys, "width").agg(F.min(F.struct(F.col("value"), F.col("side"))).alias("least"))
    margin = F.col("least.value")
    return nearest.select(
        *keys,
        F.col("least.side").alias("side"),
        margin.alias("margin"),
        F.when(F.col("least.side") == "left", margin + GROW).otherwise(F.lit(0)).alias("crop_left"),
        F.when(F.col("least.side") == "right", F.col("width") - margin - GROW).otherwise(F.col("width")).alias("crop_right"),
    )


def crop_bounds(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Box around what is not white, leaving out a margin and growing by 10; right and lower ends exclusive."""
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    inner = pixels.join(size, keys).where((F.col("x") >= MARGIN) & (F.col("y") >= MARGIN) & (F.col("x") < F.col("width") - MARGIN) & (F.col("y") < F.col("height") - MARGIN))
    ink = F.col("v") < 255
    box = inner.groupBy(*keys, "width", "height").agg(F.min(F.when(ink, F.col("x"))).alias("ux"), F.min(F.when(ink, F.col("y"))).alias("uy"), (F.max(F.when(ink, F.col("x"))) + 1).alias("lx"), (F.max(F.when(ink, F.col("y"))) + 1).alias("ly"))
    blank = F.col("ux").isNull()
    return box.select(
        *keys,
        F.when(blank, MARGIN).otherwise(F.col("ux")).alias("a"), F.when(blank, MARGIN).otherwise(F.col("uy")).alias("b"),
        F.when(blank, F.col("width") - MARGIN).otherwise(F.col("lx")).alias("c"), F.when(blank, F.col("height") - MARGIN).otherwise(F.col("ly")).alias("d"),
    ).select(*keys, (F.col("a") - GROW).alias("ux"), (F.col("b") - GROW).alias("uy"), (F.col("c") + GROW).alias("lx"), (F.col("d") + GROW).alias("ly"))


def row_means(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, mean) of each pixel row."""
    return pixels.groupBy(*keys, "y").agg(F.avg("v").alias("mean"))


def gradients(signal: DataFrame, keys: list[str], at: str = "y", value: str = "mean") -> DataFrame:
    """Adds `gradient`: central differences, one-sided at both ends."""
    w = Window.partitionBy(*keys).orderBy(at)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    one_sided = F.coalesce(after - F.col(value), F.col(value) - before)
    return signal.withColumn("gradient", F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).otherwise(one_sided))


def peak_limits(signal: DataFrame, keys: list[str], factor: float = 1.5) -> DataFrame:
    """Adds `high` and `low`: mean of the gradient and so many deviations above and below."""
    w = Window.partitionBy(*keys)
    mean, sd = F.avg("gradient").over(w), F.stddev_pop("gradient").over(w)
    return signal.withColumns({"high": mean + factor * sd, "low": mean - factor * sd})


def paired_peaks(signal: DataFrame, keys: list[str], offset: str, rising_first: bool) -> DataFrame:
    """Offset of the second of two peaks, 0 without both.

    Upwards a rise comes first and a fall strictly after it; downwards a fall
    comes first and a rise at the same place counts.
    """
    return signal.groupBy(*keys).agg(second_peak(offset, rising_first).alias("peak"))


def second_peak(offset: str, rising_first: bool, within: Column | None = None) -> Column:
    """paired_peaks as an aggregate, of the rows `within`: the first peak's offset, then the least beyond it, in one pass.

    Offsets of either kind of peak are few: a peak is beyond 1.5 deviations.
    """
    rise, fall = F.col("gradient") >= F.col("high"), F.col("gradient") <= F.col("low")
    here = F.lit(True) if within is None else within
    start = F.min(F.when(here & (rise if rising_first else fall), F.col(offset)))
    ends = F.array_sort(F.collect_list(F.when(here & (fall if rising_first else rise), F.col(offset))))
    later = F.filter(ends, lambda i: (i > start) if rising_first else (i >= start))
    return F.coalesce(F.get(later, F.lit(0)), F.lit(0))


def ocr_crop(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Crops around the text box of character recognition, widened to a page number close by.

    boxes: keys, upper and lower (x, y), total_width, total_height, and the
    image's width and height.  The upper point goes by the ratio of heights, the
    lower by that of widths.
    """
    return ocr_crop_of(row_means(pixels, keys), boxes, keys)


def ocr_crop_of(means: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The same from the means of rows: keys, y, mean."""
    xs, ys = F.col("height") / F.col("total_height"), F.col("width") / F.col("total_width")
    scaled = boxes.select(
        *keys,
        F.bround(F.col("upper.x") * xs).cast("int").alias("ux"), F.bround(F.col("upper.y") * xs).cast("int").alias("uy"),
        F.bround(F.col("lower.x") * ys).cast("int").alias("lx"), F.bround(F.col("lower.y") * ys).cast("int").alias("ly"),
        F.bround(F.col("height") * 0.05).cast("int").alias("band"),
    )
    signal = peak_limits(gradients(means, keys), keys).join(scaled, keys)
    above = (F.col("y") <= F.col("uy")) & (F.col("y") > F.col("uy") - F.col("band"))
    below = (F.col("y") >= F.col("ly")) & (F.col("y") < F.col("ly") + F.col("band"))
    both = signal.withColumns({"i": F.col("uy") - F.col("y"), "j": F.col("y") - F.col("ly")}).groupBy(*keys).agg(second_peak("i", True, above).alias("up"), second_peak("j", False, below).alias("down"))
    out = scaled.join(both, keys, "left").fillna(0, ["up", "down"])
    return out.select(*keys, (F.col("ux") - GROW).alias("ux"), (F.col("uy") - F.col("up") - GROW).alias("uy"), (F.col("lx") + GROW).alias("lx"), (F.col("ly") + F.col("down") + GROW).alias("ly"))


def page_scale(media_width: Column, image_width: Column) -> Column:
    """Page units to a pixel."""
    return media_width / image_width


def processed_images(pixels: DataFrame, boxes: DataFrame, keys: list[str], one_bit: Column) -> DataFrame:
    """Pixels inside each image's box, counted from its corner, with the tone filter unless the image has one bit.

    boxes: keys, ux, uy, lx, ly (right and lower ends exclusive).  What a box takes
    in beyond the image is no pixel.
    """
    inside = pixels.withColumn("one bit", F.coalesce(one_bit, F.lit(False))).join(boxes, keys).where((F.col("x") >= F.col("ux")) & (F.col("x") < F.col("lx")) & (F.col("y") >= F.col("uy")) & (F.col("y") < F.col("ly")))
    cut = inside.select(*keys, "one bit", (F.col("x") - F.col("ux")).cast("int").alias("x"), (F.col("y") - F.col("uy")).cast("int").alias("y"), F.col("v").alias("plain"), "v")
    return filter_image(cut, keys).withColumn("v", F.when(F.col("one bit"), F.col("plain")).otherwise(F.col("v"))).drop("one bit", "plain")


@dataclass(frozen=True)
class ProcessSettings:
    """How a document's pages are processed."""

    preserve_text: bool = False
    equal_size: bool = False
    skip_existing: bool = False
    has_cover_page: bool = False
    suppress_pages: tuple[int, ...] = ()


def process_plan(pages: DataFrame, settings: ProcessSettings, done: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """The pages a processed document will have, in order, and their size and place.

    pages: doc, page (from 0, covers included), media_width, media_height,
    image_width, image_height, and the crop box ux, uy, lx, ly in pixels.  Gives doc,
    out_page, page, cover, the crop box in page units with y upwards (null for covers),
    width, height, the offset that centres the page, and the scale of a cover.
    done: documents that exist already and are left alone if settings say so.
    """
    todo = pages.join(done.select(doc).distinct(), doc, "left_anti") if settings.skip_existing and done is not None else pages
    shift = 2 if settings.has_cover_page else 0
    cover = F.col("page") < shift
    held = todo.withColumn("cover", cover).where(cover | ~(F.col("page") - shift).isin([p - shift for p in settings.suppress_pages]))
    scale = page_scale(F.col("media_width"), F.col("image_width")) if settings.preserve_text else F.lit(1.0)
    tall = F.col("media_height") if settings.preserve_text else (F.col("ly") - F.col("uy")) * POINTS
    left, right = (F.col("ux") * scale, F.col("lx") * scale) if settings.preserve_text else (F.lit(0.0), (F.col("lx") - F.col("ux")) * POINTS)
    low, high = (flipped(F.col("ly") * scale, tall), flipped(F.col("uy") * scale, tall)) if settings.preserve_text else (F.lit(0.0), tall.cast("double"))
    boxed = held.withColumns({n: F.when(~F.col("cover"), c.cast("double")) for n, c in (("left", left), ("low", low), ("right", right), ("high", high))})
    sized = boxed.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("high") - F.col("low")})
    w = Window.partitionBy(doc)
    most = sized.withColumns({"max_width": F.max("width").over(w), "max_height": F.max("height").over(w)})
    centre = lambda size, most_: F.when(~F.col("cover"), equal_size_offset(F.col(size), F.col(most_)) if settings.equal_size else F.lit(0.0))
    shown = most.withColumns({
        "offset_x": centre("width", "max_width"), "offset_y": centre("height", "max_height"),
        "cover_scale": F.when(F.col("cover"), cover_scale(F.first("media_width").over(w.orderBy("page")), F.first("media_height").over(w.orderBy("page")), F.col("max_width"), F.col("max_height"))),
        "out_page": F.row_number().over(w.orderBy("page")) - 1,
    })
    return shown.select(doc, "out_page", "page", "cover", "left", "low", "right", "high", F.coalesce("width", "max_width").alias("width"), F.coalesce("height", "max_height").alias("height"), "offset_x", "offset_y", "cover_scale")


def largest_page(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Adds the greatest width and height of the document."""
    w = Window.partitionBy(*doc)
    return pages.withColumns({"max_width": F.max("width").over(w), "max_height": F.max("height").over(w)})


def equal_size_offset(width: Column, most: Column) -> Column:
    """What centres a page in the greatest size."""
    return F.greatest(F.lit(0.0), (most - width) / 2)


def cover_scale(width: Column, height: Column, max_width: Column, max_height: Column) -> Column:
    """Scale of the two cover pages."""
    return F.least(max_width / width, max_height / height)


def flipped(y: Column, height: Column) -> Column:
    """From rows counted down to rows counted up."""
    return height - y
