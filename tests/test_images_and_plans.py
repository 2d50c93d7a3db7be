"""Images in files, and the download plan with its settings."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import downloads, rasters
from scriptorium.sources import images


def filtered(tones, kinds):
    """A PNG whose lines have the filters given, made line by line as the format says."""
    lines, above = [], np.zeros(tones.shape[1], int)
    for y, line in enumerate(tones.astype(int)):
        left = np.concatenate([[0], line[:-1]])
        corner = np.concatenate([[0], above[:-1]])
        guess = left + above - corner
        away = np.abs(np.stack([guess - left, guess - above, guess - corner]))
        near = np.choose(away.argmin(0), [left, above, corner])
        kind = kinds[y % len(kinds)]
        lines.append(bytes([kind]) + ((line - [0 * line, left, above, (left + above) // 2, near][kind]) % 256).astype(np.uint8).tobytes())
        above = line
    whole = images.write_png(tones)
    head, tail = whole[:33], whole[-12:]
    body = zlib.compress(b"".join(lines))
    return head + len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big") + tail


def test_png_and_pgm():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 300), (60, 33)):
        tones = rng.integers(0, 256, shape).astype(np.uint8)
        assert (images.read_image(images.write_png(tones)) == tones).all()
        for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
            assert (images.read_image(filtered(tones, kinds)) == tones).all()
            assert (images.read_png(filtered(tones, kinds), 3) == tones[:3]).all()
        pgm = b"P5\n# a remark\n%d %d\n255\n" % shape[::-1] + tones.tobytes()
        assert (images.read_image(pgm) == tones).all()


def test_regions_and_errors(spark):
    tones = np.arange(200, dtype=np.uint8).reshape(10, 20)
    good = images.write_png(tones)
    rows = [(1, 2, 3, 4, 5, good), (2, 15, 8, 100, 100, good), (3, -2, -2, 4, 4, good), (4, 50, 0, 5, 5, good), (5, 0, 0, 1, 1, b"GIF89a"), (6, 0, 0, 20, 10, good[:-20]), (7, 0, 0, 1, 1, None), (8, 0, 0, 5, 5, good[:40] + b"\0" + good[41:])]
    got = {r["k"]: r for r in images.regions(spark.createDataFrame(rows, "k int, x int, y int, width int, height int, content binary")).collect()}
    cut = lambda k: images.read_image(bytes(got[k]["region"]))
    assert (cut(1) == tones[3:8, 2:6]).all() and (cut(2) == tones[8:, 15:]).all() and (cut(3) == tones[:2, :2]).all()
    assert (got[2]["region_width"], got[2]["region_height"]) == (5, 2)
    assert [got[k]["region"] for k in (4, 5, 6, 7, 8)] == [None] * 5 and all(got[k]["error"] for k in (4, 5, 6, 7, 8))
    whole = rasters.pixels(images.tiles(spark.createDataFrame([(1, good)], "k int, content binary")).drop("error"), ["k"])
    assert whole.where("v = 45").select("y", "x").collect() == [(2, 5)]


MAP = "ark string, pos int, numero string, ordre int, pagination_type string"


def test_plan(spark):
    page_map = spark.createDataFrame([(a, k, str(k + 1), k + 5, "A") for a in "abc" for k in range(300)], MAP)
    wanted = spark.createDataFrame([(1, "a", ["1", "2", "250"]), (2, "b", None), (3, "c", ["3", "4"]), (4, "a", ["9", "2"]), (5, "none", ["1"]), (6, "a", ["1"])], "target int, ark string, pages array<string>")
    statuses = spark.createDataFrame([("a", 200), ("c", 451)], "ark string, status int")
    done = spark.createDataFrame([(6,)], "target int")
    rows = downloads.plan(wanted, page_map, statuses, done).orderBy("target", "block_no").collect()
    short = [(r["target"], r["mode"], r["block_no"], r["first_view"], r["views"], r["dropped"], r["out_page"]) for r in rows]
    assert short == [
        (1, "pdf", 0, 5, 100, 0, 1), (1, "pdf", 1, 105, 100, 2, 103), (1, "pdf", 2, 205, 50, 2, 203),
        (2, "pdf", 0, 1, 100, 0, 1), (2, "pdf", 1, 101, 100, 2, 103), (2, "pdf", 2, 201, 100, 2, 203),
        (3, "image", 0, 7, 1, 0, 1), (3, "image", 1, 8, 1, 0, 2),
    ]
    assert rows[0]["waits"] == [2, 4, 8, 16, 32, 64, 128]
    few = downloads.plan(wanted, page_map, statuses, done, downloads.DownloadSettings(block_size=40, fetch_only=60, suppress_cover_page=True, skip_existing=False, trials=1))
    assert [tuple(r)[3:8] for r in few.where("target = 1").orderBy("block_no").collect()] == [(0, 5, 40, 2, 1), (1, 45, 20, 2, 41)]
    assert few.where("target = 6").count() == 1 and few.agg(F.max(F.size("waits"))).first()[0] == 1
    with pytest.raises(ValueError, match="one or more"):
        downloads.DownloadSettings(trials=0)
