"""Queries that write files or tables of the driver's rows and read them back; they add to the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.folder import new_folder
from scriptorium.operators import colocated, downloads, index, keyed, matching, rasters, report, store, templates, waves
from scriptorium.functions import text
from scriptorium.plans.catalogue import ORACLES, QUERIES, _MAP, _PIXELS, _RESULTS, _WANTED, _arr, _article_tables, _page_map, _query, _results, _targets, _wanted
from scriptorium.sources import archive, bibtex, entries, images, one_file, ris
from scriptorium.streaming import progress

#: Bytes of a range: the tables are small, and a file should be cut all the same.
_SPLIT = 1 << 15


def _text(c) -> F.Column:
    return F.col(c).cast("string")


# --- files in byte ranges ----------------------------------------------------


@_query(f"SELECT p_partkey, kind, title, author, years, pages FROM ({ORACLES['bibtex_parse']})")
def bibtex_ranges(t):
    """Parts as entries of .bib files, read in byte ranges that cut entries anywhere."""
    n = F.col("p_size")
    entry = F.concat(
        F.lit("@Article{k"), _text("p_partkey"), F.lit(",\n  title = {"), _text("p_name"), F.lit(" {\\'e}},\n\n  journal = \""), _text("p_type"), F.lit("\",\n  author = {"), _text("p_brand"), F.lit("},\n  year = "), (n + 1900).cast("string"),
        F.lit(",\n  pages = {"), (n + 100).cast("string"), F.lit("--"), (n + 102).cast("string"), F.lit("}}\n"),
    )
    folder = new_folder(t("part").sparkSession, "bib")
    t("part").select(entry).write.mode("overwrite").text(f"{folder}/files")
    r = bibtex.read_bibtex(t("part").sparkSession, f"{folder}/files", suffix=".txt", splitBytes=_SPLIT)
    return r.select(F.regexp_extract("raw", r"^@Article\{k(\d+)", 1).cast("long").alias("p_partkey"), "kind", "title", "author", _arr(F.col("publicationdate")).alias("years"), F.array_join("pages", ",").alias("pages"))


@_query(f"SELECT p_partkey, kind, title, journaltitle, author, years, pages, error FROM ({ORACLES['ris_parse']})")
def ris_ranges(t):
    """Parts as entries of .ris files, read in byte ranges."""
    n = F.col("p_size")
    entry = F.concat(
        F.lit("TY  - "), F.when(F.col("p_partkey") % 5 > 0, "JOUR").otherwise("ABST"), F.lit("\nAU  - "), _text("p_brand"), F.lit("\nAU  - X, Y\nTI  - "), _text("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\nJO  - "), _text("p_type"))).otherwise(""),
        F.lit("\nT2  - T2\n\nPY  - "), (n + 1900).cast("string"), F.lit("\nSP  - "), n.cast("string"), F.lit("\nEP  - "), (n + 2).cast("string"), F.lit("\nID  - "), _text("p_partkey"), F.lit("\nER  - \n"),
    )
    folder = new_folder(t("part").sparkSession, "ris")
    t("part").select(entry).write.mode("overwrite").text(f"{folder}/files")
    r = ris.read_ris(t("part").sparkSession, f"{folder}/files", suffix=".txt", splitBytes=_SPLIT)
    return r.select(F.regexp_extract("raw", r"(?m)^ID  - (\d+)", 1).cast("long").alias("p_partkey"), "kind", "title", "journaltitle", "author", _arr(F.col("publicationdate")).alias("years"), F.array_join("pages", ",").alias("pages"), "error")


# --- a stored index ------------------------------------------------------------

_HITS = """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS held FROM documents),
o AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(held) AS word FROM d) GROUP BY ALL),
q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')) AS words FROM benchmark),
w AS (SELECT item_id, len(words) AS k, unnest(words) AS word FROM q),
h AS (SELECT item_id, doc_id, CAST(sum(n) AS BIGINT) AS hits FROM w JOIN o USING (word) GROUP BY item_id, doc_id, k HAVING count(*) = k)
"""


@_query(_HITS.format(text="text") + "SELECT item_id, doc_id, hits FROM h")
def index_search(t):
    """Documents that hold every word of a benchmark item, through an index written once."""
    made = index.build(t("documents"), "doc_id", "text")
    return index.search(made, t("benchmark"), "item_id", "text").select("item_id", F.col("key").alias("doc_id"), "hits")


@_query(_HITS.format(text="array_to_string(string_split(text, ' ')[2:3], ' ')") + "SELECT item_id, doc_id, hits, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM h) WHERE rank BETWEEN 11 AND 30")
def index_pages(t):
    """The second page of results for an item's second and third word: ranks 11 to 30, by the number of hits."""
    made = index.build(t("documents"), "doc_id", "text")
    two = t("benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("words"))
    return index.search(made, two, "item_id", "words", first=11, most=20).select("item_id", F.col("key").alias("doc_id"), "hits", "rank")


# --- tables that lie by key ------------------------------------------------------


@_query(f"""WITH m AS {_MAP}, v AS (SELECT ark, count(*) AS views, coalesce(arg_max(ordre, pos) FILTER (kind = 'A'), arg_min(ordre, pos)) AS last_pno FROM m GROUP BY ark)
SELECT o_orderkey AS ark, p_type AS journaltitle, views, last_pno, e.pos AS pos, pno, entry FROM orders JOIN part ON p_partkey = o_custkey + o_orderkey % 2 JOIN v ON ark = o_orderkey
LEFT JOIN (SELECT l_orderkey, CAST(n AS INTEGER) AS pos, CAST(l_linenumber AS VARCHAR) AS pno, p_brand || ' - ' || p_name AS entry FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) JOIN orders ON o_orderkey = l_orderkey
 JOIN part ON p_partkey = CASE WHEN l_suppkey % 2 = 0 THEN o_custkey ELSE l_partkey END WHERE l_orderkey % 3 > 0) e ON e.l_orderkey = o_orderkey""")
def issue_contents(t):
    """Issues with their metadata, page map and contents, from tables that lie by key."""
    _, _, meta, listed, page_map, _ = _article_tables(t)
    held = colocated.Archive(t("orders").sparkSession)
    for name, rows in (("meta", meta), ("page_map", page_map), ("entries", listed)):
        held.add(name, rows)
    found = colocated.issue_contents(held)
    return found.select("ark", "journaltitle", "views", "last_pno", F.col("pos").cast("int").alias("pos"), "pno", F.col("title").alias("entry"))


@_query(ORACLES["issue_year_join"])
def issues_by_year(t):
    """Issues of the years wanted, of which no other year's are read."""
    y = (F.col("c_nationkey") % 5 + 1995).cast("int")
    serials = t("customer").select("c_custkey", F.array(y, y + 2).alias("years"))
    issues = t("orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("issue_year"))
    lying = colocated.by_year(issues, "issue_year", f"{new_folder(issues.sparkSession, 'issues')}/by year")
    return colocated.issues_wanted(serials, "years", "c_custkey", lying, "o_custkey", "issue_year").select("c_custkey", "wanted", "o_orderkey")


# --- search in waves ------------------------------------------------------------


@_query(ORACLES["match_best"])
def match_waves(t):
    """The best match of every part, by a search in waves that compares titles only where letters and numbers let them be better."""
    p = t("part").select("p_partkey", "p_name", "p_size", "p_type")
    size = F.col("p_size")
    number = matching.number_score(F.col("t_number"), F.array(size, size + 1, size + 2), F.lit(False), F.lit(True))

    def bound(targets, candidates):
        """Each pair of titles is bounded once."""
        pairs = targets.join(candidates, "p_type").select("target", "pos", "t_name", "p_name", number.alias("s_number"))
        titles = pairs.select(F.col("t_name").alias("a"), F.col("p_name").alias("b")).distinct()
        most = titles.withColumn("most", text.ratio_bound(text.plain(F.col("a")), text.plain(F.col("b"))) / 100)
        met = pairs.join(most, F.col("t_name").eqNullSafe(F.col("a")) & F.col("p_name").eqNullSafe(F.col("b"))).drop("a", "b")
        return met.withColumn("bound", F.when(F.col("t_name").isNull(), F.col("s_number")).otherwise((F.col("most") + F.col("s_number")) / 2)).drop("most")

    def score(pairs, _):
        """Each pair of titles is compared once."""
        titles = pairs.select(F.col("t_name").alias("a"), F.col("p_name").alias("b")).distinct().withColumn("s_title", matching.text_score(F.col("a"), F.col("b")))
        known = pairs.join(titles, F.col("t_name").eqNullSafe(F.col("a")) & F.col("p_name").eqNullSafe(F.col("b")))
        return known.select("target", "pos", matching.mean_score({"title": F.col("s_title"), "number": F.col("s_number")}).alias("score"))

    found = waves.best(_targets(t), p.withColumn("pos", F.col("p_partkey")), "p_type", "target", "pos", score, bound=bound)
    return found.select("target", "pos", F.round("score", 6).alias("score"), (F.col("score") >= matching.DEFAULTS.minimum_confidence).alias("confident"))


# --- a report in one file --------------------------------------------------------


class _Lines(entries.Entries):
    """Every line is an entry, so its place in bytes is told."""

    opens = rb""

    @classmethod
    def name(cls) -> str:
        return "lines"


@_query(_RESULTS + r""", f AS (SELECT doc_id, E'\n  ==' || name || E'==\n\n@x\n\n' || CASE WHEN status THEN '  Processed: ' || processed || E'\n  Confidence: 72.33 %\n' ELSE E'  Failed to match :(\n' END AS entry, name FROM r)
SELECT CAST(94 + 1 + coalesce(sum(octet_length(encode(entry))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place, '  ==' || name || '==' AS line FROM f""")
def report_file(t):
    """The plain report of all results as one ordered file, read back: where each result's head line stands."""
    c, none = F.col, F.lit(None).cast("string")
    entry = report.text_entry(c("name"), F.lit("@x"), c("status"), c("processed"), none, text.confidence(F.lit(0.7233333)))
    spark = t("documents").sparkSession
    head = spark.createDataFrame([(-1, report.TEXT_HEAD)], "pos long, entry string")
    place = one_file.write_in_order(head.unionByName(_results(t).select(c("doc_id").alias("pos"), entry.alias("entry"))), "pos", "entry", f"{new_folder(spark, 'report')}/report.txt")
    lines = entries.load(spark, _Lines, place, splitBytes=_SPLIT)
    return lines.where(c("raw").startswith("  ==")).select(c("entry").alias("place"), c("raw").alias("line"))


_CARD = """{{ name|upper }} has {{ orders|length }} orders
{% for o in orders %}
{{ loop.index }}. {{ o.key }}{% if o.status == 'O' %} open{% elif o.status == 'P' %} in part{% endif %}{% if not loop.last %},{% endif %}
{% else %}
none at all
{% endfor %}
-- {{ segment|lower|default('?') }}"""


@_query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT o_custkey, count(*) AS n, string_agg(i || '. ' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN ' open' WHEN 'P' THEN ' in part' ELSE '' END || CASE WHEN i < n THEN ',' ELSE '' END || chr(10), '' ORDER BY i) AS lines FROM o GROUP BY o_custkey)
SELECT c_custkey, upper(c_name) || ' has ' || coalesce(n, 0) || ' orders' || chr(10) || coalesce(lines, 'none at all' || chr(10)) || '-- ' || lower(c_mktsegment) AS entry FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def template_cards(t):
    """A card of every customer and their orders, from a template with a loop and conditions."""
    held = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    rows = t("customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), "orders")
    return templates.rendered(rows, _CARD).select("c_custkey", "entry")


# --- download plans and images in files ----------------------------------------------


@_query(_WANTED + """, s AS (SELECT ark, min(view) FILTER (i = 1) AS a, min(view) FILTER (i = 3) AS z FROM h GROUP BY ark),
p AS (SELECT ark, a, least(z, a + 249) AS z, CASE WHEN ark % 5 = 0 THEN 'image' ELSE 'pdf' END AS mode, CASE WHEN ark % 5 = 0 THEN 1 ELSE 100 END AS size FROM s WHERE ark % 7 > 0),
b AS (SELECT *, unnest(range(a, z + 1, size)) AS first_view FROM p)
SELECT ark, mode, CAST((first_view - a) // size AS INTEGER) AS block_no, first_view, least(size, z - first_view + 1) AS views, CASE WHEN mode = 'pdf' AND first_view > a THEN 2 ELSE 0 END AS dropped, CAST(first_view - a + 1 + CASE WHEN mode = 'pdf' AND first_view > a THEN 2 ELSE 0 END AS INTEGER) AS out_page, '2,4,8,16,32,64,128' AS waits FROM b""")
def fetch_plan(t):
    """Every piece to fetch of the documents that are not there yet, and where its pages go."""
    wanted = _wanted(t).withColumn("target", F.col("ark"))
    statuses = wanted.select("ark", F.when(F.col("ark") % 5 == 0, 451).otherwise(200).alias("status"))
    found = downloads.plan(wanted, _page_map(t), statuses, wanted.where("target % 7 = 0").select("target"), downloads.DownloadSettings(fetch_only=250))
    return found.select("ark", "mode", "block_no", "first_view", "views", "dropped", "out_page", _arr(F.col("waits")).alias("waits"))


@_query(_PIXELS.replace("* 2 AS INTEGER) AS x", "AS INTEGER) AS x") + """, r AS (SELECT doc, x, y, v FROM p WHERE x >= doc % 20 AND x < doc % 20 + 30 AND y >= 15 AND y < 55)
SELECT doc, CAST(count(DISTINCT x) AS INTEGER) AS width, CAST(count(DISTINCT y) AS INTEGER) AS height, CAST(sum(v * ((y - 15) * 1000 + x - doc % 20 + 1)) AS BIGINT) AS digest FROM r GROUP BY doc""")
def image_regions(t):
    """Regions of image files: written as PNG, read by their names, cut, and read again."""
    v = F.transform("embedding", lambda e: (F.abs(F.round(F.round(e.cast("double"), 3) * 1000).cast("long")) % 256).cast("int"))
    lines = t("embeddings").select(F.floor(F.col("vec_id") / 100).alias("doc"), (F.col("vec_id") % 100).cast("int").alias("y"), F.transform("embedding", lambda _, k: k).alias("xs"), v.alias("vs"))
    folder = new_folder(lines.sparkSession, "images")
    rasters.write_images(rasters.tiled(lines, ["doc"], 128, 64), "doc", f"{folder}/files")
    files = archive.read_images(lines.sparkSession, f"{folder}/files", "*.png").withColumn("doc", F.regexp_extract("name", r"^(\d+)\.png$", 1).cast("long"))
    cut = images.regions(files.select("doc", (F.col("doc") % 20).cast("int").alias("x"), F.lit(15).alias("y"), F.lit(30).alias("width"), F.lit(40).alias("height"), "content"))
    again = images.tiles(cut.select("doc", F.col("region").alias("content"))).drop("error")
    each = rasters.pixels(again, ["doc"])
    return each.groupBy("doc").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum(F.col("v") * (F.col("y") * 1000 + F.col("x") + 1)).cast("long").alias("digest"))


# --- progress of a stream -----------------------------------------------------------


@_query(_RESULTS + "SELECT count(*) AS total, count(*) FILTER (status) AS matched, count(*) FILTER (NOT status) AS failed, count(*) FILTER (status IS NULL) AS unmatched, CAST(1 AS DOUBLE) AS progress FROM r")
def stream_counts(t):
    """What a stream of all results tells of itself, batch by batch, while it runs."""
    r = _results(t)
    spark, folder = r.sparkSession, new_folder(r.sparkSession, "results")
    r.repartition(4, "doc_id").write.mode("overwrite").parquet(f"{folder}/in")
    seen = progress.Progress(spark, r.count())
    try:
        stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = progress.watched(stream).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.wait(query.lastProgress.batchId + 1 if query.lastProgress else 0)
        counts = seen.counts()
    finally:
        seen.close()
    return spark.createDataFrame([tuple(counts.values())], "total long, matched long, failed long, unmatched long, progress double")


# --- a store that is updated -------------------------------------------------------


@_query(ORACLES["kv_latest"])
def kv_updated(t):
    """The last value of each key, put in three parts by writers of their own, compacted between."""
    e = t("events").select("user_id", "event_type", "value", "event_id")
    path = f"{new_folder(e.sparkSession, 'store')}/events"
    one, two = keyed.KeyedStore.create(e.sparkSession, path, e.schema, ["user_id", "event_type"], "event_id"), keyed.KeyedStore(e.sparkSession, path)
    for k, writer in enumerate((one, two, one)):
        writer.put(e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k))
        if k < 2:
            writer.compact()
    return two.read()


@_query("SELECT DISTINCT user_id, user_id * 2.0 AS value, (SELECT max(event_id) FROM events WHERE event_type = 'click') + 1 AS version FROM events")
def memoised_anew(t):
    """With the cache ignored every key is made, and what is made wins over what was stored."""
    e = t("events")
    log = store.named_store(e.where("event_type = 'click'").select(F.lit("ark").alias("name"), F.col("user_id").alias("key"), "value", F.col("event_id").alias("version")), "ark")
    wanted = e.select(F.col("user_id").alias("key")).distinct()
    _, rows = store.memoised(wanted, log, "key", "value", "version", lambda w: w.select("key", (F.col("key") * 2.0).alias("value")), ignore=True)
    held = store.latest(store.put(log, rows), ["key"], "version")
    return wanted.join(held, "key").select(F.col("key").alias("user_id"), "value", "version")


__all__ = ["QUERIES", "ORACLES"]
