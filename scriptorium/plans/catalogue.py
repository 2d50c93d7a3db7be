"""Queries over the driver's tables, one or more for each operator, and SQL with the same results.

The tables stand in for bibliographic ones: parts are titles with a publisher and
a number, orders are issues with dates, line items are pages, vectors are pixel
rows.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import ark, either, fuzzy, ranges, text
from scriptorium.operators import articles, imaging, matching, pages, rasters, report, store
from scriptorium.sources import archive, bibtex, markup, ris

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _arr(c, sep: str = ",") -> F.Column:
    return F.array_join(c.cast("array<string>"), sep)


# --- text -----------------------------------------------------------------


@_query()
def normalize_text(t):
    """Every document's normal form, null texts and those beyond ASCII included; SQL has no NFKD, so it is tested against unicodedata."""
    return t("documents").select("doc_id", text.plain(F.col("text")).alias("plain"))


_STEPS = """steps AS (SELECT a, b, list_reduce(list_prepend([0 for _ in range(0, length(b) + 1)], list_transform(range(1, length(a) + 1), lambda i: [i])),
 lambda above, i: list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [j])),
  lambda got, j: list_append(got, CASE WHEN substr(a, i[1], 1) = substr(b, j[1], 1) THEN above[j[1]] + 1 ELSE greatest(above[j[1] + 1], got[j[1]]) END))) AS last FROM c)
"""


@_query("""WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part), c AS (SELECT DISTINCT a, b FROM p WHERE b IS NOT NULL),
""" + _STEPS + "SELECT p_partkey, p.a AS a, p.b AS b, CAST(CASE WHEN p.b IS NULL THEN 0 ELSE round_even(200.0 * last[-1] / (length(p.a) + length(p.b)), 0) END AS INTEGER) AS ratio FROM p LEFT JOIN steps ON p.a = steps.a AND p.b = steps.b")
def name_similarity(t):
    following = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return t("part").select("p_partkey", F.col("p_name").alias("a"), following.alias("b")).withColumn("ratio", text.ratio(F.col("a"), F.col("b")))


@_query("""WITH p AS (SELECT p_partkey, p_name || ' ' || lower(p_type) AS a, p_name || ' ' || p_brand AS b FROM part), c AS (SELECT DISTINCT a, b FROM p),
""" + _STEPS + "SELECT p_partkey, CAST(round_even(200.0 * last[-1] / (length(p.a) + length(p.b)), 0) AS INTEGER) AS ratio FROM p JOIN steps ON p.a = steps.a AND p.b = steps.b")
def name_similarity_native(t):
    a, b = F.concat("p_name", F.lit(" "), F.lower("p_type")), F.concat("p_name", F.lit(" "), F.col("p_brand"))
    return t("part").select("p_partkey", text.ratio_native(a, b).alias("ratio"))


_PAIRS = "WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT a.p_name AS a, b.p_name AS b FROM n a, n b), " + _STEPS


@_query("SELECT s_suppkey, s_name || ' (' || n_name || ')' AS long_name, substr(s_name, 1, 4) || ' (' || substr(n_name, 1, 4) || ')' AS short_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def record_names(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return s.select("s_suppkey", text.name(F.col("s_name"), F.col("n_name")).alias("long_name"), text.name(F.col("s_name"), F.col("n_name"), 4).alias("short_name"))


_REPR = """'Article(publicationdate=' || CAST(1900 + p_size AS VARCHAR) || ', publisher=''' || p_brand || ''', ark=None, title=''' || p_name || ''', subtitle=None, journaltitle=''' || p_type
 || ''', pages=[''' || CAST(p_size AS VARCHAR) || ''', ''' || CAST(p_size + 1 AS VARCHAR) || '''], author=''' || p_brand || ''', editor=None, number=None, volume=' || CAST(p_size AS VARCHAR) || ', physical_pages=None)'"""


def _part_article() -> dict:
    c = F.col
    return {
        "publicationdate": F.array(c("p_size") + 1900), "publisher": c("p_brand"), "title": c("p_name"), "journaltitle": c("p_type"), "author": c("p_brand"),
        "pages": F.array(c("p_size").cast("string"), (c("p_size") + 1).cast("string")), "volume": F.array(c("p_size")), "number": F.lit(None).cast("array<int>"),
    }


@_query(f"SELECT p_partkey, sha1({_REPR}) AS record_key FROM part")
def record_key(t):
    return t("part").select("p_partkey", text.key(text.article_repr(_part_article())).alias("record_key"))


@_query(r"""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
SELECT p_partkey, slug || CASE WHEN n = 1 THEN '' ELSE '-' || CAST(n - 1 AS VARCHAR) END || '.pdf' AS filename FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)""")
def slug_filenames(t):
    named = t("part").select("p_partkey", text.slug(text.name(F.col("p_name"), F.col("p_brand"))).alias("slug"))
    return report.numbered_names(named, "slug", "p_partkey", ".pdf").select("p_partkey", "filename")


@_query(r"""WITH s AS (SELECT s_suppkey, regexp_replace(lower(substr(s_name, 1, 14)), '[^a-z0-9]+', '-', 'g') AS stem FROM supplier)
SELECT s_suppkey, stem || CASE WHEN n = 1 THEN '' ELSE '-' || CAST(n - 2 AS VARCHAR) END || '.pdf' AS filename FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY s_suppkey) AS n FROM s)""")
def stem_filenames(t):
    named = t("supplier").select("s_suppkey", text.slug(F.substring("s_name", 1, 14)).alias("stem"))
    return report.numbered_names(named, "stem", "s_suppkey", ".pdf", first_number=0).select("s_suppkey", "filename")


@_query(r"""WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS item FROM pages),
e AS (SELECT page_id, item || '. - ' || item || '. x' AS line FROM li WHERE item <> '')
SELECT page_id, line, trim(regexp_extract(line, '(.+?)\.* - (.+)', 1), ' ') AS author, trim(regexp_extract(line, '(.+?)\.* - (.+)', 2), ' ') AS title, count(*) AS n FROM e GROUP BY ALL""")
def toc_entry_split(t):
    items = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), 1)).alias("item")).where("item <> ''")
    lines = items.select("page_id", F.concat("item", F.lit(". - "), "item", F.lit(". x")).alias("line"))
    author, title = text.toc_entry(F.col("line"))
    return lines.select("page_id", "line", author.alias("author"), title.alias("title")).groupBy("page_id", "line", "author", "title").agg(F.count("*").alias("n"))


# --- ranges ---------------------------------------------------------------


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(100 + p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN array_to_string(range(100 + p_size, 100 + p_size + p_size % 7 + 1), ',')
 ELSE array_to_string(range(540 + p_size % 10, 551), ',') END AS expanded FROM part""")
def range_expand_bib(t):
    c, s = F.col("p_size"), lambda x: x.cast("string")
    shown = F.when(F.col("p_partkey") % 3 == 0, s(c + 100)).when(F.col("p_partkey") % 3 == 1, F.concat(s(c + 100), F.lit("--"), s(c + 100 + c % 7))).otherwise(F.concat(s(c % 10 + 540), F.lit("-50")))
    return t("part").select("p_partkey", F.array_join(ranges.bib_pages(shown), ",").alias("expanded"))


@_query("SELECT p_partkey, array_to_string(list_concat(range(1130 + p_size % 10, 1158), [p_size]), ',') AS expanded FROM part")
def range_deprettify(t):
    c = F.col("p_size")
    return t("part").select("p_partkey", _arr(ranges.deprettify(F.concat((c % 10 + 1130).cast("string"), F.lit("--57, "), c.cast("string")))).alias("expanded"))


@_query("""WITH k AS (SELECT o_custkey, CAST(o_orderkey % 100 AS INTEGER) AS p FROM orders GROUP BY ALL),
r AS (SELECT o_custkey, min(p) AS a, max(p) AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS isle FROM k) GROUP BY o_custkey, isle),
q AS (SELECT *, CAST(a AS VARCHAR) AS s, CAST(b AS VARCHAR) AS e FROM r)
SELECT o_custkey, string_agg(s || '--' || CASE WHEN length(s) = length(e) THEN array_to_string(list_transform(range(1, length(e) + 1), lambda i: CASE WHEN substr(e, i, 1) <> substr(s, i, 1) THEN substr(e, i, 1) ELSE '' END), '') ELSE e END, ', ' ORDER BY a) AS pages
FROM q GROUP BY o_custkey""")
def range_prettify(t):
    by = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set((F.col("o_orderkey") % 100).cast("int"))).alias("p"))
    return by.select("o_custkey", ranges.pretty_pages(F.col("p").cast("array<string>")).alias("pages"))


_ROMAN_SQL = "['','i','ii','iii','iv','v','vi','vii','viii','ix']"


@_query(f"""SELECT p_size, ['','x','xx','xxx','xl','l'][p_size // 10 + 1] || {_ROMAN_SQL}[p_size % 10 + 1] AS roman, p_size AS back, count(*) AS n FROM part WHERE p_size BETWEEN 1 AND 59 GROUP BY p_size""")
def roman_roundtrip(t):
    sizes = t("part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("roman", ranges.to_roman(F.col("p_size")))
    return sizes.where("p_size between 1 and 59").select("p_size", "roman", ranges.from_roman(F.upper("roman")).alias("back"), "n")


@_query("""WITH d AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderkey % 40 AS INTEGER) AS v, CAST(o_custkey % 9 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(y AS VARCHAR) ELSE y || ',' || (y + 1) END AS years, CAST(v AS VARCHAR) AS volume,
 CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 9 = 0 THEN CAST(n AS VARCHAR) ELSE array_to_string(range(n, n + 3), ',') END AS numbers, o_orderkey % 2 = 1 AS year_is_list
FROM d JOIN orders USING (o_orderkey)""".replace(" OR o_custkey % 9 = 0", ""))
def describe_parse(t):
    y, v, n = F.year("o_orderdate"), F.col("o_orderkey") % 40, F.col("o_custkey") % 9
    one = lambda y, n: F.concat(y.cast("string"), F.lit("/10 (A4,T"), v.cast("string"), F.lit(",N"), n.cast("string"), F.lit(")"))
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.concat(one(y, n), F.lit("."))).otherwise(F.concat(one(y, n), F.lit("-"), one(y + 1, n + 2), F.lit(".")))
    got = ranges.describe(shown)
    return t("orders").select("o_orderkey", _arr(got["year"]).alias("years"), _arr(got["volume"]).alias("volume"), _arr(got["number"]).alias("numbers"), got["year_is_list"].alias("year_is_list"))


@_query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN array_to_string(list_concat([y], range(y + 3, y + 7)), ',') WHEN 1 THEN CAST(y AS VARCHAR) WHEN 2 THEN CAST(y + 1 AS VARCHAR) END AS years
FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)""")
def date_list_years(t):
    y = lambda k: (F.year("o_orderdate") + k).cast("string")
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.concat(y(0), F.lit(","), y(3), F.lit("-"), y(6))).when(k == 1, F.concat(y(2), F.lit(","), y(0), F.lit("-"))).when(k == 2, F.concat(F.lit("-"), y(1))).otherwise("1-2-3")
    return t("orders").select("o_orderkey", _arr(ranges.catalogue_years(shown)).alias("years"))


# --- keys and addresses ----------------------------------------------------


@_query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '12148' END AS naan, CASE WHEN doc_id % 3 < 2 THEN 'bpt6k' || doc_id END AS name, CASE WHEN doc_id % 3 = 1 THEN 'date' END AS qualifier,
 CASE WHEN doc_id % 3 = 0 THEN 'ark' WHEN doc_id % 3 = 1 THEN 'https' END AS scheme, CASE WHEN doc_id % 3 = 1 THEN 'arks.example.org' END AS authority,
 CASE WHEN doc_id % 3 = 0 THEN 'ark:/12148/bpt6k' || doc_id WHEN doc_id % 3 = 1 THEN 'https://arks.example.org/ark:/12148/bpt6k' || doc_id || '/date' END AS back, doc_id % 3 = 2 AS failed FROM documents""")
def ark_parse(t):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    shown = F.when(k == 0, F.concat(F.lit("ark:/12148/bpt6k"), i)).when(k == 1, F.concat(F.lit("https://arks.example.org/ark:/12148/bpt6k"), i, F.lit("/date"))).otherwise(F.concat(F.lit("ark:/12148#"), i))
    p = t("documents").select("doc_id", ark.parse_ark(shown).alias("a"))
    c = F.col("a")
    return p.select("doc_id", "a.naan", "a.name", "a.qualifier", "a.scheme", "a.authority", ark.ark_text(c).alias("back"), F.col("a.error").isNotNull().alias("failed"))


@_query("""SELECT p_partkey, 'https://arks.example.org/ark:/12148/p' || p_partkey || '.search?query=' || replace(replace(p_name, ' ', '+'), '#', '%23') || '&publisher=' || replace(p_brand, '#', '%23') AS url FROM part""")
def build_url(t):
    a = F.struct(F.lit("https").alias("scheme"), F.lit("arks.example.org").alias("authority"), F.lit("12148").alias("naan"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("qualifier"))
    return t("part").select("p_partkey", ark.service_url(a, "search", {"query": F.col("p_name"), "publisher": F.col("p_brand"), "page": F.lit(None).cast("string")}).alias("url"))


@_query("""WITH p AS (SELECT page_id, 'p' || page_id || CASE WHEN page_id % 5 = 0 THEN '/' ELSE '' END AS name, page_id % 3 AS k FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'bad name' WHEN k = 1 THEN 'a scheme needs an authority' END AS error, CASE WHEN page_id % 5 = 0 THEN 'bad name' END AS copy_error, CASE WHEN k = 2 THEN 'https://x.org/' WHEN k = 1 THEN 'https://y.org/' ELSE '' END || 'ark:/12148/' || name || CASE WHEN k = 0 THEN '' ELSE '/f1' END AS copied FROM p""")
def ark_parts(t):
    p = t("pages").select("page_id", (F.col("page_id") % 3).alias("k"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, "/").otherwise("")).alias("name"))
    made = p.withColumn("a", ark.make_ark(F.lit("12148"), F.col("name"), scheme=F.when(F.col("k") == 0, "ark").otherwise("https"), authority=F.when(F.col("k") == 2, "x.org")))
    copied = ark.ark_with(F.col("a"), qualifier=F.when(F.col("k") > 0, "f1"), authority=F.when(F.col("k") == 1, "y.org").otherwise(F.col("a.authority")))
    return made.select("page_id", "a.error", copied["error"].alias("copy_error"), ark.ark_text(copied).alias("copied"))


# --- search and matching -----------------------------------------------------


@_query("""SELECT p_partkey, 'bib.publicationdate all "' || (1900 + p_size) || '" and bib.publisher all "' || p_brand || '" and bib.title all "' || p_type || '" and bib.recordtype all "per"' AS query FROM part""")
def search_string(t):
    p = t("part").select("p_partkey", F.lit("article").alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("journaltitle"), F.col("p_brand").alias("publisher"), F.lit("x").alias("editor"), (F.col("p_size") + 1900).cast("string").alias("publicationdate"))
    r = matching.translated(matching.source_of(p))
    fields = {"publicationdate": F.col("publicationdate"), "publisher": F.col("publisher"), "title": F.col("title"), "recordtype": F.lit(matching.RECORD_TYPES["journal"])}
    return r.select("p_partkey", matching.search_string(fields).alias("query"))


@_query("""WITH q AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, list_sort(list_distinct(string_split(p_name, ' '))) AS words FROM q)
SELECT w.p_name AS query, p.p_partkey FROM w JOIN part p ON list_has_all(string_split(p.p_name || ' ' || lower(p.p_type), ' '), w.words)""")
def token_search(t):
    p = t("part").withColumn("held", F.concat("p_name", F.lit(" "), "p_type"))
    return matching.token_search(p.select(F.col("p_name").alias("query")).distinct().withColumn("words", F.col("query")), "query", "words", p, "p_partkey", "held")


@_query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS words FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS held FROM documents)
SELECT item_id, doc_id FROM w JOIN d ON list_has_all(held, words) WHERE len(words) > 0""")
def fulltext_words(t):
    return matching.token_search(t("benchmark").select("item_id", "text"), "item_id", "text", t("documents"), "doc_id", "text")


@_query("""WITH q AS (SELECT DISTINCT p_name, p_brand FROM part)
SELECT q.p_name || '/' || q.p_brand AS query, p.p_partkey FROM q JOIN part p ON list_has_all(string_split(lower(p.p_name || ' ' || p.p_type), ' '), string_split(lower(q.p_name), ' ')) AND lower(p.p_brand) = lower(q.p_brand)""")
def field_search(t):
    p = t("part").withColumn("held", F.concat("p_name", F.lit(" "), "p_type"))
    q = p.select(F.concat("p_name", F.lit("/"), "p_brand").alias("query"), "p_name", "p_brand").distinct()
    return matching.field_search(q, "query", p, "p_partkey", {"title": ("p_name", "held"), "publisher": ("p_brand", "p_brand"), "p_type": ("p_name", "p_type")})


_SCORED = _PAIRS + """, r AS (SELECT a, b, round_even(200.0 * last[-1] / (length(a) + length(b)), 0) / 100 AS s FROM steps),
m AS (SELECT t.p_partkey AS target, c.p_partkey AS pos, CAST(CASE WHEN list_contains(range(c.p_size, c.p_size + 3), t.p_size) THEN 1 ELSE 0 END AS DOUBLE) AS s_number, CASE WHEN t.p_brand = c.p_brand THEN 1.0 ELSE NULL END AS same_brand, r.s AS s_title, t.p_type AS t_type, c.p_type AS c_type, t.p_name, c.p_brand, t.p_brand AS t_brand
 FROM part t JOIN part c ON c.p_type = t.p_type JOIN r ON r.a = t.p_name AND r.b = c.p_name)
, g AS (SELECT target, pos, s_title, s_number, (s_title + s_number) / 2 AS score FROM m)
"""


def _scored(t, first: int | None = None):
    """Every part as target, against all parts of its type, or the first of them in the order of keys.

    The parts of a type are candidates of all its parts, in one order, so a search
    that gives up after so many never sees those beyond.  A part without a type has none.
    """
    targets, p = _targets(t), t("part").select("p_partkey", "p_name", "p_size", "p_type")
    return _of_pairs(targets, p if first is None else matching.first_of_block(p, "p_type", "p_partkey", first))


def _targets(t):
    return t("part").select("p_type", F.col("p_partkey").alias("target"), F.col("p_name").alias("t_name"), F.array("p_size").alias("t_number"))


def _of_pairs(targets, held):
    """target, pos and scores of all pairs of a type; a title is compared once with each other title of its type."""
    met = targets.select("p_type", "t_name").distinct().join(held.select("p_type", F.col("p_name").alias("c_name")).distinct(), "p_type")
    titles = met.select("t_name", "c_name").distinct().withColumn("s_title", matching.text_score(F.col("t_name"), F.col("c_name")))
    known = met.alias("m").join(titles.alias("x"), F.col("m.t_name").eqNullSafe(F.col("x.t_name")) & F.col("m.c_name").eqNullSafe(F.col("x.c_name"))).select("m.*", "x.s_title")
    named = targets.alias("t").join(known.alias("k"), (F.col("t.p_type") == F.col("k.p_type")) & F.col("t.t_name").eqNullSafe(F.col("k.t_name"))).select("t.*", "k.c_name", "k.s_title")
    named = named.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target")  # few bytes here, which one task would take, make very many pairs
    pairs = named.alias("n").join(held.alias("h"), (F.col("n.p_type") == F.col("h.p_type")) & F.col("n.c_name").eqNullSafe(F.col("h.p_name"))).select("n.target", "n.t_number", "n.s_title", "h.p_partkey", "h.p_size")
    scores, n_scored = _field_scores(F.col("s_title"), F.col("t_number"), F.col("p_size"))
    return pairs.select("target", F.col("p_partkey").alias("pos"), "s_title", scores["number"].alias("s_number"), matching.mean_score(scores).alias("score"), n_scored.alias("n_scored"))


def _field_scores(s_title, t_number, size):
    """Scores by field of a pair of parts, and how many there are."""
    scores = {"title": s_title, "number": matching.number_score(t_number, F.array(size, size + 1, size + 2), F.lit(False), F.lit(True))}
    return scores, _scored_fields(scores)


def _scored_fields(scores):
    return reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in scores.values()])


@_query(_SCORED + "SELECT target, pos, s_title, s_number, round(score, 6) AS score, CAST(2 AS INTEGER) AS n_scored FROM g")
def match_scores(t):
    """Every part as target, against all parts of its type; means are worked out once a pair of names, numbers once a pair of sizes, and pairs of parts are spread out last."""
    met = matching.cells_of_pairs(t("part"), "p_type", "p_partkey", "p_name", "p_size", lambda size: F.array(size), lambda size: F.array(size, size + 1, size + 2))
    titled = met.select(matching.text_score(F.col("t_name"), F.col("c_name")).alias("s_title"), "t_held", "c_held")
    means = F.array(*[F.struct(F.round(matching.mean_score(s), 6).alias("score"), _scored_fields(s).alias("n")) for n in matching.ONE_IN_LIST for s in [{"title": F.col("s_title"), "number": F.lit(n).cast("double")}]])
    sized = titled.withColumn("means", means).withColumn("t", F.explode("t_held")).drop("t_held").withColumn("c", F.explode("c_held")).drop("c_held")
    numbered = sized.withColumn("s_number", matching.number_score(F.col("t.value"), F.col("c.value"), F.lit(False), F.lit(True)))
    # their places in ONE_IN_LIST
    mean = F.get("means", F.coalesce((F.col("s_number") * 2).cast("int") + 1, F.lit(0)))
    scored = numbered.select("s_title", "s_number", mean["score"].alias("score"), mean["n"].alias("n_scored"), F.col("t.keys").alias("t_keys"), F.col("c.keys").alias("c_keys"))
    each = scored.withColumn("target", F.explode("t_keys")).drop("t_keys").withColumn("pos", F.explode("c_keys"))
    return each.select("target", "pos", "s_title", "s_number", "score", "n_scored")


_SEEN = """, k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS seen FROM g), h AS (SELECT *, max(score) OVER (PARTITION BY target ORDER BY pos) AS top FROM k WHERE seen < 50),
e AS (SELECT h.* FROM h LEFT JOIN (SELECT target, min(seen) AS stop FROM h WHERE seen >= 4 AND top > 0.7 GROUP BY target) x USING (target) WHERE stop IS NULL OR seen <= stop)
"""


@_query(_SCORED + _SEEN + "SELECT target, pos, round(score, 6) AS score, score >= 0.5 AS confident FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, pos) AS n FROM e) WHERE n = 1")
def match_best(t):
    best = matching.best_match(_scored(t, matching.DEFAULTS.give_up), "target", "pos")
    return best.select("target", "pos", F.round("score", 6).alias("score"), (F.col("score") >= matching.DEFAULTS.minimum_confidence).alias("confident"))


@_query(_SCORED + _SEEN + "SELECT target, pos, seen FROM e")
def early_exit(t):
    return matching.early_exit(_scored(t, matching.DEFAULTS.give_up), "target", "pos").select("target", "pos", F.col("seen").cast("long").alias("seen"))


@_query("""WITH s AS (SELECT o_custkey AS target, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS issue, o_orderkey AS pos, round(o_totalprice / 500000, 4) AS score FROM orders),
o AS (SELECT target, issue, max(best) OVER (PARTITION BY target ORDER BY issue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT target, issue, max(score) AS best FROM s GROUP BY ALL)),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.target ORDER BY score DESC, s.issue, pos) AS rank FROM s JOIN o ON s.target = o.target AND s.issue = o.issue WHERE before IS NULL OR before <= 0.7)
SELECT target, issue, pos, score, rank FROM r WHERE rank <= 5 AND score >= 0.5""")
def article_topk(t):
    s = t("orders").select(F.col("o_custkey").alias("target"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("issue"), F.col("o_orderkey").alias("pos"), F.round(F.col("o_totalprice") / 500000, 4).alias("score"))
    return matching.confident(matching.article_candidates(s, "target", "issue", "pos")).select("target", "issue", "pos", "score", F.col("rank").cast("long").alias("rank"))


@_query("""WITH c AS (SELECT c_custkey, CAST(1995 + c_nationkey % 5 AS INTEGER) AS y FROM customer), w AS (SELECT DISTINCT c_custkey, unnest(list_distinct([y - 1, y, y + 1, y + 1, y + 2, y + 3])) AS wanted FROM c)
SELECT c_custkey, wanted, o_orderkey FROM w JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = wanted""")
def issue_year_join(t):
    y = (F.col("c_nationkey") % 5 + 1995).cast("int")
    serials = t("customer").select("c_custkey", F.array(y, y + 2).alias("years"))
    issues = t("orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("issue_year"))
    return matching.possible_issues(serials, "years", "c_custkey", issues, "o_custkey", "issue_year").select("c_custkey", "wanted", "o_orderkey")


@_query("""SELECT doc_id, CAST(quality AS VARCHAR) AS found, 'toc' AS via FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, lang AS found, 'ocr' AS via FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def toc_fallback(t):
    toc = t("documents").select("doc_id").join(t("labels").select("doc_id", F.col("quality").cast("string").alias("found")), "doc_id").withColumn("via", F.lit("toc"))
    return matching.with_fallback(toc, t("documents").select("doc_id", F.col("lang").alias("found"), F.lit("ocr").alias("via")), "doc_id")


@_query("""WITH r AS (SELECT o_custkey AS target, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
a AS (SELECT r.*, row_number() OVER (PARTITION BY target ORDER BY rank) AS n FROM r WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT target, o_orderkey, rank FROM a WHERE n = 1""")
def availability_semi(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = t("orders").select(F.col("o_custkey").alias("target"), "o_orderkey", F.row_number().over(w).cast("long").alias("rank"))
    return matching.first_available(ranked, t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "target")


@_query("""WITH k(kind) AS (VALUES ('article'), ('journal'), ('book'), ('collection'))
SELECT a.kind AS target_kind, b.kind AS source_kind, n_nationkey, CASE WHEN a.kind <> 'article' OR b.kind IN ('book', 'collection') THEN 'unable to match a ' || a.kind || ' in a ' || b.kind END AS error FROM nation, k a, k b""")
def supported_pairs(t):
    kinds = F.array(*map(F.lit, ("article", "journal", "book", "collection")))
    return matching.supported(t("nation").select("n_nationkey", F.explode(kinds).alias("target_kind")).withColumn("source_kind", F.explode(kinds))).select("target_kind", "source_kind", "n_nationkey", "error")


@_query("""SELECT s_suppkey, 'ark:/1/' || s_suppkey AS ark, s_name AS journaltitle, n_name AS publisher, CASE WHEN s_suppkey % 4 = 0 THEN '1919,1920' ELSE '1919' END AS years FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 > 0""")
def catalogue_journals(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "monographie imprimée").otherwise("publication en série imprimée")
    raw = s.select(
        F.col("s_suppkey").alias("pos"), F.array(F.concat(F.lit("ark:/1/"), F.col("s_suppkey").cast("string")), F.lit("x")).alias("identifier"), F.array("s_name").alias("title"), F.array("n_name", F.lit("y")).alias("publisher"),
        F.when(F.col("s_suppkey") % 4 == 0, "1919-1920").otherwise("1919").alias("date"), F.array(F.lit("fre"), F.lit("français")).alias("language"), F.array(F.struct(F.lit("fre").alias("lang"), kind.alias("text"))).alias("type"),
    )
    good, _ = matching.catalogue_journals(raw)
    return good.select(F.col("pos").alias("s_suppkey"), "ark", "journaltitle", "publisher", _arr(F.col("publicationdate")).alias("years"))


# --- pages -----------------------------------------------------------------

_MAP = "(SELECT l_orderkey AS ark, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos, CAST(l_linenumber AS VARCHAR) AS numero, l_partkey AS ordre, l_returnflag AS kind FROM lineitem)"


def _numbered_lines(t):
    """Line items with their place in their order.  The flag parts ties, so all that read the lines read the same columns, and Spark deals them out once."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag").withColumn("pos", F.row_number().over(order))


def _page_map(t):
    return _numbered_lines(t).select(F.col("l_orderkey").alias("ark"), "pos", F.col("l_linenumber").cast("string").alias("numero"), F.col("l_partkey").alias("ordre"), F.col("l_returnflag").alias("pagination_type"))


@_query(f"""WITH m AS {_MAP}, h AS (SELECT ark, arg_min(ordre, pos) FILTER (numero = CAST(ark % 7 + 1 AS VARCHAR)) AS hit, arg_max(ordre, pos) AS last, arg_max(ordre, pos) FILTER (kind = 'A') AS a, arg_min(ordre, pos) AS first FROM m GROUP BY ark)
SELECT ark, coalesce(hit, last) AS ordre, coalesce(a, first) AS last_pno FROM h""")
def page_lookup(t):
    m = _page_map(t)
    wanted = pages.last_page(m).withColumn("pno", (F.col("ark") % 7 + 1).cast("string"))
    return pages.physical_pages(wanted, m).select("ark", "ordre", "last_pno")


@_query(f"""WITH m AS {_MAP}, l AS (SELECT ark, coalesce(arg_max(ordre, pos) FILTER (kind = 'A'), arg_min(ordre, pos)) AS last_pno FROM m GROUP BY ark),
n AS (SELECT ark, pos, CAST(numero AS BIGINT) AS start, lead(CAST(numero AS BIGINT)) OVER (PARTITION BY ark ORDER BY CAST(numero AS BIGINT), pos) - 1 AS nxt FROM m WHERE numero = CAST(ark % 7 + 1 AS VARCHAR))
SELECT ark, pos, CAST(greatest(0, coalesce(nxt, last_pno) - start + 1) AS BIGINT) AS n_pages, CASE WHEN coalesce(nxt, last_pno) >= start THEN coalesce(nxt, last_pno) END AS last_page FROM n JOIN l USING (ark)""")
def toc_end_pages(t):
    m = _page_map(t)
    entries = m.select("ark", "pos", F.col("numero").alias("pno"), F.lit("A. B. - C").alias("title"))
    found = pages.toc_articles(entries, pages.last_page(m), (F.col("ark") % 7 + 1).cast("string"), "ark")
    n = F.greatest(F.lit(0), F.col("last_page") - F.col("first_page") + 1).cast("long")
    return found.select("ark", "pos", n.alias("n_pages"), F.when(n > 0, F.col("last_page")).alias("last_page"))


_WANTED = "WITH m AS " + _MAP + """, w AS (SELECT DISTINCT ark, [CAST(ark % 7 + 1 AS VARCHAR), '99', '1'] AS want FROM m),
h AS (SELECT ark, i, coalesce(arg_min(ordre, pos) FILTER (numero = want[i]), arg_max(ordre, pos)) AS view FROM m JOIN w USING (ark), range(1, 4) r(i) GROUP BY ark, i)"""


def _wanted(t):
    return t("lineitem").select(F.col("l_orderkey").alias("ark")).distinct().withColumn("pages", F.array((F.col("ark") % 7 + 1).cast("string"), F.lit("99"), F.lit("1")))


@_query(_WANTED + " SELECT ark, array_to_string(list(view ORDER BY i), ',') AS views FROM h GROUP BY ark")
def desired_views(t):
    return articles.desired_views(_wanted(t).withColumn("target", F.col("ark")), _page_map(t)).select("ark", _arr(F.col("views")).alias("views"))


@_query(_WANTED + ", n AS (SELECT ark, CAST(count(*) AS INTEGER) AS last_view FROM m GROUP BY ark) SELECT h.ark AS ark, min(view) FILTER (i = 1) AS start_p, min(view) FILTER (i = 3) AS end_p, 1 AS first_view, min(last_view) AS last_view FROM h JOIN n USING (ark) GROUP BY h.ark")
def view_spans(t):
    m = _page_map(t)
    whole = articles.all_views(m).withColumnsRenamed({"start_p": "first_view", "end_p": "last_view"})
    return articles.view_span(_wanted(t), m).join(whole, "ark").select("ark", "start_p", "end_p", "first_view", "last_view")


@_query("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS ordre, l_returnflag AS text FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 2 + 1 + l_orderkey % 3")
def content_slice(t):
    text_ = t("lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("ordre"), F.col("l_returnflag").alias("text"))
    return pages.content_slice(text_, 2, F.col("l_orderkey") % 3 + 1)


def _article_tables(t):
    """Customers look for an article; their orders are a journal's issues, whose lines are contents, page map and page texts.

    A customer's article is named after a part, its author after the part's brand and its journal
    after the type.  Every other line is about the customer's part, the rest about their own.  An
    issue whose key three divides has no contents.
    """
    nulls = {"publisher": "string", "number": "array<int>"}
    y = lambda k: (F.col(k) % 5 + 1995).cast("int")
    part, o = t("part"), t("orders")
    named = t("customer").join(part.hint("merge"), F.col("c_custkey") == F.col("p_partkey"))
    targets = named.select(
        F.col("c_custkey").alias("target"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("journaltitle"), F.array(F.lit("2"), F.lit("3")).alias("pages"), F.array(y("c_nationkey")).alias("publicationdate"),
        F.lit(False).alias("publicationdate_is_list"), F.array((F.col("c_custkey") % 4).cast("int")).alias("volume"), F.lit(False).alias("volume_is_list"), F.lit(False).alias("number_is_list"), *[F.lit(None).cast(k).alias(c) for c, k in nulls.items()],
    )
    wanted = o.select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("ark"), F.col("o_orderkey").alias("issue")).join(targets.select("target").hint("merge"), "target", "left_semi")
    said = F.concat(F.year("o_orderdate").cast("string"), F.lit("/10 (A4,T"), (F.col("o_orderkey") % 4).cast("string"), F.lit(")."))
    journal = part.select(F.col("p_partkey").alias("about"), F.col("p_type").alias("journaltitle")).hint("merge")
    meta = o.withColumn("about", F.col("o_custkey") + F.col("o_orderkey") % 2).join(journal, "about").select(F.col("o_orderkey").alias("ark"), "journaltitle", F.array(F.lit("x"), said).alias("description"))
    lines = _numbered_lines(t)
    about = F.when(F.col("l_suppkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("l_partkey"))
    lines = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").hint("merge"), "l_orderkey").join(part.select(F.col("p_partkey").alias("about"), "p_name", "p_brand").hint("merge"), about == F.col("about"))
    # with the place in them, this condition and that of texts stay above the numbering of lines, which is shared
    entries = lines.where(F.when(F.col("l_orderkey") % 3 > 0, F.col("pos")) > 0).select(F.col("l_orderkey").alias("ark"), "pos", F.col("l_linenumber").cast("string").alias("pno"), F.concat("p_brand", F.lit(" - "), "p_name").alias("title"))
    said = F.concat(F.lit("<p>...</p> "), F.translate("p_name", "e", "w"), F.lit("\n par "), F.replace(F.upper("p_brand"), F.lit("ND#1"), F.lit("N#1")))
    texts = lines.where("pos > 0").select(F.col("l_orderkey").alias("ark"), F.col("l_partkey").alias("ordre"), said.alias("text"))
    return targets, wanted, meta, entries, _page_map(t), texts


_WORDS = "(SELECT 1 AS k, lower(p_name) AS w FROM part UNION SELECT 2, lower(p_brand) FROM part UNION SELECT 3, lower(p_type) FROM part)"
_LIKENESS = f"c AS (SELECT x.w AS a, y.w AS b FROM {_WORDS} x JOIN {_WORDS} y USING (k)), " + _STEPS + ", r AS (SELECT a AS i, b AS j, round_even(200.0 * last[-1] / (length(a) + length(b)), 0) / 100 AS s FROM steps)"
_ISSUES = f"""m AS {_MAP},
t AS (SELECT c_custkey, c_nationkey, lower(p_name) AS ti, lower(p_brand) AS au, lower(p_type) AS jo FROM customer JOIN part ON p_partkey = c_custkey),
n AS (SELECT li.*, lower(p_name) AS ti, lower(p_brand) AS au FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem) li JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = CASE WHEN l_suppkey % 2 = 0 THEN o_custkey ELSE l_partkey END)"""


@_query(f"WITH {_LIKENESS}, {_ISSUES}" + """,
l AS (SELECT ark, coalesce(arg_max(ordre, pos) FILTER (kind = 'A'), arg_min(ordre, pos)) AS last_pno FROM m GROUP BY ark),
e AS (SELECT l_orderkey AS ark, pos, l_linenumber AS pno, au, ti FROM n WHERE l_orderkey % 3 > 0),
f AS (SELECT e.*, lead(pno) OVER (PARTITION BY ark ORDER BY pos) AS nxt FROM e WHERE pno = 2), g AS (SELECT f.*, CASE WHEN nxt IS NULL THEN last_pno ELSE 1 END AS last_page FROM f JOIN l USING (ark)),
k AS (SELECT c_custkey AS target, o_orderkey AS issue, pos, last_page, (CAST(CASE WHEN year(o_orderdate) = 1995 + c_nationkey % 5 THEN 1 ELSE 0 END AS DOUBLE) + rt.s + rj.s + CAST(CASE WHEN last_page >= 2 THEN 0.5 ELSE 0 END + CASE WHEN last_page >= 3 THEN 0.5 ELSE 0 END AS DOUBLE) + ra.s
 + CAST(CASE WHEN o_orderkey % 4 = 0 THEN 0.5 WHEN o_orderkey % 4 = c_custkey % 4 THEN 1 ELSE 0 END AS DOUBLE)) / 6 AS score
 FROM g JOIN orders ON o_orderkey = ark JOIN t ON c_custkey = o_custkey JOIN part j ON j.p_partkey = o_custkey + o_orderkey % 2 JOIN r rt ON rt.i = t.ti AND rt.j = g.ti JOIN r ra ON ra.i = t.au AND ra.j = g.au JOIN r rj ON rj.i = t.jo AND rj.j = lower(j.p_type)),
b AS (SELECT target, issue, max(best) OVER (PARTITION BY target ORDER BY issue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT target, issue, max(score) AS best FROM k GROUP BY ALL)),
z AS (SELECT k.*, row_number() OVER (PARTITION BY k.target ORDER BY score DESC, k.issue, pos) AS rank FROM k JOIN b ON k.target = b.target AND k.issue = b.issue WHERE before IS NULL OR before <= 0.7)
SELECT target, issue, CAST(pos AS INTEGER) AS pos, round(score, 6) AS score, rank, last_page FROM z WHERE rank <= 5 AND score >= 0.5""")
def article_contents_match(t):
    """The article each customer looks for, found in the contents of the issues."""
    targets, wanted, meta, entries, page_map, _ = _article_tables(t)
    found = articles.article_candidates(targets, wanted, meta, entries, page_map, pages.last_page(page_map))
    return found.select("target", "issue", "pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "last_page")


def _near(rows: str, key: str, needle: str, k: int) -> str:
    """Every end of a hit of at most k errors: its least distance, from the leftmost begin."""
    spans = f"SELECT {key}, {needle} AS needle, text, stop, unnest(range(greatest(1, stop - length({needle}) - {k}), greatest(1, stop - length({needle}) + {k} + 1))) AS start FROM (SELECT *, unnest(range(2, length(text) + 2)) AS stop FROM {rows})"
    return f"SELECT {key}, needle, text, stop, min({{'d': d, 's': start}}) AS h FROM (SELECT *, levenshtein(needle, substr(text, start, stop - start)) AS d FROM ({spans}) WHERE start < stop) WHERE d <= {k} GROUP BY ALL"


@_query(f"""WITH {_ISSUES},
v AS (SELECT ark, coalesce(arg_min(ordre, pos) FILTER (numero = '2'), arg_max(ordre, pos)) AS one, coalesce(arg_min(ordre, pos) FILTER (numero = '3'), arg_max(ordre, pos)) AS two FROM m GROUP BY ark),
x AS (SELECT DISTINCT l_orderkey AS ark, l_partkey AS view, '<p>...</p> ' || translate(ti, 'e', 'w') || chr(10) || ' par ' || replace(au, 'nd#1', 'n#1') AS text FROM n),
w AS (SELECT c_custkey AS target, o_orderkey AS ark, ti, au, one, two FROM orders JOIN t ON c_custkey = o_custkey JOIN v ON v.ark = o_orderkey),
p AS (SELECT DISTINCT ti, text FROM w JOIN x ON x.ark = w.ark AND x.view = w.one),
q AS (SELECT DISTINCT ti, text FROM ({_near('p', 'ti', 'ti', 2)})),
y AS (SELECT DISTINCT target, w.ark AS ark, au, one, two FROM w JOIN x ON x.ark = w.ark AND x.view = w.one JOIN q ON q.ti = w.ti AND q.text = x.text),
z AS (SELECT DISTINCT target, y.ark AS ark, au, text FROM y JOIN x ON x.ark = y.ark AND x.view IN (one, two)),
a AS (SELECT DISTINCT au, text FROM z),
h AS (SELECT *, h.s >= lag(stop) OVER (PARTITION BY au, text ORDER BY stop) AS fresh FROM ({_near('a', 'au', 'au', 5)})),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY au, text ORDER BY stop) AS grp FROM h),
f AS (SELECT au, text, substr(text, h.s, stop - h.s) AS matched FROM g WHERE grp = 0 QUALIFY row_number() OVER (PARTITION BY au, text ORDER BY h.d, h.s - stop, stop) = 1),
c AS (SELECT DISTINCT matched AS a, au AS b FROM f), """ + _STEPS + """
SELECT DISTINCT target, ark FROM z JOIN f USING (au, text) JOIN steps ON a = matched AND b = au WHERE round_even(200.0 * last[-1] / (length(a) + length(b)), 0) > 80""")
def article_text_match(t):
    """The issues whose recognised text has the article's title and author."""
    targets, wanted, _, _, page_map, texts = _article_tables(t)
    return articles.found_in_text(wanted.join(targets, "target"), page_map, texts)


@_query()
def article_match(t):
    """The article by contents, else by recognised text, of an issue that can be had; tested against a search in Python."""
    targets, wanted, meta, entries, page_map, texts = _article_tables(t)
    found = articles.article_candidates(targets, wanted, meta, entries, page_map, pages.last_page(page_map), texts)
    there = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("ark"))
    best = matching.first_available(found, there, "ark", "target")
    return best.select("target", "issue", "pos", "via", F.round("score", 6).alias("score"), "first_view", "last_view")


@_query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS a, CAST(o_orderkey % 50 + o_custkey % 470 AS INTEGER) AS b FROM orders), e AS (SELECT *, unnest(range(a, b + 1, 100)) AS block_start FROM s)
SELECT o_orderkey, CAST((block_start - a) // 100 AS INTEGER) AS block_no, CAST(block_start AS INTEGER) AS block_start, CAST(least(100, b - block_start + 1) AS INTEGER) AS block_len FROM e""")
def block_plan(t):
    a = (F.col("o_orderkey") % 50).cast("int")
    s = t("orders").select("o_orderkey", a.alias("a"), (a + F.col("o_custkey") % 470).cast("int").alias("b"))
    return pages.block_plan(s, "a", "b").select("o_orderkey", "block_no", "block_start", "block_len")


@_query("""WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS block_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) - 1 AS j FROM lineitem),
x AS (SELECT l_orderkey, block_no - 1 AS block_no, j * 3 + unnest([0, 1, 2]) AS page_idx FROM p), k AS (SELECT * FROM x WHERE NOT (page_idx < 2 AND block_no > 0))
SELECT l_orderkey, block_no, CAST(page_idx AS INTEGER) AS page_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY block_no, page_idx) AS out_page FROM k""")
def merge_pages(t):
    j = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")) - 1
    p = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("block_no"), j.alias("j")).select("l_orderkey", "block_no", F.explode(F.sequence(F.col("j") * 3, F.col("j") * 3 + 2)).alias("page_idx"))
    return pages.merged_pages(p, "l_orderkey").select("l_orderkey", "block_no", "page_idx", F.col("out_page").cast("long").alias("out_page"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'image' ELSE 'pdf' END AS mode, least(o_custkey, o_orderkey + 9) AS end_p FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') AND o_orderkey % 7 NOT IN (1, 2)""")
def download_plan(t):
    o = t("orders")
    todo = pages.missing_outputs(o.select("o_orderkey", "o_custkey"), t("lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    kept = pages.unsuppressed(todo.withColumn("page_idx", F.col("o_orderkey") % 7), [3, 4], has_cover=True)
    return kept.select("o_orderkey", pages.fetch_mode(F.when(F.col("o_orderkey") % 5 == 0, 451).otherwise(200)).alias("mode"), pages.limited_end(F.col("o_orderkey"), F.col("o_custkey"), 10).alias("end_p"))


# --- images ----------------------------------------------------------------


@_query("""WITH s AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS value FROM lineitem JOIN s USING (l_returnflag, l_linestatus) WHERE d = 0 OR abs(l_quantity - m) < 1.5 * d GROUP BY ALL""")
def deanomalise(t):
    return imaging.deanomalised(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag", "l_linestatus"], "l_quantity")


_SIGNAL = """WITH s AS (SELECT vec_id, unnest(range(0, len(embedding))) AS y, CAST(round(unnest(embedding)::DOUBLE, 3) * 1000 AS BIGINT)::DOUBLE AS mean FROM embeddings),
g AS (SELECT *, CASE WHEN b IS NULL THEN a - mean WHEN a IS NULL THEN mean - b ELSE (a - b) / 2 END AS gradient FROM (SELECT *, lag(mean) OVER w AS b, lead(mean) OVER w AS a FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY y))),
l AS (SELECT *, avg(gradient) OVER w + 1.5 * stddev_pop(gradient) OVER w AS high, avg(gradient) OVER w - 1.5 * stddev_pop(gradient) OVER w AS low FROM g WINDOW w AS (PARTITION BY vec_id))
"""


def _signal(t):
    s = t("embeddings").select("vec_id", F.posexplode("embedding").alias("y", "e")).select("vec_id", "y", F.round(F.round(F.col("e").cast("double"), 3) * 1000).cast("long").cast("double").alias("mean"))
    return imaging.peak_limits(imaging.gradients(s, ["vec_id"]), ["vec_id"])


@_query(_SIGNAL + """, u AS (SELECT vec_id, min(y) FILTER (gradient >= high) AS r, min(y) FILTER (gradient <= low) AS f FROM l GROUP BY vec_id)
SELECT vec_id, coalesce(min(y) FILTER (gradient <= low AND y > r), 0) AS up, coalesce(min(y) FILTER (gradient >= high AND y >= f), 0) AS down, round(max(high), 6) AS high FROM l JOIN u USING (vec_id) GROUP BY vec_id""")
def signal_peaks(t):
    s = _signal(t).withColumn("i", F.col("y").cast("long"))
    return s.groupBy("vec_id").agg(imaging.second_peak("i", True).alias("up"), imaging.second_peak("i", False).alias("down"), F.round(F.max("high"), 6).alias("high"))


_PIXELS = "WITH p AS (SELECT CAST(vec_id // 100 AS BIGINT) AS doc, CAST(vec_id % 100 AS INTEGER) AS y, CAST(unnest(range(0, len(embedding))) * 2 AS INTEGER) AS x, CAST(abs(CAST(round(unnest(embedding)::DOUBLE, 3) * 1000 AS BIGINT)) % 256 AS INTEGER) AS v FROM embeddings)"


def _tiles(t):
    """Images of 100 lines: a vector is a line, its numbers stand two apart."""
    v = F.transform("embedding", lambda e: (F.abs(F.round(F.round(e.cast("double"), 3) * 1000).cast("long")) % 256).cast("int"))
    xs = F.transform("embedding", lambda _, k: k * 2)
    return rasters.tiled(t("embeddings").select(F.floor(F.col("vec_id") / 100).alias("doc"), (F.col("vec_id") % 100).cast("int").alias("y"), xs.alias("xs"), v.alias("vs")), ["doc"])


_STRETCHED = "CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) * 255 // (max(v) OVER w - min(v) OVER w) ELSE v END AS INTEGER)"


@_query(_PIXELS + f", q AS (SELECT doc, x, y, CASE WHEN {_STRETCHED} > 60 THEN 255 ELSE 0 END AS v FROM p WINDOW w AS (PARTITION BY doc))" + """, s AS (SELECT doc, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY doc), i AS (SELECT q.*, w, h FROM q JOIN s USING (doc) WHERE x >= 40 AND y >= 40 AND x < w - 40 AND y < h - 40),
b AS (SELECT doc, w, h, min(x) FILTER (v < 255) AS a, min(y) FILTER (v < 255) AS b, max(x) FILTER (v < 255) + 1 AS c, max(y) FILTER (v < 255) + 1 AS d FROM i GROUP BY ALL)
SELECT doc, coalesce(a, 40) - 10 AS ux, CASE WHEN a IS NULL THEN 40 ELSE b END - 10 AS uy, CASE WHEN a IS NULL THEN w - 40 ELSE c END + 10 AS lx, CASE WHEN a IS NULL THEN h - 40 ELSE d END + 10 AS ly FROM b""")
def bbox(t):
    return rasters.crop_bounds(rasters.binarised(_tiles(t), ["doc"]), ["doc"])


@_query(_PIXELS + """, s AS (SELECT doc, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY doc), e AS (SELECT doc, w, y, min(x) FILTER (v < 40) AS l, min(w - x) FILTER (v < 40 AND x > 0) AS r FROM p JOIN s USING (doc) WHERE y IN (h // 2 - 20, h // 2, h // 2 + 20) GROUP BY ALL),
z AS (SELECT doc, w, 'left' AS side, l AS m FROM e WHERE l IS NOT NULL UNION ALL SELECT doc, w, 'right', r FROM e WHERE r IS NOT NULL), q AS (SELECT doc, w, side, avg(m) AS mean, stddev_pop(m) AS sd FROM z GROUP BY ALL),
v AS (SELECT doc, w, side, CAST(round_even(avg(m), 0) AS BIGINT) AS value FROM z JOIN q USING (doc, w, side) WHERE sd = 0 OR abs(m - mean) < 1.5 * sd GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY value, side) AS k FROM v)
SELECT doc, side, value AS margin, CASE WHEN side = 'left' THEN value + 10 ELSE 0 END AS crop_left, CASE WHEN side = 'right' THEN w - value - 10 ELSE w END AS crop_right FROM n WHERE k = 1""")
def spine(t):
    return rasters.spine(_tiles(t), ["doc"])


@_query(_PIXELS + """, a AS (SELECT doc, x, y, CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) * 255 // (max(v) OVER w - min(v) OVER w) ELSE v END AS INTEGER) & 248 AS v FROM p WINDOW w AS (PARTITION BY doc)),
c AS (SELECT doc, x, y, CAST(least(255, CASE WHEN v < 160 THEN round_even(v / 1.2, 0) ELSE v * 2 END) AS INTEGER) AS v FROM a)
SELECT doc, x, y, CAST(CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) * 255 // (max(v) OVER w - min(v) OVER w) ELSE v END AS INTEGER) AS v FROM c WINDOW w AS (PARTITION BY doc)""")
def tone_filter(t):
    return rasters.pixels(rasters.filtered(_tiles(t), ["doc"]), ["doc"]).select("doc", "x", "y", "v")


@_query("""SELECT p_partkey, round((max(p_retailprice) OVER w - p_retailprice) / 2, 4) AS offset_x, round(least(max(p_retailprice) OVER w / p_retailprice, max(p_size) OVER w / p_size), 6) AS cover_scale, 60 - p_size AS flipped FROM part WINDOW w AS (PARTITION BY p_brand)""")
def page_geometry(t):
    p = imaging.largest_page(t("part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("width"), F.col("p_size").alias("height")), ["p_brand"])
    return p.select(
        "p_partkey", F.round(imaging.equal_size_offset(F.col("width"), F.col("max_width")), 4).alias("offset_x"), F.round(imaging.cover_scale(F.col("width"), F.col("height"), F.col("max_width"), F.col("max_height")), 6).alias("cover_scale"), imaging.flipped(F.col("height"), F.lit(60)).alias("flipped")
    )


@_query("""WITH f AS (SELECT l_orderkey, arg_max(CASE l_returnflag WHEN 'A' THEN 'FlateDecode' WHEN 'N' THEN 'DCTDecode' ELSE 'JPXDecode' END, (l_linenumber * 1000000 + l_partkey) * 256 + ascii(l_returnflag)) AS filter, arg_max(l_partkey, (l_linenumber * 1000000 + l_partkey) * 256 + ascii(l_returnflag)) AS image FROM lineitem GROUP BY ALL)
SELECT l_orderkey, image, CASE filter WHEN 'FlateDecode' THEN 'png' WHEN 'DCTDecode' THEN 'jpg' ELSE 'jp2' END AS format FROM f""")
def page_images(t):
    kind = F.when(F.col("l_returnflag") == "A", "FlateDecode").when(F.col("l_returnflag") == "N", "DCTDecode").otherwise("JPXDecode")
    i = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("image"), kind.alias("filter"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 256 + F.ascii("l_returnflag")).alias("ordinal"))
    return imaging.last_image(i, ["l_orderkey"]).select("l_orderkey", "image", "format")


# --- store and reports -------------------------------------------------------


@_query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def kv_latest(t):
    return store.latest(t("events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id")


@_query("""WITH l AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(v, -1) AS stored, v IS NOT NULL AS hit FROM u LEFT JOIN l USING (user_id)""")
def cache_probe(t):
    e = t("events")
    log = e.where("event_type = 'click'").select("user_id", "value", "event_id")
    return store.probe(e.select("user_id").distinct(), log, "user_id", "value", "event_id", F.lit(-1.0)).select("user_id", "stored", "hit")


@_query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def cache_misses(t):
    return store.misses(t("orders").select("o_custkey").distinct().withColumnRenamed("o_custkey", "user_id"), t("events"), "user_id").select(F.col("user_id").alias("o_custkey"))


def _results(t):
    d = t("documents").select("doc_id", "lang", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", F.concat("source", F.lit(" & <"), "lang", F.lit(">")).alias("name"), (F.col("quality") == 1).alias("status"), F.concat(F.lit("/out/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("processed"))


_RESULTS = "WITH r AS (SELECT doc_id, source || ' & <' || lang || '>' AS name, quality = 1 AS status, '/out/' || doc_id || '.pdf' AS processed FROM documents LEFT JOIN labels USING (doc_id))"


@_query(_RESULTS + r"""SELECT doc_id, E'\n  ==' || name || E'==\n\n@x\n\n' || CASE WHEN status THEN '  Processed: ' || processed || E'\n  Confidence: 72.33 %\n' ELSE E'  Failed to match :(\n' END AS plain,
'<h2>' || replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || E'</h2>\n<pre><code>\n@x\n</code></pre>\n' || CASE WHEN status THEN '<a href="pdfs/' || doc_id || E'.pdf">Processed Pdf</a>\nConfidence: 72.33 %\n' ELSE E'Unable to download pdf :(\n' END AS html,
'** ' || CASE WHEN status THEN 'DONE ' ELSE 'TODO ' END || name || E'\n\n   #+BEGIN_SRC bibtex\n@x\n   #+END_SRC\n\n   #+BEGIN_SRC python\nark = "ark:/1/2"\n   #+END_SRC\n' || CASE WHEN status THEN E'\n   [[' || processed || E'][Processed Pdf]]   Confidence: 72.33 %\n' ELSE '' END AS org FROM r""")
def status_report(t):
    r, none = _results(t), F.lit(None).cast("string")
    c, raw, conf = F.col, F.lit("@x"), text.confidence(F.lit(0.7233333))
    return r.select(
        "doc_id", report.text_entry(c("name"), raw, c("status"), c("processed"), none, conf).alias("plain"), report.html_entry(c("name"), raw, c("status"), c("processed"), none, conf).alias("html"),
        report.org_entry(c("name"), raw, F.lit("bibtex"), F.lit("ark:/1/2"), c("status"), c("processed"), none, conf).alias("org"),
    )


@_query(_RESULTS + "SELECT count(*) AS successful, count(*) AS total, count(*) FILTER (status) AS matched, count(*) FILTER (NOT status) AS failed, count(*) FILTER (status IS NULL) AS unmatched, round(avg(CASE WHEN status IS NULL THEN 0 ELSE 1 END), 6) AS progress FROM r")
def status_counts(t):
    return report.status_counts(_results(t)).withColumn("progress", F.round("progress", 6))


@_query(_RESULTS + "SELECT name, status, min(doc_id) AS doc_id FROM r GROUP BY name, status")
def results_deduplicated(t):
    return report.deduplicated(_results(t).select("name", "status", "doc_id"), ["name", "status"], "doc_id")


@_query(r"""WITH q AS (SELECT *, trim(regexp_replace(lower(substr(p_name, 1, 8) || ' (' || substr(p_brand, 1, 8) || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS k, CAST(p_size AS VARCHAR) AS s, CAST(p_size + 1 AS VARCHAR) AS e FROM part)
SELECT p_partkey, '@Article{' || k || E',\n    year = {' || (1900 + p_size) || E'},\n    title = {' || p_name || E'},\n    journaltitle = {' || p_type || E'},\n    pages = {' || s || '--' ||
CASE WHEN length(s) = length(e) THEN array_to_string(list_transform(range(1, length(e) + 1), lambda i: CASE WHEN substr(e, i, 1) <> substr(s, i, 1) THEN substr(e, i, 1) ELSE '' END), '') ELSE e END || E'},\n    author = {' || p_brand || E'},\n    volume = {' || p_size || E'},\n}\n' AS entry FROM q""")
def bibtex_export(t):
    return t("part").select("p_partkey", report.bibtex_article(_part_article()).alias("entry"))


# --- sources -----------------------------------------------------------------


@_query("SELECT p_partkey, 'article' AS kind, p_name || ' é' AS title, p_type AS journaltitle, p_brand AS author, CAST(1900 + p_size AS VARCHAR) AS years, array_to_string(range(p_size + 100, p_size + 103), ',') AS pages, NULL::VARCHAR AS error FROM part")
def bibtex_parse(t):
    s = lambda c: F.col(c).cast("string")
    n = F.col("p_size")
    source = F.concat(
        F.lit("\n@Article{k"), s("p_partkey"), F.lit(",\n  title = {"), s("p_name"), F.lit(" {\\'e}},\n\n  journaltitle = \""), s("p_type"), F.lit("\",\n  author = {"), s("p_brand"), F.lit("}, language = {x},\n  year = "), (n + 1900).cast("string"),
        F.lit(",\n  pages = {"), (n + 100).cast("string"), F.lit("--"), (n + 102).cast("string"), F.lit("}}\n"),
    )
    r = bibtex.records(t("part").select(F.col("p_partkey").alias("file"), source.alias("value")))
    return r.select(F.col("file").alias("p_partkey"), "kind", "title", "journaltitle", "author", _arr(F.col("publicationdate")).alias("years"), F.array_join("pages", ",").alias("pages"), "error")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'article' END AS kind, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'T2' END AS journaltitle, p_brand || 'andX, Y' AS author, CAST(1900 + p_size AS VARCHAR) AS years, array_to_string(range(p_size, p_size + 3), ',') AS pages,
CASE WHEN p_partkey % 5 = 0 THEN 'Unsupported type' END AS error FROM part""")
def ris_parse(t):
    s = lambda c: F.col(c).cast("string")
    n = F.col("p_size")
    source = F.concat(
        F.lit("TY  - "), F.when(F.col("p_partkey") % 5 > 0, "JOUR").otherwise("ABST"), F.lit("\nAU  - "), s("p_brand"), F.lit("\nAU  - X, Y\nTI  - "), s("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\nJO  - "), s("p_type"))).otherwise(""),
        F.lit("\nT2  - T2\n\nPY  - "), (n + 1900).cast("string"), F.lit("\nSP  - "), n.cast("string"), F.lit("\nEP  - "), (n + 2).cast("string"), F.lit("\nER  - \n\n"),
    )
    r = ris.records(t("part").select(F.col("p_partkey").alias("file"), source.alias("value")))
    return r.select(F.col("file").alias("p_partkey"), "kind", "title", "journaltitle", "author", _arr(F.col("publicationdate")).alias("years"), F.array_join("pages", ",").alias("pages"), "error")


@_query(r"""WITH li AS (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS h, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS x FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS pno, x[i] AS title FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM li)""")
def toc_extract(t):
    return markup.toc_table(t("pages"), "html", ["page_id"], markup.PageLinks)


@_query()
def html_text(t):
    """The text of every page after its first rule; beyond SQL, so it is tested against pages read by hand."""
    return t("pages").select("page_id", markup.page_text(F.concat(F.lit("<body><p>x</p><hr>"), "html", F.lit("</body>"))).alias("text"))


@_query("""SELECT page_id, CAST(page_id % 90 AS INTEGER) AS ux, CAST(page_id % 70 AS INTEGER) AS uy, CAST(page_id % 90 + 1400 AS INTEGER) AS lx, CAST(page_id % 70 + 2100 AS INTEGER) AS ly, 1852 AS total_width, 3088 AS total_height FROM pages""")
def ocr_boxes(t):
    s = lambda c: c.cast("string")
    x = F.concat(F.lit('<alto><Page WIDTH="1852" HEIGHT="3088"><PrintSpace HPOS="'), s(F.col("page_id") % 90), F.lit('" VPOS="'), s(F.col("page_id") % 70), F.lit('" WIDTH="1400" HEIGHT="2100"/></Page></alto>'))
    b = t("pages").select("page_id", markup.ocr_box(x).alias("b"))
    return b.select("page_id", F.col("b.upper.x").alias("ux"), F.col("b.upper.y").alias("uy"), F.col("b.lower.x").alias("lx"), F.col("b.lower.y").alias("ly"), "b.total_width", "b.total_height")


# --- approximate search -------------------------------------------------------


def _whole(t, k: int):
    """Whole item texts in all documents: every pair with a hit of at most k errors."""
    lower = F.lower("text").alias("text")
    return fuzzy.search_all(t("benchmark").select("item_id", F.lower("text").alias("needle")), "item_id", "needle", t("documents").select("doc_id", lower), "doc_id", "text", k)


#: Lower-case letters beyond ASCII: levenshtein counts bytes, so a capital stands for each.
_LETTERS = "'ßàâäæçèéêëíìîïñóòôöùúûüœ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"


@_query(f"""WITH n AS (SELECT item_id, lower(text) AS full_needle, translate(lower(text), {_LETTERS}) AS needle FROM benchmark WHERE text <> ''), d AS (SELECT doc_id, lower(text) AS full_text, translate(lower(text), {_LETTERS}) AS text FROM documents),
p AS (SELECT item_id, needle, length(needle) * i // 3 AS a, substr(needle, length(needle) * i // 3 + 1, length(needle) * (i + 1) // 3 - length(needle) * i // 3) AS piece FROM n, range(0, 3) r(i)),
o AS (SELECT item_id, doc_id, needle, text, a, unnest(list_filter(range(1, length(text) + 1), lambda k: substr(text, k, length(piece)) = piece)) AS spot FROM p JOIN d ON contains(text, piece)),
s AS (SELECT DISTINCT item_id, doc_id, needle, text, unnest(range(greatest(1, spot - a - 2), greatest(1, spot - a + 3))) AS start FROM o),
e AS (SELECT *, unnest(range(greatest(start, start + length(needle) - 2), least(start + length(needle) + 3, length(text) + 2))) AS stop FROM s),
h AS (SELECT item_id, doc_id, stop, min({{'d': d, 's': start}}) AS h FROM (SELECT *, levenshtein(needle, substr(text, start, stop - start)) AS d FROM e) WHERE d <= 2 GROUP BY ALL),
g AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY item_id, doc_id ORDER BY stop) AS grp FROM (SELECT *, h.s >= lag(stop) OVER (PARTITION BY item_id, doc_id ORDER BY stop) AS fresh FROM h)),
b AS (SELECT item_id, doc_id, h.d AS dist, lower(full_needle) AS b, substr(full_text, h.s, stop - h.s) AS a FROM g JOIN n USING (item_id) JOIN d USING (doc_id) WHERE grp = 0 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY h.d, h.s - stop, stop) = 1),
c AS (SELECT DISTINCT a, b FROM b), """ + _STEPS + """
SELECT item_id, doc_id, (SELECT CAST(count(DISTINCT grp) AS INTEGER) FROM g WHERE g.item_id = b.item_id AND g.doc_id = b.doc_id) AS hits, CAST(dist AS INTEGER) AS dist, CAST(round_even(200.0 * last[-1] / (length(b.a) + length(b.b)), 0) AS INTEGER) AS ratio FROM b JOIN steps ON steps.a = b.a AND steps.b = b.b""")
def fuzzy_contains_k2(t):
    return _whole(t, 2).select("item_id", "doc_id", F.size("matches").alias("hits"), F.get("matches", F.lit(0))["dist"].alias("dist"), text.ratio(F.get("matches", F.lit(0))["matched"], F.col("needle")).alias("ratio"))


@_query("SELECT item_id, doc_id FROM (SELECT item_id, lower(text) AS needle FROM benchmark) JOIN (SELECT doc_id, lower(text) AS hay FROM documents) ON contains(hay, needle) WHERE needle <> ''")
def fuzzy_contains_k0(t):
    return _whole(t, 0).select("item_id", "doc_id")


# --- the rest of the surface ---------------------------------------------------


_BOXES = """, d AS (SELECT DISTINCT doc FROM p), bx AS (SELECT doc, CAST(2 + doc % 3 AS INTEGER) AS ux, CAST(30 + doc % 7 AS INTEGER) AS uy, 9 AS lx, CAST(60 + doc % 9 AS INTEGER) AS ly FROM d),
rw AS (SELECT doc, y, avg(v) AS mean FROM p GROUP BY ALL), gr AS (SELECT *, CASE WHEN b IS NULL THEN a - mean WHEN a IS NULL THEN mean - b ELSE (a - b) / 2 END AS gradient FROM (SELECT *, lag(mean) OVER w AS b, lead(mean) OVER w AS a FROM rw WINDOW w AS (PARTITION BY doc ORDER BY y))),
li AS (SELECT *, avg(gradient) OVER w + 1.5 * stddev_pop(gradient) OVER w AS high, avg(gradient) OVER w - 1.5 * stddev_pop(gradient) OVER w AS low FROM gr WINDOW w AS (PARTITION BY doc)),
nx AS (SELECT li.doc AS doc, uy - y AS i, y - ly AS j, gradient >= high AS rise, gradient <= low AS fall, y <= uy AND y > uy - 5 AS above, y >= ly AND y < ly + 5 AS below FROM li JOIN bx USING (doc)),
st AS (SELECT doc, min(i) FILTER (above AND rise) AS u, min(j) FILTER (below AND fall) AS f FROM nx GROUP BY doc),
pk AS (SELECT nx.doc AS doc, coalesce(min(i) FILTER (above AND fall AND i > u), 0) AS up, coalesce(min(j) FILTER (below AND rise AND j >= f), 0) AS down FROM nx JOIN st USING (doc) GROUP BY nx.doc)
"""


def _boxes(t):
    """Text boxes of images of 100 rows, in the image's own scale."""
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    d = F.col("doc")
    return t("embeddings").select(F.floor(F.col("vec_id") / 100).alias("doc")).distinct().select(
        "doc", point(d % 3 + 2, d % 7 + 30).alias("upper"), point(F.lit(9), d % 9 + 60).alias("lower"), *[F.lit(100).alias(c) for c in ("total_width", "total_height", "width", "height")]
    )


@_query(_PIXELS + _BOXES + "SELECT doc, ux - 10 AS ux, CAST(uy - up - 10 AS INTEGER) AS uy, lx + 10 AS lx, CAST(ly + down + 10 AS INTEGER) AS ly FROM bx JOIN pk USING (doc)")
def ocr_crops(t):
    return rasters.ocr_crop(_tiles(t), _boxes(t), ["doc"])


@_query(_PIXELS + """, i AS (SELECT doc, x - 4 AS x, y - 10 AS y, v FROM p WHERE x >= 4 AND x < 30 AND y >= 10 AND y < 40), a AS (SELECT doc, x, y, v AS plain, """ + _STRETCHED + """ & 248 AS v FROM i WINDOW w AS (PARTITION BY doc)),
c AS (SELECT doc, x, y, plain, CAST(least(255, CASE WHEN v < 160 THEN round_even(v / 1.2, 0) ELSE v * 2 END) AS INTEGER) AS v FROM a)
SELECT doc, x, y, CASE WHEN doc % 2 = 0 THEN plain ELSE """ + _STRETCHED + """ END AS v FROM c WINDOW w AS (PARTITION BY doc)""")
def processed_images(t):
    box = t("embeddings").select(F.floor(F.col("vec_id") / 100).alias("doc")).distinct().select("doc", *[F.lit(v).alias(k) for k, v in (("ux", 4), ("uy", 10), ("lx", 30), ("ly", 40))])
    return rasters.pixels(rasters.processed(_tiles(t), box, ["doc"], F.col("doc") % 2 == 0), ["doc"]).select("doc", "x", "y", "v")


_PLAN = """WITH p AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page, CAST(400 + o_orderkey % 50 AS INTEGER) AS mw, CAST(600 + o_orderkey % 70 AS INTEGER) AS mh, CAST(800 + o_orderkey % 90 AS INTEGER) AS iw,
 CAST(o_orderkey % 20 AS INTEGER) AS ux, CAST(o_orderkey % 30 AS INTEGER) AS uy, CAST(700 + o_orderkey % 11 AS INTEGER) AS lx, CAST(900 + o_orderkey % 13 AS INTEGER) AS ly FROM orders),
k AS (SELECT * FROM p WHERE page < 2 OR page <> 4), x AS (SELECT *, page < 2 AS cover, (lx - ux) * (CAST(mw AS DOUBLE) / iw) AS w, (ly - uy) * (CAST(mw AS DOUBLE) / iw) AS h, CAST(mw AS DOUBLE) / iw AS scale FROM k),
m AS (SELECT *, max(CASE WHEN NOT cover THEN w END) OVER d AS bw, max(CASE WHEN NOT cover THEN h END) OVER d AS bh, first_value(mw) OVER (PARTITION BY doc ORDER BY page) AS cw, first_value(mh) OVER (PARTITION BY doc ORDER BY page) AS ch, row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS n FROM x WINDOW d AS (PARTITION BY doc))
"""


@_query(_PLAN + """SELECT doc, n AS out_page, cover, round(CASE WHEN NOT cover THEN ux * scale END, 4) AS "left", round(CASE WHEN NOT cover THEN mh - ly * scale END, 4) AS low, round(CASE WHEN cover THEN bw ELSE w END, 4) AS width, round(CASE WHEN NOT cover THEN greatest(0, (bw - w) / 2) END, 4) AS offset_x,
 round(CASE WHEN cover THEN least(bw / cw, bh / ch) END, 6) AS cover_scale FROM m""")
def process_plan(t):
    """Customers' orders as pages of one document each; of those with two covers only, no size is known."""
    k = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    names = {"media_width": k % 50 + 400, "media_height": k % 70 + 600, "image_width": k % 90 + 800, "image_height": k % 90 + 1000, "ux": k % 20, "uy": k % 30, "lx": k % 11 + 700, "ly": k % 13 + 900}
    p = t("orders").select(F.col("o_custkey").alias("doc"), page.alias("page"), *[v.cast("int").alias(n) for n, v in names.items()])
    plan = imaging.process_plan(p, imaging.ProcessSettings(preserve_text=True, equal_size=True, has_cover_page=True, suppress_pages=(4,)))
    r = lambda c, n=4: F.round(c, n).alias(c)
    return plan.select("doc", F.col("out_page").cast("long").alias("out_page"), "cover", r("left"), r("low"), r("width"), r("offset_x"), r("cover_scale", 6))


@_query("""WITH k AS (SELECT user_id, max(event_id) AS top, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(v, user_id * 2.0) AS value, v IS NULL AS made FROM u LEFT JOIN k USING (user_id)""")
def memoised(t):
    e = t("events")
    log = store.named_store(e.where("event_type = 'click'").select(F.lit("ark").alias("name"), F.col("user_id").alias("key"), "value", F.col("event_id").alias("version")), "ark")
    found, rows = store.memoised(e.select(F.col("user_id").alias("key")).distinct(), log, "key", "value", "version", lambda w: w.select("key", (F.col("key") * 2.0).alias("value")))
    return found.join(rows.select("key", F.lit(True).alias("made")), "key", "left").select(F.col("key").alias("user_id"), "value", F.coalesce("made", F.lit(False)).alias("made"))


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bibtex' WHEN 1 THEN 'ris' END AS input, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS title, CASE WHEN p_partkey % 3 = 2 THEN 'Unsupported type' END AS error FROM part""")
def records_by_suffix(t):
    s, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    bib = F.concat(F.lit("@book{k"), s, F.lit(", title = {"), "p_name", F.lit("}, year = 1930}"))
    other = F.concat(F.lit("TY  - BOOK\nTI  - "), "p_name", F.lit("\nPY  - 1930\nER  - \n"))
    named = F.concat(F.lit("in/"), s, F.when(k == 0, ".bib").when(k == 1, ".RIS").otherwise(".txt"))
    r = archive.records(t("part").select(named.alias("file"), F.when(k == 0, bib).otherwise(other).alias("value")))
    return r.select(F.regexp_extract("file", r"in/(\d+)", 1).cast("long").alias("p_partkey"), "input", "title", "error")


@_query("""SELECT page_id, 'iiif/ark:/12148/p' || page_id || '/f' || (page_id % 9 + 1) || '/0,0,' || CASE WHEN page_id % 4 = 0 THEN '1,1' ELSE (page_id % 50 + 10) || ',' || (page_id % 60 + 20) END || '/full/0/native.png' AS address FROM pages""")
def image_addresses(t):
    p, s = F.col("page_id"), lambda c: c.cast("string")
    a = F.struct(F.lit("ark").alias("scheme"), F.lit(None).cast("string").alias("authority"), F.lit("12148").alias("naan"), F.concat(F.lit("p"), s(p)).alias("name"), F.lit("date").alias("qualifier"))
    payload = F.when(p % 4 == 0, "<html>busy</html>").otherwise(F.concat(F.lit('{"@id": "x", "width": '), s(p % 50 + 10), F.lit(', "height": '), s(p % 60 + 20), F.lit("}")))
    return t("pages").select("page_id", archive.image_address(a, p % 9 + 1, archive.whole_image(archive.image_info(payload))).alias("address"))


@_query("""SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'o' || o_orderkey END AS ark, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS publisher, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS years, CASE WHEN o_orderkey % 5 = 0 THEN 'not readable' END AS error, count(*) AS n FROM orders GROUP BY ALL""")
def issue_metadata(t):
    made = F.to_json(F.struct(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("ark"), F.col("o_orderstatus").alias("publisher"), F.array(F.lit("x"), F.concat(F.year("o_orderdate").cast("string"), F.lit(" (T3)"))).alias("description")))
    read = archive.issue_meta(t("orders").select(F.when(F.col("o_orderkey") % 5 == 0, "{busy").otherwise(made).alias("payload")))
    facts = articles.issue_facts(read)
    return facts.groupBy("ark", "publisher", _arr(F.col("publicationdate")).alias("years"), "error").agg(F.count("*").alias("n"))


@_query(r"""WITH q AS (SELECT *, trim(regexp_replace(lower(substr(p_name, 1, 8) || ' (' || substr(p_brand, 1, 8) || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '@Article{' || k || E',\n    journaltitle = {' || p_type || E'},\n    date = {1930-01-02},\n    author = {' || p_brand || E'},\n    title = {' || p_name || E'},\n}\n'
ELSE CASE p_partkey % 3 WHEN 0 THEN '@Book{' ELSE '@Collection{' END || k || E',\n    year = {' || (1900 + p_size) || E'},\n    publisher = {' || p_type || E'},\n    title = {' || p_name || E'},\n    note = {' || p_size || E' pp.},\n    author = {' || p_brand || E'},\n}\n' END AS entry FROM q""")
def bibtex_kinds(t):
    c = F.col
    fields = {"publicationdate": F.array(c("p_size") + 1900), "publisher": c("p_type"), "title": c("p_name"), "author": c("p_brand"), "editor": c("p_type"), "page_count": c("p_size"), "journaltitle": c("p_type"), "date": F.lit("1930-01-02")}
    kind = c("p_partkey") % 3
    entry = F.when(kind == 0, report.bibtex_record("book", fields, omit=("editor",))).when(kind == 1, report.bibtex_record("collection", fields, omit=("editor",))).otherwise(report.bibtex_record("newspaperarticle", fields))
    return t("part").select("p_partkey", entry.alias("entry"))


@_query(_RESULTS + " SELECT doc_id, name || ': ' || coalesce(CAST(status AS VARCHAR), '') || ' {' || processed || '}' AS entry FROM r")
def user_report(t):
    r = _results(t)
    return report.user_report(r, "{{ name }}: {{status}} {{{processed}}}", {k: F.col(k) for k in ("name", "status", "processed")}).select("doc_id", "entry")


@_query("""WITH v AS (SELECT p_partkey, p_size / 60.0 AS s FROM part) SELECT p_partkey, CAST(CASE WHEN s * 100 >= 100 THEN round(s * 100, 1) WHEN s * 100 >= 10 THEN round(s * 100, 2) ELSE round(s * 100, 3) END AS VARCHAR) || ' %' AS confidence FROM v""")
def confidences(t):
    return t("part").select("p_partkey", text.confidence(F.col("p_size") / F.lit(60.0)).alias("confidence"))


@_query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size AS a, p_size % 3 AS b FROM part)
SELECT p_partkey, CAST(CASE k WHEN 0 THEN 0.5 WHEN 1 THEN CASE WHEN a = a + b THEN 1.0 ELSE 0.0 END WHEN 2 THEN CASE WHEN b < 2 THEN 1.0 ELSE 0.0 END WHEN 3 THEN CASE b WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END WHEN 4 THEN CASE WHEN b < 2 THEN 0.5 ELSE 0.0 END ELSE 0.0 END AS DOUBLE) AS score FROM p""")
def number_scores(t):
    """One against nothing, one, a list; a list against a list, one, nothing."""
    k, a, b = F.col("p_partkey") % 6, F.col("p_size"), F.col("p_size") % 3
    one, two, none = F.array(a), F.array(a, a + 1), F.lit(None).cast("array<int>")
    target = F.when(k < 3, one).otherwise(two)
    candidate = F.when(k.isin(0, 5), none).when(k == 1, F.array(a + b)).when(k == 2, F.array(a - b, a - b + 1)).when(k == 3, F.array(a + b, a + b + 1)).otherwise(F.array(a + b))
    return t("part").select("p_partkey", matching.number_score(target, candidate, k >= 3, k.isin(2, 3)).alias("score"))


@_query("""SELECT p_partkey, CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN 100 // (p_size % 5) + 1 END AS value, CASE WHEN p_size % 7 = 0 THEN 'no size' WHEN p_size % 5 = 0 THEN 'division' END AS error, CASE WHEN p_size % 5 > 0 AND p_size % 7 > 0 THEN 100 // (p_size % 5) + 1 ELSE -1 END AS value_or FROM part""")
def error_values(t):
    n = F.col("p_size")
    e = either.of(n, F.when(n % 7 == 0, "no size"))
    divided = either.flat_mapped(e, lambda v: either.of(F.floor(F.lit(100) / F.nullif(v % 5, F.lit(0))).cast("int"), F.when(v % 5 == 0, "division")))
    out = either.mapped(divided, lambda v: v + 1)
    return t("part").select("p_partkey", out["value"].alias("value"), out["error"].alias("error"), either.value_or(out, F.lit(-1)).alias("value_or"))
