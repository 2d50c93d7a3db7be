"""Record linkage: search, candidate scoring, ranked early exit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import ranges, text

#: Fields that a catalogue search may name; fixed values.
SEARCHABLE = (
    "anywhere", "author", "title", "subject", "doctype", "recordtype", "status", "recordid", "persistentid", "ean", "isbn", "issn", "ismn", "isrc", "comref", "otherid", "abstract", "authorRole", "cote", "date", "dewey", "digitized",
    "FrenchNationalBibliography", "fuzzyIsbn", "isni", "language", "LegalDepositType", "LegalDepositDate", "local", "publicationdate", "publicationplace", "publisher", "serialtitle", "set", "technicaldata", "unimarc:doctype",
    "col2bib", "ens2bib", "rec2bib", "author2bib", "subject2bib", "work2bib", "creationdate", "lastmodificationdate",
)
#: Record kind -> record type of the catalogue; fixed values.
RECORD_TYPES = {"article": "per", "journal": "per", "book": "mon", "collection": "col"}


@dataclass(frozen=True)
class MatchSettings:
    """Limits of the search for a match."""

    give_up: int = 50
    skip_score: float = 0.7
    skip_from: int = 4  # first candidate, from 0, after which a good score ends the search
    minimum_confidence: float = 0.5
    keep: int = 5
    consider_toc: bool = True
    consider_text: bool = True


DEFAULTS = MatchSettings()

#: Rows of a side of a cell of pairs. A block has so many sides at least, for its pairs make more work than its bytes show, if each has so many rows.
SIDE_ROWS, LEAST_SIDES, LEAST_ROWS = 16384, 4, 512
#: Rows of a name that are packed together in a side, about: all pairs of two packs are in memory at once when they are exploded.
PACK_ROWS = 512
#: What one integer may score against a list.
ONE_IN_LIST = (None, 0.0, 0.5, 1.0)


def source_of(records: DataFrame) -> DataFrame:
    """What is looked for in the catalogue: an article's journal, any other record itself."""
    article = F.col("kind") == "article"
    gone = [c for c in ("title", "subtitle", "author", "editor", "pages", "physical_pages") if c in records.columns]
    return records.withColumns({c: F.when(~article, F.col(c)) for c in gone} | {"kind": F.when(article, "journal").otherwise(F.col("kind"))})


def translated(records: DataFrame) -> DataFrame:
    """Names of the catalogue's fields: no editor, a journal's title as title."""
    out = records.withColumn("title", F.when(F.col("kind") == "journal", F.col("journaltitle")).otherwise(F.col("title")))
    return out.drop("editor", "journaltitle")


def search_string(fields: dict[str, Column]) -> Column:
    """'bib.k all "v" and ...' of the fields that may be searched and are not empty."""
    terms = [F.when(F.length(v) > 0, F.concat(F.lit(f'bib.{k} all "'), v, F.lit('"'))) for k, v in fields.items() if k in SEARCHABLE]
    return F.concat_ws(" and ", *terms)


def query_item(value: Column, is_list: bool = False) -> Column:
    """A field's value as it is searched for: a list's members parted by spaces."""
    return F.array_join(value.cast("array<string>"), " ") if is_list else value.cast("string")


def field_search(queries: DataFrame, query_id: str, rows: DataFrame, row_id: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(query_id, row_id) where each field of the row holds every word that the query names for it.

    fields: searchable name -> (column of queries, column of rows).  Words carry
    their field's name, so one inverted index serves all of them; a null or empty
    field asks for nothing, and other names are not searched.
    """
    used = {k: v for k, v in fields.items() if k in SEARCHABLE}

    def words(name: str, column: str) -> Column:
        return F.transform(F.coalesce(tokens(F.col(column).cast("string")), F.array().cast("array<string>")), lambda w: F.concat(F.lit(f"{name}="), w))

    def marked(side: int) -> Column:
        return F.array_distinct(F.flatten(F.array(*[words(name, columns[side]) for name, columns in used.items()])))

    return _word_search(queries.select(query_id, marked(0).alias("wanted")), query_id, rows.select(F.col(row_id).alias("id"), marked(1).alias("held")), row_id)


def tokens(column: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != ""))


def token_search(queries: DataFrame, query_id: str, query_text: str, rows: DataFrame, row_id: str, row_text: str) -> DataFrame:
    """(query_id, row_id) where the row holds every word of the query, by an inverted index."""
    held = rows.select(F.col(row_id).alias("id"), tokens(F.col(row_text)).alias("held"))
    return _word_search(queries.select(query_id, tokens(F.col(query_text)).alias("wanted")), query_id, held, row_id)


def _word_search(queries: DataFrame, query_id: str, rows: DataFrame, row_id: str) -> DataFrame:
    """token_search over `wanted`, distinct words, and rows of id and `held`, distinct words.

    Rows that hold the same words are one class, named by 128 bits of its words, and the
    search is among classes; rows, those that repeat an id included, come in at the end.  The
    index has pairs of a class and a word that some query names.  Each query joins on its
    rarest word only, so a word that is everywhere multiplies nothing unless a query has no
    other; its other words are then looked up for each class found, and counted.  So a
    row costs its number of words, however many those are.  Joins are merges: by the size of
    its file an index looks small enough to be broadcast, and it would pass the driver whole.
    """
    named = rows.select("id", "held", F.unhex(F.substring(F.sha2(F.array_join(F.array_sort("held"), " "), 256), 1, 32)).alias("name"))
    each = queries.where(F.size("wanted") > 0).select(F.col(query_id).alias("query"), F.size("wanted").alias("number_of_words"), F.explode("wanted").alias("word"))
    index = named.select("name", F.explode("held").alias("word")).join(each.select("word").distinct(), "word", "left_semi").distinct()
    rated = each.join(index.groupBy("word").agg(F.count("*").alias("count")).hint("merge"), "word", "left").fillna(0, ["count"])
    rarest = rated.groupBy("query", "number_of_words").agg(F.min(F.struct("count", "word")).alias("least")).select("query", "number_of_words", F.col("least.word").alias("word"))
    found = rarest.join(index.hint("merge"), "word").select("query", "number_of_words", F.col("word").alias("rarest"), "name")
    others = found.where("number_of_words > 1").join(each.select("query", "word").hint("merge"), "query").where("word <> rarest")
    met = others.join(index.hint("merge"), ["word", "name"])
    rest = met.groupBy("query", "name").agg(F.count("*").alias("n"), F.max("number_of_words").alias("number_of_words")).where("n = number_of_words - 1")
    both = found.where("number_of_words = 1").select("query", "name").unionByName(rest.select("query", "name"))
    return both.join(named.select("id", "name").hint("merge"), "name").select(F.col("query").alias(query_id), F.col("id").alias(row_id))


def text_score(target: Column, candidate: Column) -> Column:
    """Similarity of normal forms; null where the target has no such field, 0 where only the candidate lacks it."""
    return F.when(target.isNotNull(), F.coalesce(text.ratio(text.plain(target), text.plain(candidate)), F.lit(0)) / 100)


def number_score(target: Column, candidate: Column, target_is_list: Column | None = None, candidate_is_list: Column | None = None) -> Column:
    """Score of one integer or a list against one or a list, each an array with a flag.

    One against nothing is 0.5, against one equal or not, against a list member
    or not.  A list against a list is the share of its members there, against one
    1/size if that is a member, against nothing 0.  An empty list is not scored.
    """
    listed, other = target_is_list if target_is_list is not None else F.lit(False), candidate_is_list if candidate_is_list is not None else F.lit(False)
    v, c = F.get(target, F.lit(0)), F.get(candidate, F.lit(0))
    nothing = candidate.isNull() | (F.size(candidate) == 0) | (~other & (c.cast("string") == "0"))
    single = F.when(nothing, F.lit(0.5)).otherwise(F.array_contains(candidate, v).cast("double"))
    shared = F.size(F.filter(target, lambda x: F.array_contains(candidate, x))) / F.size(target)
    against_one = F.when(F.array_contains(target, c), F.lit(1.0) / F.size(target)).otherwise(F.lit(0.0))
    many = F.when(candidate.isNull(), F.lit(0.0)).when(other, shared).otherwise(against_one)
    return F.when(target.isNull() | (F.size(target) == 0), F.lit(None).cast("double")).when(listed, many).otherwise(single)


def mean_score(scores: dict[str, Column]) -> Column:
    """Mean over the fields that are scored."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores.values()])
    count = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in scores.values()])
    return F.when(count > 0, total / count)


def score_map(scores: dict[str, Column]) -> Column:
    """Map of field to score of the fields that are scored."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), s.cast("double").alias("value")) for k, s in scores.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def map_mean(vals: Column) -> Column:
    """Mean of a map of scores; null if it is empty."""
    return F.when(F.size(vals) > 0, F.aggregate(F.map_values(vals), F.lit(0.0), lambda a, v: a + v) / F.size(vals))


def cells_of_pairs(rows: DataFrame, block: str, key: str, name: str, value: str, t_value: Callable[[Column], Column] = lambda v: v, c_value: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """All pairs of rows of a block, packed: t_name, t_held, c_name, c_held; each `held` has arrays of keys by value, as t_value and c_value make of it.

    A block's rows are dealt at random to sides of some SIDE_ROWS rows, and any two sides meet in a cell of
    their own; in it, rows of a name are one row, or several if they are more than PACK_ROWS.  So a row is
    shuffled once for each side of its block, and pairs are shuffled never: they come into being where the
    arrays are exploded.  Rows that repeat a key count each, null names, values and keys are values, and rows
    without a block have no pairs.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes here, which one task would take, make very many pairs
    given = rows.where(F.col(block).isNotNull()).select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(name).alias("name"), F.col(value).alias("value"), F.rand(7).alias("at"))
    count = F.count("*")
    sides = given.groupBy("block").agg(F.greatest(F.ceil(count / SIDE_ROWS), F.least(F.lit(LEAST_SIDES), F.ceil(count / LEAST_ROWS))).cast("int").alias("sides"))
    dealt = given.join(sides, "block").withColumn("at", F.col("at") * F.col("sides")).withColumn("side", F.floor("at").cast("int")).repartition(tasks, "block", "side", "name")
    packs = F.ceil(count.over(Window.partitionBy("block", "side", "name")) / PACK_ROWS)
    parted = dealt.withColumn("pack", F.floor((F.col("at") - F.col("side")) * packs).cast("int"))
    valued = parted.groupBy("block", "sides", "side", "name", "pack", "value").agg(F.transform(F.collect_list(F.struct("key")), lambda x: x["key"]).alias("keys"))
    packed = valued.groupBy("block", "sides", "side", "name", "pack").agg(F.collect_list(F.struct("value", "keys")).alias("held"))
    others = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    left = packed.select("block", F.col("side").alias("a"), others.alias("b"), F.col("name").alias("t_name"), F.col("held").alias("t_held"))
    right = packed.select("block", others.alias("a"), F.col("side").alias("b"), F.col("name").alias("c_name"), F.col("held").alias("c_held"))
    made = lambda held, f: F.transform(held, lambda h: F.struct(f(h["value"]).alias("value"), h["keys"].alias("keys")))
    left, right = (x.repartition(tasks, "block", "a", "b").withColumn(c, made(F.col(c), f)) for x, c, f in ((left, "t_held", t_value), (right, "c_held", c_value)))
    return left.join(right.hint("merge"), ["block", "a", "b"]).select("t_name", "t_held", "c_name", "c_held")


def early_exit(scored: DataFrame, target: str, pos: str, score: str = "score", settings: MatchSettings = DEFAULTS) -> DataFrame:
    """Of each target's candidates those that a search in order would have seen.

    It gives up after so many, and stops after the fifth or a later one once any
    score seen is above the limit.  Adds `seen`, the candidate's number from 0.
    """
    order = Window.partitionBy(target).orderBy(pos)
    # a plain limit on the row number is applied before the shuffle, too
    ranked = scored.withColumn("number", F.row_number().over(order)).where(F.col("number") <= settings.give_up).withColumn("seen", F.col("number") - 1).drop("number")
    so_far = F.max(score).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ranked.withColumn("ends", (F.col("seen") >= settings.skip_from) & (so_far > settings.skip_score))
    ended = F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("over", F.coalesce(ended, F.lit(False))).where(~F.col("over")).drop("ends", "over")


def first_of_block(rows: DataFrame, block: str, pos: str, number: int, keep: str | None = None) -> DataFrame:
    """The first rows of every block, with their number from 1 if it is to be kept; rows without a block are left out."""
    order = Window.partitionBy(block).orderBy(pos)
    return rows.where(F.col(block).isNotNull()).withColumn("number", F.row_number().over(order)).where(F.col("number") <= number).withColumnsRenamed({"number": keep} if keep else {}).drop(*[] if keep else ["number"])


def best_match(scored: DataFrame, target: str, pos: str, score: str = "score", settings: MatchSettings = DEFAULTS) -> DataFrame:
    """The best candidate seen; of equals the first."""
    seen = early_exit(scored, target, pos, score, settings)
    order = Window.partitionBy(target).orderBy(F.desc(score), F.asc(pos))
    return seen.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "seen")


def article_candidates(scored: DataFrame, target: str, issue: str, pos: str, score: str = "score", settings: MatchSettings = DEFAULTS) -> DataFrame:
    """The best `keep` candidates of the issues up to the first with a score above the limit; `rank` from 1."""
    by_issue = scored.groupBy(target, issue).agg(F.max(score).alias("best"))
    order = Window.partitionBy(target).orderBy(issue).rowsBetween(Window.unboundedPreceding, -1)
    open_issues = by_issue.withColumn("before", F.max("best").over(order)).where(F.col("before").isNull() | (F.col("before") <= settings.skip_score)).select(target, issue)
    ranked = Window.partitionBy(target).orderBy(F.desc(score), F.asc(issue), F.asc(pos))
    return scored.join(open_issues, [target, issue]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= settings.keep)


def confident(ranked: DataFrame, score: str = "score", settings: MatchSettings = DEFAULTS) -> DataFrame:
    """Candidates at or above the least confidence; lists are sorted, so stopping there is skipping the rest."""
    return ranked.where(F.col(score) >= settings.minimum_confidence)


def first_available(ranked: DataFrame, available: DataFrame, key: str, target: str) -> DataFrame:
    """Each target's best-ranked candidate that can be had."""
    there = ranked.join(available.select(key).distinct(), key, "left_semi")
    return there.withColumn("first", F.row_number().over(Window.partitionBy(target).orderBy("rank"))).where("first = 1").drop("first")


def possible_issues(serials: DataFrame, years: str, serial: str, issues: DataFrame, issue_serial: str, issue_year: str) -> DataFrame:
    """Serial joined to its issues of the years wanted and those beside them, each once."""
    wanted = serials.select(serial, F.explode(ranges.year_window(F.col(years))).alias("wanted")).distinct()
    return wanted.join(issues, (F.col(serial) == F.col(issue_serial)) & (F.col("wanted") == F.col(issue_year)))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, and of second what has a key that first lacks altogether."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def supported(pairs: DataFrame) -> DataFrame:
    """Adds an error where a target or its source is of a kind that has no articles."""
    wrong = F.col("target_kind").isin("book", "collection", "journal") | F.col("source_kind").isin("book", "collection")
    return pairs.withColumn("error", F.when(wrong, F.concat_ws(" ", F.lit("unable to match a"), "target_kind", F.lit("in a"), "source_kind")))


def catalogue_journals(raw: DataFrame, serial_type: str = "publication en série imprimée") -> tuple[DataFrame, DataFrame]:
    """Catalogue hits as journals, and those of other types or unreadable dates set aside."""
    kinds = raw.withColumns(
        {
            "ark": text.first_of(F.col("identifier")),
            "journaltitle": text.first_of(F.col("title")),
            "publisher": text.first_of(F.col("publisher")),
            "language": F.coalesce(F.get("language", F.lit(1)), F.get("language", F.lit(0))),
            "type": F.get("type", F.lit(0))["text"],
            "publicationdate": ranges.catalogue_years(F.col("date")),
        }
    )
    good = F.coalesce(F.col("type") == serial_type, F.lit(False)) & F.col("publicationdate").isNotNull()
    return kinds.where(good), raw.join(kinds.where(~good).select("pos"), "pos", "left_semi")
