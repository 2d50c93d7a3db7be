"""From raw documents to token ids, in five stages on the operators of scriptorium.llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with the
columns of documents; the last returns each document's ids.  Columns that documents
have beside those named here come along, whatever their names; an empty table stays
one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, exact, jaccard, quality
from scriptorium.llm.shared import Workspace, documents
from scriptorium.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document whose chance of label 1 is less goes.
LEAST_QUALITY = 0.3


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    while name in docs.columns:
        name += "'"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier rejects; null texts are empty ones, and equal texts go or stay together."""
    chance = _free(docs, "chance of label 1")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(docs, model, score_col=chance)
    return scored.where(F.col(f"`{chance}`") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id stays, a null id before all; null texts are empty."""
    return exact.exact_groups(docs, carry=True).where("kept").select("row.*")


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by five-word shingles at 0.8, the one with the smallest doc_id stays, null ids last.

    Rows are told apart by 128 bits of a digest of id and text, so rows that share an id, or have none, stand or go
    for themselves; of equal rows one stays.  Null texts, and those without words, link with nothing and stay.
    """
    told = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "-").otherwise(":"), F.coalesce("text", F.lit("")))
    key = _free(docs, "row key")
    keyed = docs.withColumn(key, F.unhex(F.substring(F.sha2(told, 256), 1, 32)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))  # in this order the first of a group stays
    groups = jaccard.components(keyed.select(place.alias("place"), "text"), shingle=5, percent=80, id_col="place")
    groups = groups.select(F.col("place.key").alias(key), F.col("component_id.key").alias("first"), "n_shingles")
    gone = groups.where(F.col(key) != F.col("first")).select(key).distinct()
    kept = keyed.join(gone, key, "left_anti")
    equal = groups.where("n_shingles > 0").groupBy(key).count().where("count > 1").select(key)  # equal rows; none after exact dedup
    once = kept.join(equal, key, "left_semi").dropDuplicates([key])
    return kept.join(equal, key, "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null texts and those without words stay, and so does all if there are no items."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("n_hit = 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, binary), n_tokens, and the text decoded from the ids.

    A row for each row, those that repeat included; null and empty texts have no ids and decode to ''.
    """
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.col("decoded").alias("text"))


def _shipped(stage: Stage) -> Stage:
    """The stage, with the package on the executors."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("compression classifier", _shipped(keep_quality)),
    ("exact dedup", _shipped(keep_first_copies)),
    ("n-gram Jaccard join", _shipped(keep_one_near_copy)),
    ("winnowing decontamination", _shipped(keep_uncontaminated)),
    ("byte-level BPE", _shipped(encode)),
]

#: Compression, trained dictionaries and BPE merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    space, docs = Workspace(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = space.write(stage(spark, docs, sf_dir), str(k))
        if k:
            space.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
