"""From raw documents to packed windows: the stages of a training-data pipeline.

Every stage works on all rows that its predecessor kept, and its decisions take effect: what it
rejects is gone for the stages after it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.mixing import mixed
from tallymark.llm.ngram_join import link_components
from tallymark.llm.packing import pack
from tallymark.llm.queries import labels, language_model, quality_model
from tallymark.llm.shared import settle
from tallymark.llm.vocab import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labelled documents are learned from.

    A null text counts as empty, and an empty one is judged like any other; a document without an id
    is judged too, but not learned from. Equal texts have equal scores, so copies stay or go together.
    """
    return quality_model(docs, labels(spark, sf_dir)).filter(docs)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty, by the threshold of the calibration fold.

    A text that is null or has no letter goes. Equal texts stay or go together, whatever their ids.
    """
    return language_model(docs).filter(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, of equal ids the smallest text hash.

    Documents without shingles are near no other and stay, all of them. Ids may be null, which
    comes last, or repeated: rows are told apart by id and text, and of rows equal in both one stays.
    """
    rows = settle(link_components(docs).filter("class_id is not null"), "pipeline-classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = rows.groupBy("class_id").agg(F.min(place).alias("first"))
    keys = rows.groupBy("class_id", "doc_id", "text_hash").agg(F.count("*").alias("rows")).join(first, "class_id")
    chosen = place == F.col("first")
    marks = keys.filter(~chosen | (F.col("rows") > 1)).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), chosen.alias("__chosen")
    )
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    marked = hashed.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left")
    once = marked.filter("__chosen is null").select(docs.columns)
    repeated = marked.filter("__chosen").dropDuplicates(["__id", "__hash"]).select(docs.columns)
    return once.union(repeated)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one of its own, and comes last.

    Null and empty texts have no words and stay as often as the mix takes their hash.
    """
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, a row per piece; a null or empty text is its end token alone."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good),
    ("language ID", identified),
    ("n-gram Jaccard join", distinct),
    ("mixing sources", weighted),
    ("packing", packed),
]

#: The classifiers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
