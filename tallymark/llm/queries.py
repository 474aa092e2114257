"""One query per operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe, language, quality, toxicity
from tallymark.llm.conversation_trie import branched, trie
from tallymark.llm.embedding_dedup import link_vectors
from tallymark.llm.fitting import fold
from tallymark.llm.mixing import mix
from tallymark.llm.neighbours import nearest
from tallymark.llm.ngram_join import link_components
from tallymark.llm.packing import pack
from tallymark.llm.record_files import read_records, write_records
from tallymark.llm.shared import new_path
from tallymark.llm.spelling import letter_runs, variants
from tallymark.llm.token_counts import count_tokens
from tallymark.llm.vocab import tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels without those of the held-out fold, 0 of 5."""
    return table(spark, folder, "labels").filter(fold("doc_id", 5) != 0)


def quality_model(docs: DataFrame, known: DataFrame) -> quality.QualityModel:
    return quality.train(docs, known)


def language_model(docs: DataFrame) -> language.LanguageModel:
    return language.train(docs.filter(fold("doc_id", 3) != 1))


@query
def op1_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents; the labels know two grades."""
    docs = table(spark, folder, "documents")
    graded = toxicity.train(docs, labels(spark, folder), label="toxic").grade(docs)
    return graded.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))


@query
def op2_grouped_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents by similarity of their 5-word shingles."""
    return link_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_hash_threshold_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Mix all documents by source."""
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op3_hash_threshold_mix"] = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
running AS (
  SELECT *, source_size * 2.0 / weight AS full_at, sum(source_size) OVER () AS whole,
         coalesce(sum(source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM sources
  WINDOW w AS (ORDER BY source_size * 2.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (1.5::DOUBLE * whole - 2.0::DOUBLE * capped) / open_weight AS level
  FROM running WHERE full_at >= (1.5::DOUBLE * whole - 2.0::DOUBLE * capped) / open_weight
  ORDER BY full_at, source NULLS LAST LIMIT 1),
aims AS (
  SELECT source, source_size,
         CASE WHEN source_size * 2.0::DOUBLE < weight * level THEN source_size * 2.0::DOUBLE ELSE weight * level END AS target
  FROM sources, level),
placed AS (
  SELECT s.*, a.source_size, a.target, CASE WHEN a.target >= a.source_size THEN 1 ELSE 0 END AS base,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash) AS DOUBLE) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS together
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       size * (base + CASE WHEN upto - (target - base * source_size) <= 0
                             OR (target - base * source_size > upto - together
                                 AND upto - (target - base * source_size) < target - base * source_size - (upto - together))
                           THEN 1 ELSE 0 END) AS taken
FROM placed"""


@query
def op4_subword_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents, learned from folds 0 and 2 of 3."""
    docs = table(spark, folder, "documents")
    predicted = language_model(docs).predict(docs)
    return predicted.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))


@query
def op5_length_delimited_records(spark: SparkSession, folder: str) -> DataFrame:
    """Write the ids of all documents to record files, and read the files back."""
    files = new_path(spark, "records")
    index = write_records(table(spark, folder, "documents"), tokenizer_path(), files)
    return read_records(index, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_epsilon_grid_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all vectors, within labels."""
    return link_vectors(table(spark, folder, "embeddings"))


@query
def op7_bradley_terry_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned from folds 1 to 4 of 5."""
    docs = table(spark, folder, "documents")
    scored = quality_model(docs, labels(spark, folder)).score(docs)
    return scored.select(
        "doc_id", "score", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op8_nn_descent_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


@query
def op9_digest_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, starting from an empty cache."""
    counts = count_tokens(table(spark, folder, "documents"), tokenizer_path(), new_path(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op10_minimum_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into windows of 4096 tokens."""
    pieces = pack(table(spark, folder, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_to"
    )


def planted_words(docs: DataFrame, least: int = 6, rows: int = 5) -> DataFrame:
    """(word, n) of the words of all documents, with a letter missing where a hash of document and run says so."""
    runs = letter_runs(docs, least)
    hash_ = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    placed = runs.select("run", hash_.alias("hash")).withColumn("at", (F.col("hash") % F.length("run")).cast("int"))
    missing = F.expr("substr(run, 1, at) || substr(run, at + 2)")
    words = placed.select(F.when(F.col("hash") % 199 == 0, missing).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= rows)


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the frequent words of all documents, with planted errors."""
    found = variants(planted_words(table(spark, folder, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def byte_tokenizer() -> byte_bpe.ByteBpe:
    import public_tokenizers

    return byte_bpe.ByteBpe.from_file(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of all documents, and of the bytes that the ids stand for."""
    bpe = byte_tokenizer()
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), bpe), bpe)
    return coded.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, which begin with turns of their group's first one."""
    turns, conversations = branched(table(spark, folder, "conversations"))
    return trie(turns, conversations, ["part", "place"])
