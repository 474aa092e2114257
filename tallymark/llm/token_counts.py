"""Token counts by digest cache.

The cache is a Parquet table partitioned by tokenizer digest. Texts that the tokenizer cannot
tell apart share a normalised content digest; only distinct digests that the table lacks are
encoded, and their counts are appended to it for later runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import SPACE
from tallymark.llm.vocab import drops_spaces, encoder, file_digest

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


def normalised(text: str, spaces_matter: bool) -> Column:
    """What the digest covers: the text, with runs of ASCII white space as one where they don't matter."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return whole if spaces_matter else F.trim(F.regexp_replace(whole, SPACE, " "))


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row per content; nothing where no cache is yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "content string, n_tokens long")
    # runs side by side may have stored the same content twice, with the same count
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_bytes (UTF-8) and n_tokens of its whole text.

    A null text counts as empty, with 0 bytes and 0 tokens. Equal texts are encoded once,
    repeated rows and null ids are kept as they are, and other columns are ignored whatever
    their names. Empty input gives no rows. ``tokenizer`` is a vocabulary file that all machines
    hold at the same path, ``cache`` the folder of the count table.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer)
    bare = docs.select(F.col(id_column).alias(id_column), F.col(text).alias("text"))
    content = normalised("text", not drops_spaces(tokenizer))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_counts = encoder(tokenizer).counts
        for batch in batches:
            counts = encode_counts(batch.column("normal").to_pylist())
            yield pa.record_batch([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    distinct = (
        bare.select(content.alias("normal"))
        .select(F.sha2("normal", 256).alias("content"), "normal")
        .dropDuplicates(["content"])
    )
    misses = distinct.join(read_cache(spark, cache, version), "content", "left_anti")
    fresh = misses.mapInArrow(encode, "content string, n_tokens long").withColumn("tokenizer", F.lit(version))
    fresh.write.mode("append").partitionBy("tokenizer").parquet(cache)

    wanted = bare.select(
        id_column,
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(content, 256).alias("content"),
    )
    return wanted.join(read_cache(spark, cache, version), "content", "left").select(id_column, "n_bytes", "n_tokens")
