"""Token counts by a digest cache.

A text's content digest and the digest of the tokenizer (file and settings) name a
stored count. Texts are reduced to one per digest before anything is looked up, only
digests without a count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.llm import words

SETTINGS = "add_special_tokens=False,truncation=None,padding=None"
CACHE = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: its file's content and the settings it is used with."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + SETTINGS.encode()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the content. A null counts as empty; nothing else is normalised, as it would change counts."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_cache(spark, cache: str) -> DataFrame:
    """The stored counts; a cache that does not exist yet is empty."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def fill_cache(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encode the distinct contents of ``docs`` without a stored count and append theirs.

    Jobs that run at the same time may store a digest twice, with the same count.
    """
    version = tokenizer_digest(path)
    stored = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version)

    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(words.count_ids(path, batch), dtype="int64")

    counted = F.pandas_udf(encode, "bigint")
    distinct = docs.select(
        content_digest(F.col(text)).alias("digest"), F.coalesce(text, F.lit("")).alias("content")
    )
    misses = distinct.groupBy("digest").agg(F.first("content").alias("content")).join(stored, "digest", "left_anti")
    misses.select(F.lit(version).alias("tokenizer"), "digest", counted("content").alias("n_tokens")).write.mode(
        "append"
    ).parquet(cache)


def count_tokens(docs: DataFrame, path: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``; the cache gains what it lacked.

    ``path`` is a tokenizer file that all machines have, ``cache`` a folder they share.
    Null and empty texts have 0 bytes and 0 tokens, null ids and repeated rows are rows
    like any other, other columns are ignored, an empty table gives no rows.
    """
    fill_cache(docs, path, cache, text)
    known = (
        read_cache(docs.sparkSession, cache)
        .where(F.col("tokenizer") == tokenizer_digest(path))
        .groupBy("digest")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
    keyed = docs.select(
        F.col(id),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        content_digest(F.col(text)).alias("digest"),
    )
    return keyed.join(known, "digest", "left").drop("digest")
