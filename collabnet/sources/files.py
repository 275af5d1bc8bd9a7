"""Readers for XML, tab-separated, line-JSON, N-quad and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collabnet import schemas
from collabnet.functions.claims import ENTITY_SCHEMA
from collabnet.operators.index import dense_index
from collabnet.operators.lookup import null_no_info


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per ``<row_tag>`` element.

    The file is read as text records that end with the closing tag, so one big
    dump is split over many tasks; each record is then parsed with ``schema``.
    """
    closing = f"</{row_tag}>"
    records = spark.read.option("lineSep", closing).text(path)
    element = F.regexp_extract("value", rf"(?s)<{row_tag}[\s>].*$", 0)
    return (
        records.select(element.alias("element"))
        .where(F.col("element") != "")
        .select(F.from_xml(F.concat("element", F.lit(closing)), schema).alias("r"))
        .select("r.*")
    )


def infer_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """The same with an inferred schema, for files of unknown shape."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_dump(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the relational dump: unquoted tab-separated text, ``\\N`` for null."""
    wanted = schemas.DUMP_COLUMNS[table]
    width = max(pos for pos, _, _ in wanted) + 1
    raw = spark.read.csv(
        path, sep="\t", quote="", nullValue="\\N", schema=", ".join(f"_c{i} string" for i in range(width))
    )
    named = raw.select(*[F.col(f"_c{pos}").try_cast(kind).alias(name) for pos, name, kind in wanted])
    if table == "artist":
        return named.where(F.col("type") == "1").drop("type")
    return named


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON-array file with one entity per line (S3, S4), as struct column ``e``.

    Bracket lines are told by their content and only the claims in use are parsed.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return (
        lines.where(~F.col("value").isin("[", "]", ""))
        .select(F.from_json(F.regexp_replace("value", ",$", ""), ENTITY_SCHEMA).alias("e"))
        .where(F.col("e.id").isNotNull())
    )


def _in_file_order(small: DataFrame, first: int) -> DataFrame:
    placed = dense_index(small.withColumn("_line", F.monotonically_increasing_id()), ["_line"], out="ordinal")
    return placed.withColumn("ordinal", F.col("ordinal") + first).drop("_line")


def read_guests(spark: SparkSession, path: str) -> DataFrame:
    """Guest CSV (id, name) with a 1-based ``ordinal`` in file order."""
    return _in_file_order(spark.read.csv(path, header=True, schema=schemas.PEOPLE), 1)


def read_relevants(spark: SparkSession, path: str) -> DataFrame:
    """Relevant CSV (id, name, category) with a 0-based ``ordinal`` in file order."""
    return _in_file_order(spark.read.csv(path, header=True, schema=schemas.RELEVANTS), 0)


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Selected ids, tab-separated without header; "no info" is null."""
    raw = spark.read.csv(path, sep="\t", schema=schemas.SELECTION)
    return raw.select(
        F.col("discogs_id").try_cast("bigint").alias("discogs_id"),
        null_no_info("musicbrainz_id"),
        null_no_info("wikidata_id"),
    )


def _statements(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines.where(F.col("value").startswith("<"))


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (subject, verb, object, context) of N-quad statements."""
    term = r"<([^>]+)>\s+"
    pattern = rf"^{term}{term}{term}<([^>]+)>\s*\.\s*$"
    names = ["subject", "verb", "object", "context"]
    return (
        _statements(spark, path)
        .where(F.col("value").rlike(pattern))
        .select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])
        .distinct()
    )


def read_entity_types(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (entity, type): first term and last path segment of the third."""
    terms = F.split("value", r"\s+")
    return (
        _statements(spark, path)
        .select(F.get(terms, F.lit(0)).alias("entity"), F.regexp_extract(F.get(terms, F.lit(2)), r"([^/>]+)>$", 1).alias("type"))
        .distinct()
    )


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """Stored paths of all keys; schemas of separately written keys are merged."""
    return spark.read.option("mergeSchema", True).parquet(path)
