"""Name search and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collabnet.functions.text import file_form, search_form
from collabnet.operators.containment import matching

NO_INFO = "no info"  # fixed value: written where a source has no id


def search_names(artists: DataFrame, terms: list[str] | DataFrame, name: str = "name", literal: bool = False) -> DataFrame:
    """One row per (artist, matching term): the artist columns and ``search_name``.

    A term is a pattern, or plain text with ``literal``; underscores count as spaces.
    The terms of a list are constants, so the artists are scanned once and nothing is
    joined; those of a table (term) meet the distinct names by their trigrams.
    """
    formed = artists.withColumn("_form", search_form(F.col(name)))
    if not isinstance(terms, DataFrame):

        def hit(term: str):
            matches = F.contains("_form", F.lit(term)) if literal else F.col("_form").rlike(term)
            return F.when(matches, F.lit(term))

        hits = F.array_compact(F.array(*[hit(t.replace("_", " ").lower()) for t in terms]))
        return formed.withColumn("search_name", F.explode(hits)).drop("_form")
    asked = terms.select(F.lower(F.translate("term", "_", " ")).alias("term"))
    found = matching(formed.select(F.col("_form").alias("text")), asked, literal)
    named = found.select(F.col("text").alias("_form"), F.col("term").alias("search_name"))
    return formed.join(named, "_form").select(*artists.columns, "search_name")


def selection_to_guests(selection: DataFrame, candidates: DataFrame) -> DataFrame:
    """Guests (id, name) from the chosen primary ids; names in file form."""
    return candidates.join(selection.select("discogs_id").distinct(), "discogs_id", "left_semi").select(
        F.col("discogs_id").alias("id"), file_form(F.col("name")).alias("name")
    ).distinct()


def selected_ids(selection: DataFrame) -> DataFrame:
    """The selection as written for the update: "no info" where a source has no id."""
    return selection.select(
        "discogs_id",
        F.coalesce("musicbrainz_id", F.lit(NO_INFO)).alias("musicbrainz_id"),
        F.coalesce("wikidata_id", F.lit(NO_INFO)).alias("wikidata_id"),
    )


def null_no_info(name: str):
    return F.nullif(F.col(name), F.lit(NO_INFO)).alias(name)
