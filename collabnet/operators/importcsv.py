"""Two graph models of releases for import into a graph store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collabnet.functions.text import escaped_name, html_escape

NO_INFO = "no info"
START_ARTIST, END_ARTIST = ":START_ID(Artist)", ":END_ID(Artist)"
START_COLLABORATOR, END_RELEASE = ":START_ID(Collaborator)", ":END_ID(Release)"


def filled(releases: DataFrame) -> DataFrame:
    """Releases with missing date and country written out."""
    return releases.na.fill(NO_INFO, ["released", "country"])


def collaborations(releases: DataFrame) -> DataFrame:
    """One row per credited collaborator (F39); releases without such a list are left out.

    ``releases``: discogs_id, title, released, country, extras_names,
    extras_ids, extras_roles (parallel lists).
    """
    listed = filled(releases).where(F.col("extras_names").isNotNull())
    one = F.explode(F.arrays_zip("extras_names", "extras_ids", "extras_roles"))
    return listed.select("title", "released", "country", "discogs_id", one.alias("c")).select(
        "title",
        "released",
        "country",
        "discogs_id",
        escaped_name(F.col("c.extras_names")).alias("colab_name"),
        F.col("c.extras_ids").alias("colab_id"),
        F.col("c.extras_roles").alias("colab_role"),
    )


def main_artists(releases: DataFrame, artists: DataFrame) -> DataFrame:
    """Main artists of each release with the id their name has in the artist table, if any."""
    known = artists.select(F.col("name").alias("artist_name"), F.col("id").alias("artist_discogs_id"))
    named = releases.select("title", "discogs_id", F.explode("artists_names").alias("artist_name"))
    return named.join(known, "artist_name", "left").select(
        html_escape(F.col("title")).alias("title"),
        "discogs_id",
        html_escape(F.lower(F.trim("artist_name"))).alias("artist_name"),
        "artist_discogs_id",
    )


def artist_nodes(main: DataFrame) -> DataFrame:
    return (
        main.where(F.col("artist_discogs_id").isNotNull())
        .select(F.col("artist_discogs_id").alias("artistId:ID(Artist)"), F.col("artist_name").alias("name"))
        .distinct()
    )


def _real(collaborators: DataFrame) -> DataFrame:
    """Collaborators with an id (P24); 0 means none."""
    return collaborators.where(F.col("colab_id").isNotNull() & (F.col("colab_id") != 0))


def collaborator_nodes(collaborators: DataFrame, header: str = "collabId:ID(Collaborator)") -> DataFrame:
    return _real(collaborators).select(
        F.col("colab_id").alias(header), F.col("colab_name").alias("name")
    ).distinct()


def artist_model_nodes(main: DataFrame, collaborators: DataFrame) -> DataFrame:
    """Model 1: all artists, main or credited, as one kind of node."""
    return artist_nodes(main).union(collaborator_nodes(collaborators, "artistId:ID(Artist)")).distinct()


def played_with_relations(main: DataFrame, collaborators: DataFrame) -> DataFrame:
    """Model 1: collaborator -> main artist of the same release, never to itself."""
    known = main.select("discogs_id", "artist_discogs_id").where(F.col("artist_discogs_id").isNotNull())
    return (
        _real(collaborators)
        .join(known, "discogs_id")
        .where(F.col("colab_id") != F.col("artist_discogs_id"))
        .select(
            "discogs_id",
            "colab_name",
            F.col("colab_id").alias(START_ARTIST),
            F.col("artist_discogs_id").alias(END_ARTIST),
            F.col("colab_role").alias("role"),
            "title",
            F.col("released").alias("year"),
            "country",
        )
        .distinct()
        .drop("discogs_id", "colab_name")
    )


def release_nodes(releases: DataFrame) -> DataFrame:
    """Model 2: releases as nodes."""
    return filled(releases).select(
        F.col("discogs_id").alias("releaseId:ID(Release)"), "title", "country", "released"
    ).distinct()


def performed_in(main: DataFrame) -> DataFrame:
    """Model 2: main artist -> release."""
    return main.where(F.col("artist_discogs_id").isNotNull()).select(
        F.col("artist_discogs_id").alias(START_ARTIST), F.col("discogs_id").alias(END_RELEASE)
    )


def credited_in(collaborators: DataFrame) -> DataFrame:
    """Model 2: collaborator -> release with the role."""
    return (
        _real(collaborators)
        .distinct()
        .select(
            F.col("colab_id").alias(START_COLLABORATOR),
            F.col("discogs_id").alias(END_RELEASE),
            F.col("colab_role").alias("role"),
        )
    )
