"""Credit filters and roll-ups.

Counts per group are aggregated and joined back, not taken in a window: the
window would hold a crowded release, or all credits without a master, in one
task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.functions.arrays import or_empty, split_roles, tagged
from collabnet.functions.text import has_special_characters
from collabnet.operators.containment import contained

# Role words that exclude a credit, matched as lower-case substrings.
DENIED_ROLES = [
    "produc", "written", "engineer", "mixed", "mastered", "arranged", "photo", "recorded", "design",
    "composed", "lyrics", "liner notes", "artwork", "photography", "management", "cover", "layout",
    "remix", "programmed", "featuring", "compiled", "dj mix", "edit", "illustra", "remastered",
    "songwriter", "a&r", "orchestrated", "ensemble", "graphics", "cut by", "sleeve notes", "supervis",
    "coordinator", "technician", "recording", "presenter", "painting", "concept", "band", "text",
    "recorder", "technology", "microphone", "translate", "research", "material", "book", "video",
    "image", "stylist", "hair", "makeup", "creat", "adapted", "film", "libretto", "interview",
    "cameraman", "typograph", "assistant", "crew", "words", "narrator",
]

# The role given to the artists of the release itself, the words
# of compilations, and the id that stands for "various artists".
MAIN_ROLE = "Release Performer"
COMPILATION_WORDS = ["compil", "sampler"]
VARIOUS_ARTISTS = 194


def any_word(words: list[str]) -> str:
    """Pattern for "contains one of ``words``"; words implied by a shorter one are left out."""
    lowered = sorted({w.lower() for w in words}, key=lambda w: (len(w), w))
    needed = []
    for word in lowered:
        if not any(short in word for short in needed):
            needed.append(word)
    return "|".join(re.escape(w) for w in needed)


def wanted_roles(roles: Column, allowed: list[str], denied: list[str] = DENIED_ROLES) -> Column:
    """Roles of a list with an allowed and without a denied word (P3); the denied word wins. For few words."""
    deny, allow = any_word(denied), any_word(allowed)
    return F.filter(roles, lambda r: ~F.lower(r).rlike(deny) & F.lower(r).rlike(allow))


def judged_roles(roles: DataFrame, allowed: list[str] | DataFrame, denied: list[str] | DataFrame = DENIED_ROLES) -> DataFrame:
    """(text): the lower-cased texts of ``roles`` (text) with an allowed and without a denied word.

    Each distinct text is judged once, by one pattern for a list of words and by their
    trigrams for a table of them.
    """
    texts = roles.select(F.lower("text").alias("text")).distinct()

    def having(words: list[str] | DataFrame) -> DataFrame:
        if isinstance(words, DataFrame):
            return contained(texts, words.select(F.lower("word").alias("word"))).select("text").distinct()
        return texts.where(F.col("text").rlike(any_word(words)))

    return having(allowed).join(having(denied), "text", "left_anti")


def instrument_words(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """(word): lower-cased labels of everything some entity plays, as an allow list by rule."""
    played = entities.select(F.explode("instrument_ids").alias("id")).distinct()
    return (
        labels.join(played, "id", "left_semi")
        .select(F.lower("label").alias("word"))
        .where(F.col("word") != "")
        .distinct()
    )


def merge_credits(
    listed: DataFrame, event: str, allowed: list[str] | DataFrame, denied: list[str] | DataFrame = DENIED_ROLES
) -> DataFrame:
    """One row per (event, id) with distinct names and wanted roles (A1).

    ``listed`` has one row per listed credit: (event, id, name, role). The words are
    lists or tables (word). Role texts are judged before credits are shuffled, those
    without a wanted role vanish there.
    """
    roles = listed.where(F.col("id").isNotNull()).select(event, "id", "name", F.explode(split_roles(F.col("role"))).alias("role"))
    wanted = judged_roles(roles.select(F.col("role").alias("text")), allowed, denied)
    facts = roles.join(wanted, F.lower("role") == F.col("text"), "left_semi").distinct()
    return facts.groupBy(event, "id").agg(
        F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("role")).alias("roles")
    )


def multi_party(credits: DataFrame, event: str = "id_release") -> DataFrame:
    """Credits of events with more than one credit, with ``cant_arts``."""
    counts = credits.groupBy(event).agg(F.count("*").alias("cant_arts")).where(F.col("cant_arts") > 1)
    return credits.join(counts, event)


def one_version(
    credits: DataFrame, entity: str = "id_artist", event: str = "id_release", version: str = "master_id"
) -> DataFrame:
    """Keep entities with several credits, or whose master has one version (P5), with ``cant_vers``.

    All events without a master form one group, as one window partition would; its
    count is one number, and its rows are joined to nothing.
    """
    per_entity = credits.groupBy(entity).agg(F.count("*").alias("cant_rels"))
    counted = credits.join(per_entity, entity)
    named, bare = F.col(version).isNotNull(), F.col(version).isNull()
    per_version = credits.where(named).groupBy(version).agg(F.countDistinct(event).alias("cant_vers"))
    without = credits.where(bare).agg(F.countDistinct(event)).scalar()
    grouped = counted.where(named).join(per_version, version).select(*counted.columns, "cant_vers")
    every = grouped.unionByName(counted.where(bare).withColumn("cant_vers", without))
    return every.where((F.col("cant_rels") > 1) | (F.col("cant_vers") == 1))


def solo_artists(artists: DataFrame, members: str = "members_name", name: str = "name") -> DataFrame:
    """Artists without members, or with only themselves as member."""
    m = F.col(members)
    alone = (F.size(m) == 1) & (F.get(m, F.lit(0)) == F.col(name))
    return artists.where((F.size(m) == 0) | alone)


def plain_names(artists: DataFrame, name: str = "name") -> DataFrame:
    """Artists whose name has no special character; null names are dropped."""
    return artists.where(~has_special_characters(F.col(name)))


def compilations(words: list[str] = COMPILATION_WORDS, various: int = VARIOUS_ARTISTS) -> Column:
    """Whether a credit is on a compilation or by various artists."""
    pattern = any_word(words)
    compiled = F.exists(or_empty(F.col("formats")), lambda f: F.lower(f).rlike(pattern))
    by_various = F.array_contains(or_empty(F.col("primary_artists"), "bigint"), F.lit(various).cast("bigint"))
    return F.coalesce(compiled | by_various, F.lit(False))


def version_collapse(
    credits: DataFrame,
    entity: str = "id_artist",
    event: str = "id_release",
    version: str = "master_id",
    compilation_words: list[str] = COMPILATION_WORDS,
    various: int = VARIOUS_ARTISTS,
    dropped: str | None = None,
) -> DataFrame:
    """Versions of one release by one artist as their smallest release id.

    A credit without master is its own group, keyed by the negated release id.
    Whether any version is a compilation or by various artists is aggregated as
    a flag, so no list of all versions is ever collected. ``dropped`` names a column
    that holds the flag already (``compilations``), made before credits were dealt out.
    """
    flag = F.col(dropped) if dropped else compilations(compilation_words, various)
    return (
        credits.select(entity, event, F.coalesce(F.col(version), -F.col(event)).alias(version), flag.alias("_dropped"))
        .groupBy(entity, version)
        .agg(F.min(event).alias(event), F.max("_dropped").alias("_dropped"))
        .where(~F.col("_dropped"))
        .drop("_dropped")
    )


def artist_rollup(
    credits: DataFrame, entity: str = "id_artist", lists: tuple[str, ...] = ("genres", "roles_artist")
) -> DataFrame:
    """Distinct elements of list columns per entity, sorted (A4).

    The lists are spread to distinct (entity, column, element) facts first, so an
    entity with very many credits is reduced before its lists are collected.
    """
    spread = tagged({c: F.col(c) for c in lists})
    facts = (
        credits.select(entity, F.explode_outer(spread).alias("f")).select(entity, "f.list", "f.value").distinct()
    )
    return facts.groupBy(entity).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("list") == c, F.col("value")))).alias(c) for c in lists]
    )


def releases(credits: DataFrame) -> DataFrame:
    """Credit rows without their artist columns, distinct."""
    return credits.drop("id_artist", "names_artist", "roles_artist", "cant_rels").distinct()
