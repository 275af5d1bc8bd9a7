"""Area hierarchy, label look-up and resolution of artists across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collabnet.functions import urls as u
from collabnet.functions.arrays import (
    blank_to_null,
    concat_distinct,
    drop_nulls,
    head,
    or_empty,
    tagged,
    tail,
)
from collabnet.session import cut_lineage, left_join, stored

COUNTRY_TYPE = 1  # fixed value: area type of a country
LOOKED_UP = 1_000_000  # labels that every task holds


def area_countries(areas: DataFrame, links: DataFrame, country_type: int = COUNTRY_TYPE) -> DataFrame:
    """(areaID, country): first country on every branch upwards, an area being its own first level.

    ``areas`` is (areaID, area_name, area_type), ``links`` is (areaID, area2ID)
    with area2ID the parent. An area with several parents may have several
    countries; one without a country above it has none.

    Jump pointers: after round k a pair leads from an area to a place 2^k steps up that
    is no country and has none on the way; countries met before are set down. A branch
    of d steps takes log2 d rounds. A simple branch is no longer than there are links,
    so rounds end there, and what still goes in a cycle has met no country.
    """
    countries = areas.where(F.col("area_type") == country_type).select(
        F.col("areaID").alias("at"), F.col("area_name").alias("country")
    )
    steps = links.select("areaID", F.col("area2ID").alias("at")).distinct()
    steps = steps.join(countries.select(F.col("at").alias("areaID")), "areaID", "left_anti").join(countries, "at", "left")
    steps = cut_lineage(steps.select("areaID", "at", "country"))
    jumps = steps.where(F.col("country").isNull()).select("areaID", "at")
    met = cut_lineage(steps.where(F.col("country").isNotNull()).select("areaID", "country").distinct())
    longest, reach = steps.count(), 1
    while reach < longest and not jumps.isEmpty():
        above = jumps.join(met.withColumnRenamed("areaID", "at"), "at").select("areaID", "country")
        met = cut_lineage(met.unionByName(above).distinct())
        onward = jumps.select(F.col("areaID").alias("at"), F.col("at").alias("next"))
        jumps = cut_lineage(jumps.join(onward, "at").select("areaID", F.col("next").alias("at")).distinct())
        reach *= 2
    own = countries.join(areas.select(F.col("areaID").alias("at")).distinct(), "at", "left_semi")
    known = areas.select("areaID").distinct()
    return own.withColumnRenamed("at", "areaID").unionByName(met.join(known, "areaID", "left_semi")).distinct()


def url_columns(artist_urls: DataFrame, urls: DataFrame, key: str = "id") -> DataFrame:
    """Per artist: ids and addresses found among its URLs, and the other URLs.

    Of several addresses of one source the first in text order counts.
    """
    listed = artist_urls.join(urls, "urlID", "left")
    url = F.col("url")
    is_primary, is_kb = F.contains(url, F.lit(u.PRIMARY_PROFILE)), F.contains(url, F.lit(u.KB_PROFILE))
    found = listed.groupBy(key).agg(
        F.min(F.when(is_primary, url)).alias("discogs_url"),
        F.min(F.when(is_kb, url)).alias("wikidata_url"),
        F.array_sort(F.collect_list(F.when(~is_primary & ~is_kb, url))).alias("other_urls"),
    )
    return found.select(
        key,
        u.last_segment(F.col("discogs_url")).alias("discogs_id"),
        u.last_segment(F.col("wikidata_url")).alias("wikidata_id"),
        "discogs_url",
        "wikidata_url",
        "other_urls",
    )


def mb_artists(
    artists: DataFrame, areas: DataFrame, links: DataFrame, artist_urls: DataFrame, urls: DataFrame
) -> DataFrame:
    """Relational-dump artists with their URLs and country."""
    return (
        artists.join(url_columns(artist_urls, urls), "id", "left")
        .join(area_countries(areas, links), "areaID", "left")
        .drop("areaID", "id")
        .distinct()
    )


def regroup_labels(entities: DataFrame, labels: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """Replace lists of ids by sorted lists of their labels (J7); ``lists`` maps output to id column.

    The labels of the ids that are listed most are sent to all tasks and looked up in
    place, as many as ``LOOKED_UP`` bounds; only the other ids are dealt out with their
    key to meet their labels, and the labels found come back as rows of their own.
    """
    listed = [or_empty(F.col(ids)) for ids in lists.values()]
    ends = [sum((F.size(c) for c in listed[1:i]), F.size(listed[0])) for i in range(1, len(listed))]
    used = entities.select(key, F.array(*ends).cast("array<int>").alias("ends"), F.posexplode(F.concat(*listed)).alias("place", "id"))
    number = sum(((F.col("place") >= F.get("ends", F.lit(i))).cast("int") for i in range(len(ends))), F.lit(0))
    used = used.select(key, number.alias("list"), "id")
    counts = entities.select(F.explode(F.concat(*listed)).alias("id")).where(F.col("id").isNotNull())
    counts = counts.groupBy("id").agg(F.count("*").alias("n"))
    known = stored(counts.join(labels.select("id", "label"), "id", "left"))
    least = _least_of_most(known, "n", LOOKED_UP)
    here = known.where(F.col("n") >= least).select("id", "label", F.lit(True).alias("here"))
    looked = used.join(F.broadcast(here), "id", "left")  # bounded by LOOKED_UP
    found = looked.select(key, "list", "label")
    rest = known.where((F.col("n") < least) & F.col("label").isNotNull()).select("id", "label")
    if not rest.isEmpty():
        away = looked.where(F.col("here").isNull()).select(key, "list", "id")
        found = found.unionByName(away.join(rest.hint("merge"), "id").select(key, "list", "label"))
    return found.groupBy(key).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("list") == i, F.col("label")))).alias(out) for i, out in enumerate(lists)]
    )


def _least_of_most(rows: DataFrame, n: str, most: int) -> int:
    """The least number so that at most ``most`` rows have an ``n`` of it or more."""
    ahead = F.sum("rows").over(Window.orderBy(F.col(n).desc()))  # a row for each number there is
    found = rows.groupBy(n).agg(F.count("*").alias("rows")).select(n, ahead.alias("ahead")).where(F.col("ahead") <= most)
    return found.agg(F.coalesce(F.min(n), F.lit(1 << 62))).first()[0]


def kb_artists(entities: DataFrame, labels: DataFrame, strict_ids: bool = False) -> DataFrame:
    """Knowledge-base artists with labels in place of ids.

    An entity without a primary id has a null one; ``strict_ids`` gives it 0.
    """
    named = regroup_labels(
        entities,
        labels,
        "wikidata_id",
        {"genres3": "genre_ids", "instruments": "instrument_ids", "citizenships": "citizenship_ids"},
    )
    ident = u.lenient_id(F.col("discogs_id"))
    if strict_ids:
        ident = F.when(F.col("discogs_id").isNull(), F.lit(0).cast("bigint")).otherwise(ident)
    return (
        entities.join(named, "wikidata_id", "left")
        .select(
            "wikidata_id",
            ident.alias("discogs_id"),
            "musicbrainz_id",
            "name",
            drop_nulls(F.col("images")).alias("images"),
            drop_nulls(F.col("links")).alias("wikidata_links"),
            drop_nulls(F.col("genres3")).alias("genres3"),
            drop_nulls(F.col("instruments")).alias("instruments"),
            drop_nulls(F.col("citizenships")).alias("citizenships"),
            "date_of_birth_calendar",
        )
        .distinct()
    )


def _mb_by(mb: DataFrame, key: str, others: list[str], tag: str) -> DataFrame:
    """Relational-dump rows rolled up by one id (A6); rows without that id cannot match and are left out.

    List elements are made distinct before they are collected.

    The smallest of the other ids stands for "the first one", so the result does
    not depend on row order.
    """
    known = mb.where(F.col(key).isNotNull())
    firsts = known.groupBy(key).agg(*[F.min(o).alias(f"{o}{tag}") for o in others])
    lists = {"country": F.array("country"), "wikidata_url": F.array("wikidata_url"), "other_urls": F.col("other_urls")}
    facts = (
        known.select(key, F.explode(tagged(lists)).alias("f"))
        .select(key, "f.list", "f.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    listed = facts.groupBy(key).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("list") == n, F.col("value")))).alias(f"{n}{tag}") for n in lists]
    )
    return firsts.join(listed, key, "left").select(
        *firsts.columns, *[or_empty(F.col(f"{n}{tag}")).alias(f"{n}{tag}") for n in lists]
    )


def resolve_sources(kb: DataFrame, mb: DataFrame) -> DataFrame:
    """Full outer match of knowledge-base rows with dump rows by each of three ids.

    ``kb``: wikidata_id, discogs_id bigint, musicbrainz_id, ...; ``mb``:
    musicbrainz_id, discogs_id, wikidata_id, country, wikidata_url, other_urls.
    """
    mb = mb.withColumn("discogs_id", F.col("discogs_id").try_cast("bigint"))
    by_mb = _mb_by(mb, "musicbrainz_id", ["discogs_id", "wikidata_id"], "1")
    by_primary = _mb_by(mb, "discogs_id", ["musicbrainz_id", "wikidata_id"], "2")
    by_kb = _mb_by(mb, "wikidata_id", ["discogs_id", "musicbrainz_id"], "3")
    # The full outer chain kb - by_mb - by_primary - by_kb. Rows that enter from one of the
    # roll-ups have no other id to match on, so the chain is kb left-joined three times,
    # plus the rows of each roll-up that no kb row has the id of.
    matched = kb
    for rolled, key in ((by_mb, "musicbrainz_id"), (by_primary, "discogs_id"), (by_kb, "wikidata_id")):
        matched = left_join(matched, rolled, key)
    for rolled, key in ((by_mb, "musicbrainz_id"), (by_primary, "discogs_id"), (by_kb, "wikidata_id")):
        alone = rolled.join(kb.select(key).distinct(), key, "left_anti")
        matched = matched.unionByName(alone, allowMissingColumns=True)
    c = F.col
    mb_id = F.coalesce("musicbrainz_id", "musicbrainz_id2", "musicbrainz_id3")
    return matched.select(
        F.coalesce("wikidata_id", "wikidata_id2", "wikidata_id1").alias("wikidata_id"),
        mb_id.alias("musicbrainz_id"),
        F.coalesce("discogs_id", "discogs_id1", "discogs_id3").alias("discogs_id"),
        concat_distinct(c("wikidata_url1"), c("wikidata_url2"), c("wikidata_url3"), c("wikidata_links")).alias(
            "wikidata_links"
        ),
        concat_distinct(c("country1"), c("country2"), c("country3"), c("citizenships")).alias("citizenships"),
        concat_distinct(c("other_urls1"), c("other_urls2"), c("other_urls3")).alias("other_urls"),
        u.profile_url(u.MB_PROFILE, mb_id).alias("musicbrainz_url"),
        "images",
        "instruments",
        "genres3",
        "date_of_birth_calendar",
    )


_LISTS = ("wikidata_links", "images", "instruments", "citizenships", "genres3", "other_urls")


def _first_id(ids: str) -> Column:
    return blank_to_null(head(F.col(ids)))


def resolved_rollup(resolved: DataFrame) -> DataFrame:
    """One row per primary id (A7): sorted sets of ids split into the first and the others, merged lists.

    The list elements are made distinct before they are collected, so many
    matched rows of one id shrink on the map side.
    """
    matched = resolved.where(F.col("discogs_id").isNotNull())
    ids = matched.groupBy("discogs_id").agg(
        F.array_sort(F.collect_set("musicbrainz_id")).alias("mb_ids"),
        F.array_sort(F.collect_set("wikidata_id")).alias("kb_ids"),
        F.array_sort(F.collect_set("musicbrainz_url")).alias("musicbrainz_url"),
        F.min("date_of_birth_calendar").alias("date_of_birth_calendar"),
    )
    spread = tagged({n: F.col(n) for n in _LISTS})
    facts = (
        matched.select("discogs_id", F.explode(spread).alias("f"))
        .select("discogs_id", "f.list", "f.value")
        .where(F.col("value").isNotNull())
        .distinct()
    )
    lists = facts.groupBy("discogs_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("list") == n, F.col("value")))).alias(n) for n in _LISTS]
    )
    return ids.join(lists, "discogs_id", "left").select(
        "discogs_id",
        _first_id("kb_ids").alias("wikidata_id"),
        tail(F.col("kb_ids")).alias("wikidata_id_others"),
        _first_id("mb_ids").alias("musicbrainz_id"),
        tail(F.col("mb_ids")).alias("musicbrainz_id_others"),
        "musicbrainz_url",
        "date_of_birth_calendar",
        *[or_empty(F.col(n)).alias(n) for n in _LISTS],
    )


def unify_artists(primary: DataFrame, rolled: DataFrame) -> DataFrame:
    """Primary artists with what the other sources know (J9): the unified artist table.

    ``primary``: id_artist, name, namevariations, urls, profile, genres, roles_artist.
    """

    def listed(name: str) -> Column:
        return drop_nulls(F.col(name)).alias(name)

    return (
        primary.withColumnRenamed("id_artist", "discogs_id")
        .join(rolled, "discogs_id", "left")
        .select(
            "discogs_id",
            "wikidata_id",
            listed("wikidata_id_others"),
            "musicbrainz_id",
            listed("musicbrainz_id_others"),
            "name",
            listed("namevariations"),
            listed("urls"),
            "other_urls",
            drop_nulls(F.col("roles_artist")).alias("roles"),
            u.primary_url(F.col("discogs_id"), F.col("name")).alias("url_discogs"),
            listed("wikidata_links"),
            listed("musicbrainz_url"),
            listed("images"),
            F.array().cast("array<string>").alias("image_links"),
            listed("instruments"),
            listed("citizenships"),
            "date_of_birth_calendar",
            concat_distinct(F.col("genres"), F.col("genres3")).alias("genres"),
            "profile",
        )
        .distinct()
    )
