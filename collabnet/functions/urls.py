"""URLs of profiles, home pages and media."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from collabnet.functions.arrays import drop_nulls, head

# Address formats of the data sources.
PRIMARY_PROFILE = "https://www.discogs.com/artist/"
MB_PROFILE = "https://musicbrainz.org/artist/"
KB_PROFILE = "https://www.wikidata.org/wiki/"
COMMONS_FILE = "https://commons.wikimedia.org/wiki/File:"
COMMONS_UPLOAD = "https://upload.wikimedia.org/wikipedia/commons"
ENCYCLOPEDIA = "wikipedia.org"
PROFILE_HOSTS = {
    "allMusicUrl": "allmusic.com",
    "facebookUrl": "facebook.com",
    "imdbUrl": "imdb.com",
    "mySpaceUrl": "myspace.com",
    "instagramUrl": "instagram.com",
}
NOT_HOME_PAGES = [
    "discogs.com",
    "twitter.com",
    "imdb.com",
    "facebook.com",
    "myspace.com",
    "instagram.com",
    "repertoire.bmi.com",
]


def profile_url(base: str, ident: Column) -> Column:
    """Base address plus id; null id gives null."""
    return F.concat(F.lit(base), ident)


def primary_url(ident: Column, name: Column) -> Column:
    """Primary-source page: id and dashed name."""
    return F.concat(
        F.lit(PRIMARY_PROFILE), ident.cast("string"), F.lit("-"), F.regexp_replace(F.trim(name), r"\s+", "-")
    )


def first_with(urls: Column, part: str) -> Column:
    """First URL that contains ``part``."""
    return head(F.filter(urls, lambda u: F.contains(u, F.lit(part))))


def last_segment(url: Column) -> Column:
    """Text after the last slash, not counting trailing slashes."""
    return F.substring_index(F.rtrim(url, F.lit("/")), "/", -1)


def without(urls: Column, parts: list[str]) -> Column:
    """URLs that contain none of ``parts`` (F8)."""
    return F.filter(urls, lambda u: ~reduce(or_, [F.contains(u, F.lit(part)) for part in parts]))


def lenient_id(c: Column) -> Column:
    """Number from "123" or ".../123-some-name"; null where there is none."""
    return F.split_part(last_segment(c), F.lit("-"), F.lit(1)).try_cast("bigint")


def media_hash_url(name: Column) -> Column:
    """Upload address of a media file, by the digest of its name."""
    digest = F.md5(name)
    return F.concat(
        F.lit(COMMONS_UPLOAD + "/"),
        F.substring(digest, 1, 1),
        F.lit("/"),
        F.substring(digest, 1, 2),
        F.lit("/"),
        name,
    )


def media_page_url(name: Column) -> Column:
    """Page of a media file, spaces as underscores."""
    return F.concat(F.lit(COMMONS_FILE), F.replace(name, F.lit(" "), F.lit("_")))


def image_file(ident: Column) -> Column:
    """Image file name of an id."""
    return F.concat(ident.cast("string"), F.lit(".jpg"))


def all_urls(*lists: Column) -> Column:
    """Non-null URLs of several lists, in order."""
    return F.concat(*[drop_nulls(c) for c in lists])


def shortest(urls: Column) -> Column:
    """Shortest URL, the first one among equals."""
    ranked = F.transform(urls, lambda u, i: F.struct(F.length(u).alias("n"), i.alias("i"), u.alias("u")))
    return F.array_min(ranked).getField("u")


def best_encyclopedia_url(urls: Column) -> Column:
    """Spanish page, else English, else any, without media commons."""
    pages = F.filter(
        urls, lambda u: F.contains(u, F.lit(ENCYCLOPEDIA)) & ~F.contains(u, F.lit("commons." + ENCYCLOPEDIA))
    )
    return F.coalesce(first_with(pages, "es." + ENCYCLOPEDIA), first_with(pages, "en." + ENCYCLOPEDIA), head(pages))


def best_host_url(urls: Column, host: str) -> Column:
    """Shortest URL on ``www.host``, else on ``host``."""

    def on(prefix: str) -> Column:
        return F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(f"{prefix}{host}/")))

    return F.coalesce(shortest(on("//www.")), shortest(on("//")))


def home_page(name: Column, urls: Column) -> Column:
    """Guess the own site: a .com address that carries the whole name, its last word, or any word.

    A name without words has no home page.
    """
    words = F.filter(
        F.transform(F.split(name, " "), lambda w: F.lower(F.regexp_replace(w, r"\(\d*\)$", ""))),
        lambda w: w != "",
    )
    dot_com = F.concat(
        F.filter(urls, lambda u: F.endswith(u, F.lit(".com"))),
        F.filter(urls, lambda u: F.contains(u, F.lit(".com/"))),
    )
    sites = without(dot_com, NOT_HOME_PAGES)

    def front(u: Column) -> Column:
        return F.substring_index(F.lower(u), ".com", 1)

    whole = F.filter(sites, lambda u: F.forall(words, lambda w: F.contains(front(u), w)))
    last = F.filter(sites, lambda u: F.contains(front(u), F.get(words, F.size(words) - 1)))
    some = F.filter(sites, lambda u: F.exists(words, lambda w: F.contains(front(u), w)))
    return F.when(F.size(words) > 0, F.coalesce(shortest(whole), shortest(last), shortest(some)))
