"""Claims and texts of knowledge-base entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from collabnet.functions.urls import last_segment, media_page_url

# Properties read from an entity.
P_INSTANCE = "P31"
P_OCCUPATION = "P106"
P_INSTRUMENT = "P1303"
P_PRIMARY_ID = "P1953"
P_MB_ID = "P434"
P_ALLMUSIC_ID = "P1728"
P_SONGKICK_ID = "P3478"
P_IMAGE = "P18"
P_CITIZENSHIP = "P27"
P_GENRE = "P136"
P_BIRTH = "P569"
HUMAN = "Q5"

_TEXT = "array<struct<mainsnak:struct<datavalue:struct<value:string>>>>"
_ITEM = "array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>"
_TIME = "array<struct<mainsnak:struct<datavalue:struct<value:struct<time:string,calendarmodel:string>>>>>"

_CLAIM_TYPES = {
    P_INSTANCE: _ITEM,
    P_OCCUPATION: _ITEM,
    P_INSTRUMENT: _ITEM,
    P_PRIMARY_ID: _TEXT,
    P_MB_ID: _TEXT,
    P_ALLMUSIC_ID: _TEXT,
    P_SONGKICK_ID: _TEXT,
    P_IMAGE: _TEXT,
    P_CITIZENSHIP: _ITEM,
    P_GENRE: _ITEM,
    P_BIRTH: _TIME,
}

ENTITY_SCHEMA = (
    "id string, labels struct<en:struct<value:string>>, descriptions struct<en:struct<value:string>>, "
    "sitelinks map<string,struct<site:string,title:string>>, claims struct<"
    + ",".join(f"{p}:{t}" for p, t in _CLAIM_TYPES.items())
    + ">"
)


def _claim(entity: str, prop: str) -> Column:
    return F.col(f"{entity}.claims.{prop}")


def _values(claim: Column) -> Column:
    return F.array_compact(
        F.transform(F.coalesce(claim, F.array()), lambda c: c.mainsnak.datavalue.value)
    )


def first_text(entity: str, prop: str) -> Column:
    """First resolvable value of a text claim, cut at a comma, without quotes and brackets."""
    value = F.get(_values(_claim(entity, prop)), F.lit(0))
    return F.substring_index(F.regexp_replace(value, r'["\[\]]', ""), ",", 1)


def item_ids(entity: str, prop: str) -> Column:
    """All item ids of a claim."""
    return F.array_compact(F.transform(_values(_claim(entity, prop)), lambda v: v.id))


def birth_dates(entity: str) -> Column:
    """array<struct<time, calendar>> of the birth claim."""
    dated = F.filter(
        _values(_claim(entity, P_BIRTH)), lambda v: v.time.isNotNull() & v.calendarmodel.isNotNull()
    )
    return F.transform(
        dated, lambda v: F.struct(v.time.alias("time"), last_segment(v.calendarmodel).alias("calendar"))
    )


def english(entity: str, field: str) -> Column:
    """English label or description without quotes; missing gives an empty text."""
    return F.replace(F.coalesce(F.col(f"{entity}.{field}.en.value"), F.lit("")), F.lit('"'), F.lit(""))


def images(entity: str) -> Column:
    """Media page addresses of the image claim."""
    return F.transform(_values(_claim(entity, P_IMAGE)), media_page_url)


def site_links(entity: str) -> Column:
    """Encyclopedia addresses from the site links."""
    links = F.coalesce(F.map_values(F.col(f"{entity}.sitelinks")), F.array())
    wikis = F.filter(links, lambda s: s.site.rlike(r"^\w+wiki$") & s.title.isNotNull())
    return F.transform(
        wikis,
        lambda s: F.concat(
            F.lit("https://"),
            F.substring_index(s.site, "wiki", 1),
            F.lit(".wikipedia.org/wiki/"),
            F.replace(s.title, F.lit(" "), F.lit("_")),
        ),
    )


def is_human(entity: str) -> Column:
    """Exactly one resolvable instance-of value, and it is the human class."""
    kinds = item_ids(entity, P_INSTANCE)
    return (F.size(kinds) == 1) & (F.get(kinds, F.lit(0)) == HUMAN)


def is_in_music(entity: str) -> Column:
    """Has any music id, plays an instrument or has an occupation."""
    props = [P_PRIMARY_ID, P_MB_ID, P_ALLMUSIC_ID, P_SONGKICK_ID, P_INSTRUMENT, P_OCCUPATION]
    named = _claim(entity, props[0]).isNotNull()
    for prop in props[1:]:
        named = named | _claim(entity, prop).isNotNull()
    return named
