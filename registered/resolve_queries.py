"""Areas, URLs, labels and resolution across sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from collabnet.functions import urls as u
from collabnet.functions.arrays import as_list
from collabnet.operators import resolve as rs
from registered import bindings as b


def _areas(spark, sf):
    """Customers lie in nations, nations in regions; a customer in debt also lies in its own region."""
    region = b.table(spark, sf, "region").select(
        (F.col("r_regionkey") + 1).cast("bigint").alias("areaID"), F.col("r_name").alias("area_name"), F.lit(1).alias("area_type")
    )
    nation = b.table(spark, sf, "nation")
    customer = b.table(spark, sf, "customer")
    areas = region.unionByName(
        nation.select((F.col("n_nationkey") + 100).cast("bigint").alias("areaID"), F.col("n_name").alias("area_name"), F.lit(2).alias("area_type"))
    ).unionByName(
        customer.select((F.col("c_custkey") + 1000).alias("areaID"), F.col("c_name").alias("area_name"), F.lit(3).alias("area_type"))
    )
    links = nation.select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("areaID"), (F.col("n_regionkey") + 1).cast("bigint").alias("area2ID")
    ).unionByName(
        customer.select((F.col("c_custkey") + 1000).alias("areaID"), (F.col("c_nationkey") + 100).cast("bigint").alias("area2ID"))
    ).unionByName(
        customer.where("c_acctbal < 0").select(
            (F.col("c_custkey") + 1000).alias("areaID"), (F.col("c_custkey") % 5 + 1).alias("area2ID")
        )
    )
    return areas, links


def hierarchy_country(spark, sf):
    return rs.area_countries(*_areas(spark, sf))


def _page_urls(spark, sf):
    """Pages as URL rows of artists; http pages stand for profiles, .net pages for entities."""
    url, ident = F.col("url"), F.col("page_id").cast("string")
    shown = (
        F.when(url.startswith("http://"), F.concat(F.lit(u.PRIMARY_PROFILE), ident))
        .when(F.contains(url, F.lit(".net/")), F.concat(F.lit(u.KB_PROFILE + "Q"), ident))
        .otherwise(url)
    )
    pages = b.table(spark, sf, "pages")
    links = pages.select(F.length("url").cast("bigint").alias("id"), F.col("page_id").alias("urlID"))
    return links, pages.select(F.col("page_id").alias("urlID"), shown.alias("url"))


def url_ids(spark, sf):
    found = rs.url_columns(*_page_urls(spark, sf))
    return found.withColumn("other_urls", F.array_join("other_urls", "|"))


def mb_artists(spark, sf):
    """Customers as dump artists: their area's country and the URLs of the page of the same number."""
    areas, links = _areas(spark, sf)
    artists = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("m"), "c_custkey").alias("musicbrainz_id"),
        F.col("c_name").alias("artist_name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_custkey") + 1000).alias("areaID"),
    )
    _, urls = _page_urls(spark, sf)
    owned = b.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("urlID"))
    found = rs.mb_artists(artists, areas, links, owned, urls)
    return found.withColumn("other_urls", F.array_join("other_urls", "|"))


def _labels(spark, sf):
    part = b.table(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"))
    supplier = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("label")
    )
    return part.unionByName(supplier)


def kb_artists(spark, sf):
    """Orders as entities: customer and order number read as part and supplier ids."""
    shown = F.col("o_custkey").cast("string")
    entities = b.table(spark, sf, "orders").select(
        F.concat(F.lit("Q"), "o_orderkey").alias("wikidata_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(u.PRIMARY_PROFILE), shown, F.lit("-x")))
        .when(F.col("o_orderstatus") == "O", shown)
        .alias("discogs_id"),
        F.col("o_orderpriority").alias("musicbrainz_id"),
        F.col("o_orderstatus").alias("name"),
        F.array(F.concat(F.lit("P"), shown), F.concat(F.lit("P"), "o_orderkey")).alias("genre_ids"),
        F.array(F.concat(F.lit("S"), shown)).alias("instrument_ids"),
        F.array(F.concat(F.lit("P"), shown), F.lit("unknown")).alias("citizenship_ids"),
        F.lit(None).cast("array<string>").alias("images"),
        F.array("o_orderstatus", F.lit(None)).alias("links"),
        F.lit(None).cast("array<struct<time:string,calendar:string>>").alias("date_of_birth_calendar"),
    )
    named = rs.kb_artists(entities, _labels(spark, sf))
    return named.select(
        "wikidata_id", "discogs_id", "musicbrainz_id", "name", _text("genres3"), _text("instruments"),
        _text("citizenships"), _text("wikidata_links"), F.size("images").cast("bigint").alias("n_images"),
    )


def labels_regroup(spark, sf):
    """Every line as an entity that lists its part, its supplier read as a part, and its supplier."""
    part, supplier = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S"), "l_suppkey")
    entities = b.table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")
        ).alias("wikidata_id"),
        F.array(part, F.concat(F.lit("P"), "l_suppkey"), F.lit("unknown")).alias("genre_ids"),
        F.array(supplier).alias("instrument_ids"),
    )
    lists = {"genres": "genre_ids", "instruments": "instrument_ids"}
    named = rs.regroup_labels(entities, _labels(spark, sf), "wikidata_id", lists)
    return named.select(
        "wikidata_id",
        F.array_join("genres", "|").alias("genres"),
        F.array_join("instruments", "|").alias("instruments"),
    )


def _sources(spark, sf):
    """Orders stand for entities, customers for dump artists; ids are missing by status and segment."""
    orders = b.table(spark, sf, "orders")
    nation = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = b.table(spark, sf, "customer").join(nation, "c_nationkey")
    cust = F.col("o_custkey").cast("string")
    kb = orders.select(
        F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("wikidata_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("discogs_id"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("m"), cust)).alias("musicbrainz_id"),
        F.array("o_orderpriority").alias("images"),
        F.array(F.concat(F.lit("w"), cust)).alias("wikidata_links"),
        F.array("o_orderstatus").alias("genres3"),
        F.array("o_orderstatus", "o_orderpriority").alias("instruments"),
        F.array(cust).alias("citizenships"),
        F.array(
            F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"), F.lit("Q1985727").alias("calendar"))
        ).alias("date_of_birth_calendar"),
    )
    key = F.col("c_custkey").cast("string")
    entity = F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("Q"), key))
    mb = customer.select(
        F.concat(F.lit("m"), key).alias("musicbrainz_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", key).alias("discogs_id"),
        entity.alias("wikidata_id"),
        F.col("n_name").alias("country"),
        u.profile_url(u.KB_PROFILE, entity).alias("wikidata_url"),
        F.array("c_mktsegment", "c_name").alias("other_urls"),
    )
    return kb, mb


def _text(name):
    return F.array_join(F.array_sort(name), "|").alias(name)


def three_way_resolve(spark, sf):
    resolved = rs.resolve_sources(*_sources(spark, sf))
    return resolved.select(
        "wikidata_id",
        "musicbrainz_id",
        "discogs_id",
        "musicbrainz_url",
        _text("wikidata_links"),
        _text("citizenships"),
        _text("other_urls"),
        F.array_join("images", "|").alias("images"),
    )


def resolved_rollup(spark, sf):
    rolled = rs.resolved_rollup(rs.resolve_sources(*_sources(spark, sf)))
    return rolled.select(
        "discogs_id",
        "wikidata_id",
        F.array_join("wikidata_id_others", "|").alias("wikidata_id_others"),
        "musicbrainz_id",
        F.array_join("musicbrainz_id_others", "|").alias("musicbrainz_id_others"),
        F.get("date_of_birth_calendar", F.lit(0)).getField("time").alias("birth"),
        _text("images"),
        _text("instruments"),
        _text("citizenships"),
        _text("genres3"),
        _text("other_urls"),
        _text("wikidata_links"),
    )


def unify_artists(spark, sf):
    rolled = rs.resolved_rollup(rs.resolve_sources(*_sources(spark, sf)))
    primary = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id_artist"),
        F.col("c_name").alias("name"),
        as_list(F.col("c_mktsegment")).alias("namevariations"),
        F.array().cast("array<string>").alias("urls"),
        F.lit(None).cast("string").alias("profile"),
        F.array("c_mktsegment").alias("genres"),
        F.array("c_mktsegment").alias("roles_artist"),
    )
    unified = rs.unify_artists(primary, rolled)
    return unified.select(
        "discogs_id", "wikidata_id", "musicbrainz_id", "name", "url_discogs", _text("genres"), _text("roles"),
        _text("citizenships"), _text("musicbrainz_url"), F.size("image_links").cast("bigint").alias("n_image_links"),
    )


QUERIES = {
    "hierarchy_country": hierarchy_country,
    "url_ids": url_ids,
    "mb_artists": mb_artists,
    "kb_artists": kb_artists,
    "labels_regroup": labels_regroup,
    "three_way_resolve": three_way_resolve,
    "resolved_rollup": resolved_rollup,
    "unify_artists": unify_artists,
}

_SOURCES = f"""
kb as (select 'Q' || o_orderkey as wikidata_id,
    case when o_orderpriority <> '5-LOW' then o_custkey end as discogs_id,
    case when o_orderstatus <> 'F' then 'm' || o_custkey end as musicbrainz_id,
    [o_orderpriority] as images, ['w' || o_custkey] as links, [o_orderstatus] as genres3,
    [o_orderstatus, o_orderpriority] as instruments, [o_custkey::varchar] as citizenships,
    strftime(o_orderdate, '%Y-%m-%d') as birth from orders),
mb as (select 'm' || c_custkey as musicbrainz_id,
    case when c_mktsegment <> 'BUILDING' then c_custkey end as discogs_id,
    case when c_mktsegment <> 'MACHINERY' then 'Q' || c_custkey end as wikidata_id,
    n_name as country, case when c_mktsegment <> 'MACHINERY' then '{u.KB_PROFILE}Q' || c_custkey end as wikidata_url,
    [c_mktsegment, c_name] as other_urls
  from customer join nation on n_nationkey = c_nationkey),
m1 as (select musicbrainz_id, min(discogs_id) as discogs_id1, min(wikidata_id) as wikidata_id1, list(country) as c1,
    list(wikidata_url) as w1, flatten(list(other_urls)) as o1 from mb where musicbrainz_id is not null group by 1),
m2 as (select discogs_id, min(musicbrainz_id) as musicbrainz_id2, min(wikidata_id) as wikidata_id2, list(country) as c2,
    list(wikidata_url) as w2, flatten(list(other_urls)) as o2 from mb where discogs_id is not null group by 1),
m3 as (select wikidata_id, min(discogs_id) as discogs_id3, min(musicbrainz_id) as musicbrainz_id3, list(country) as c3,
    list(wikidata_url) as w3, flatten(list(other_urls)) as o3 from mb where wikidata_id is not null group by 1),
matched as (select * from kb full join m1 using (musicbrainz_id) full join m2 using (discogs_id)
    full join m3 using (wikidata_id)),
resolved as (select coalesce(wikidata_id, wikidata_id2, wikidata_id1) as wikidata_id,
    coalesce(musicbrainz_id, musicbrainz_id2, musicbrainz_id3) as musicbrainz_id,
    coalesce(discogs_id, discogs_id1, discogs_id3) as discogs_id,
    list_distinct(list_filter(coalesce(w1, []) || coalesce(w2, []) || coalesce(w3, []) || coalesce(links, []), lambda x: x is not null)) as wikidata_links,
    list_distinct(list_filter(coalesce(c1, []) || coalesce(c2, []) || coalesce(c3, []) || coalesce(citizenships, []), lambda x: x is not null)) as citizenships,
    list_distinct(list_filter(coalesce(o1, []) || coalesce(o2, []) || coalesce(o3, []), lambda x: x is not null)) as other_urls,
    images, instruments, genres3, birth from matched)"""


def _sorted(expr: str, name: str) -> str:
    return f"array_to_string(list_sort({expr}), '|') as {name}"


def _all(name: str) -> str:
    return f"list_sort(list_distinct(coalesce(flatten(list({name}) filter ({name} is not null)), [])))"


_ROLLED = f""",
rolled as (select discogs_id, list_sort(list(distinct wikidata_id) filter (wikidata_id is not null)) as k,
    list_sort(list(distinct musicbrainz_id) filter (musicbrainz_id is not null)) as m, min(birth) as birth,
    {_all('images')} as images, {_all('instruments')} as instruments, {_all('citizenships')} as citizenships,
    {_all('genres3')} as genres3, {_all('other_urls')} as other_urls, {_all('wikidata_links')} as wikidata_links
  from resolved where discogs_id is not null group by 1)"""

_AREAS = """
areas as (select r_regionkey + 1 as id, r_name as name, 1 as t from region
  union all select n_nationkey + 100, n_name, 2 from nation
  union all select c_custkey + 1000, c_name, 3 from customer),
links as (select n_nationkey + 100 as id, n_regionkey + 1 as parent from nation
  union all select c_custkey + 1000, c_nationkey + 100 from customer
  union all select c_custkey + 1000, c_custkey % 5 + 1 from customer where c_acctbal < 0),
walk as (select id, id as at, t from areas
  union select w.id, l.parent, a.t from walk w join links l on l.id = w.at join areas a on a.id = l.parent
  where w.t <> 1),
country as (select distinct w.id, a.name as country from walk w join areas a on a.id = w.at where w.t = 1)"""

_PAGES = f"""
p as (select length(url) as n, page_id,
    case when starts_with(url, 'http://') then '{u.PRIMARY_PROFILE}' || page_id
         when contains(url, '.net/') then '{u.KB_PROFILE}Q' || page_id else url end as url from pages)"""

SQL = {
    "hierarchy_country": f"with recursive {_AREAS} select id::bigint as areaID, country from country",
    "mb_artists": f"""with recursive {_AREAS}, {_PAGES}
select 'm' || c_custkey as musicbrainz_id, c_name as artist_name,
  case when contains(url, '{u.PRIMARY_PROFILE}') then page_id::varchar end as discogs_id,
  case when contains(url, '{u.KB_PROFILE}') then 'Q' || page_id end as wikidata_id,
  case when contains(url, '{u.PRIMARY_PROFILE}') then url end as discogs_url,
  case when contains(url, '{u.KB_PROFILE}') then url end as wikidata_url,
  case when contains(url, '{u.PRIMARY_PROFILE}') or contains(url, '{u.KB_PROFILE}') then '' else url end as other_urls, country
from customer left join p on page_id = c_custkey
left join country on id = c_custkey + 1000 and c_mktsegment <> 'MACHINERY'""",
    "kb_artists": """with g as (select o_orderkey as k, string_agg(p_name, '|' order by p_name) as g
  from orders join part on p_partkey = o_custkey or p_partkey = o_orderkey group by 1)
select 'Q' || o_orderkey as wikidata_id, case when o_orderstatus <> 'P' then o_custkey end as discogs_id,
  o_orderpriority as musicbrainz_id, o_orderstatus as name,
  case when o_orderkey = o_custkey and g is not null then g || '|' || g else coalesce(g, '') end as genres3,
  coalesce(s_name, '') as instruments, coalesce(p_name, '') as citizenships, o_orderstatus as wikidata_links, 0::bigint as n_images
from orders left join g on k = o_orderkey left join part on p_partkey = o_custkey left join supplier on s_suppkey = o_custkey""",
    "url_ids": f"""with p as (select length(url) as id, page_id,
    case when starts_with(url, 'http://') then '{u.PRIMARY_PROFILE}' || page_id
         when contains(url, '.net/') then '{u.KB_PROFILE}Q' || page_id else url end as url from pages),
l as (select id, list(url order by url) as urls from p group by 1),
f as (select id, list_filter(urls, lambda x: contains(x, '{u.PRIMARY_PROFILE}'))[1] as discogs_url,
    list_filter(urls, lambda x: contains(x, '{u.KB_PROFILE}'))[1] as wikidata_url,
    list_filter(urls, lambda x: not contains(x, '{u.PRIMARY_PROFILE}') and not contains(x, '{u.KB_PROFILE}')) as others from l)
select id, string_split(discogs_url, '/')[-1] as discogs_id, string_split(wikidata_url, '/')[-1] as wikidata_id,
  discogs_url, wikidata_url, array_to_string(others, '|') as other_urls from f""",
    "labels_regroup": """select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::bigint as wikidata_id,
  least(p.p_name, q.p_name) || '|' || greatest(p.p_name, q.p_name) as genres, s_name as instruments
from lineitem join part p on p.p_partkey = l_partkey join part q on q.p_partkey = l_suppkey
join supplier on s_suppkey = l_suppkey""",
    "three_way_resolve": f"""with {_SOURCES}
select wikidata_id, musicbrainz_id, discogs_id, '{u.MB_PROFILE}' || musicbrainz_id as musicbrainz_url,
  {_sorted('wikidata_links', 'wikidata_links')}, {_sorted('citizenships', 'citizenships')},
  {_sorted('other_urls', 'other_urls')}, array_to_string(images, '|') as images from resolved""",
    "resolved_rollup": f"""with {_SOURCES}{_ROLLED}
select discogs_id, k[1] as wikidata_id, case when len(k) > 1 then array_to_string(k[2:], '|') end as wikidata_id_others,
  m[1] as musicbrainz_id, case when len(m) > 1 then array_to_string(m[2:], '|') end as musicbrainz_id_others, birth,
  {", ".join(_sorted(n, n) for n in ('images', 'instruments', 'citizenships', 'genres3', 'other_urls', 'wikidata_links'))}
from rolled""",
    "unify_artists": f"""with {_SOURCES}{_ROLLED}
select c_custkey as discogs_id, k[1] as wikidata_id, m[1] as musicbrainz_id, c_name as name,
  '{u.PRIMARY_PROFILE}' || c_custkey || '-' || c_name as url_discogs,
  {_sorted('list_distinct([c_mktsegment] || coalesce(genres3, []))', 'genres')}, c_mktsegment as roles,
  {_sorted('coalesce(citizenships, [])', 'citizenships')},
  {_sorted(f"[ '{u.MB_PROFILE}' || x for x in coalesce(m, [])]", 'musicbrainz_url')}, 0::bigint as n_image_links
from customer left join rolled on discogs_id = c_custkey""",
}
