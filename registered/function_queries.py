"""Search, update and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from collabnet.functions import claims, dates, text, urls
from collabnet.operators import importcsv as ic
from collabnet.operators import lookup, update
from registered import bindings as b

TERMS = ["inon", "th[aeiou]nt", "Elle_un", "reau.*mentre"]


def name_search(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return lookup.search_names(docs, TERMS, "text").select("doc_id", "search_name")


def pattern_search(spark, sf):
    """Part names by a table of patterns, one from every name."""
    part = b.table(spark, sf, "part").select("p_partkey", "p_name")
    terms = part.select(F.concat(F.lit("^"), F.substring("p_name", 1, 3), F.lit(".*"), F.right("p_name", F.lit(2)), F.lit("$")).alias("term"))
    return lookup.search_names(part, terms, "p_name").select("p_partkey", "search_name")


def literal_search(spark, sf):
    """Page addresses by a table of plain texts, the languages of the documents."""
    pages = b.table(spark, sf, "pages").select("page_id", "url")
    terms = b.table(spark, sf, "documents").select(F.col("lang").alias("term"))
    return lookup.search_names(pages, terms, "url", literal=True).select("page_id", "search_name")


def _target(spark, sf):
    key = F.col("c_custkey").cast("string")
    lists = F.when(F.col("c_acctbal") > 5000, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>"))
    return b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("discogs_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("Q"), key)).alias("wikidata_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("m"), key)).alias("musicbrainz_id"),
        lists.alias("wikidata_links"),
        lists.alias("citizenships"),
        lists.alias("images"),
        F.array("c_mktsegment").alias("instruments"),
        F.array(F.struct(F.lit("t").alias("time"), F.lit("c").alias("calendar"))).alias("date_of_birth_calendar"),
        F.lit(None).cast("array<string>").alias("other_urls"),
    )


def _selection(spark, sf):
    """An id chosen for every customer: the same, the next one, or none, by nation and balance."""
    near, key = F.col("c_nationkey"), F.col("c_custkey")
    ident = F.when(near < 12, key).when(near < 20, key + 1).cast("string")
    return b.table(spark, sf, "customer").select(
        key.alias("discogs_id"),
        F.concat(F.lit("m"), ident).alias("musicbrainz_id"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Q"), ident)).alias("wikidata_id"),
    )


def _kb(spark, sf):
    key = F.col("s_suppkey").cast("string")
    return b.table(spark, sf, "supplier").select(
        F.concat(F.lit("Q"), key).alias("wikidata_id"),
        F.array(key).alias("images"),
        F.array(key, "s_name").alias("wikidata_links"),
        F.array(key).alias("instruments"),
        F.array("s_name").alias("citizenships"),
        F.array(
            F.struct(F.lit("t1").alias("time"), F.lit("c").alias("calendar")),
            F.struct(F.lit("t2").alias("time"), F.lit("c").alias("calendar")),
        ).alias("date_of_birth_calendar"),
    )


def _mb(spark, sf):
    key = F.col("p_partkey").cast("string")
    return b.table(spark, sf, "part").select(
        F.concat(F.lit("m"), key).alias("musicbrainz_id"), F.col("p_brand").alias("country"), F.array("p_name", "p_type").alias("other_urls")
    )


def check_updates(spark, sf):
    return update.check_updates(_target(spark, sf), _selection(spark, sf))


def update_log(spark, sf):
    return update.update_log(_target(spark, sf), _selection(spark, sf)).drop("log_date")


def _shown_target(df):
    def text_of(n):
        return F.array_join(n, "|").alias(n)

    return df.select(
        "discogs_id", "wikidata_id", "musicbrainz_id", "name", text_of("wikidata_links"), text_of("citizenships"),
        text_of("images"), text_of("instruments"), text_of("other_urls"),
        F.array_join(F.col("date_of_birth_calendar.time"), "|").alias("births"),
    )


def update_target(spark, sf):
    return _shown_target(
        update.update_target(_target(spark, sf), _selection(spark, sf), _kb(spark, sf), _mb(spark, sf))
    )


def selection_to_guests(spark, sf):
    candidates = b.table(spark, sf, "part").select(F.col("p_partkey").alias("discogs_id"), F.col("p_name").alias("name"))
    chosen = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("discogs_id"))
    return lookup.selection_to_guests(chosen, candidates)


def selected_ids(spark, sf):
    return lookup.selected_ids(_selection(spark, sf))


def json_claims(spark, sf):
    """Entity JSON built from every event and read back through the claim functions."""
    num = F.get_json_object("props", "$.k")
    value = F.struct(F.struct(F.struct(num.alias("value")).alias("datavalue")).alias("mainsnak"))
    item = F.struct(
        F.struct(F.struct(F.struct(F.concat(F.lit("Q"), num).alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")
    )
    kind = F.struct(
        F.struct(
            F.struct(
                F.struct(F.when(F.col("event_type") == "click", "Q5").otherwise("Q6").alias("id")).alias("value")
            ).alias("datavalue")
        ).alias("mainsnak")
    )
    site = F.struct(F.concat("event_type", F.lit("wiki")).alias("site"), F.concat(F.lit("A "), num).alias("title"))
    entity = F.to_json(
        F.struct(
            F.concat(F.lit("Q"), "event_id").alias("id"),
            F.struct(F.struct(F.concat(F.lit('x"'), "event_type").alias("value")).alias("en")).alias("labels"),
            F.create_map(F.lit("s"), site).alias("sitelinks"),
            F.struct(
                F.array(kind).alias("P31"),
                F.when(F.col("event_type") != "view", F.array(value)).alias("P434"),
                F.array(item, item).alias("P136"),
                F.array(value).alias("P18"),
            ).alias("claims"),
        )
    )
    parsed = b.table(spark, sf, "events").select(F.from_json(entity, claims.ENTITY_SCHEMA).alias("e"))
    return parsed.select(
        F.col("e.id").alias("id"),
        claims.english("e", "labels").alias("label"),
        claims.first_text("e", claims.P_MB_ID).alias("mb_id"),
        F.array_join(claims.item_ids("e", claims.P_GENRE), "|").alias("genres"),
        F.array_join(claims.images("e"), "|").alias("images"),
        F.array_join(claims.site_links("e"), "|").alias("links"),
        claims.is_human("e").alias("human"),
        claims.is_in_music("e").alias("in_music"),
    )


def birth_year(spark, sf):
    time = F.date_format("o_orderdate", dates.TIME_FORMAT)
    coarse = F.date_format("o_orderdate", "'+'yyyy-'00-00T00:00:00Z'")
    shown = F.when(F.col("o_orderstatus") == "P", coarse).otherwise(time)
    births = F.array(
        F.struct(F.lit("+1000-01-01T00:00:00Z").alias("time"), F.lit(dates.GREGORIAN).alias("calendar")),
        F.struct(shown.alias("time"), F.when(F.col("o_orderpriority") != "1-URGENT", dates.GREGORIAN).alias("calendar")),
    )
    return b.table(spark, sf, "orders").select("o_orderkey", dates.birth_year(births).cast("bigint").alias("year"))


def _read_as(url, old, new):
    return F.replace(url, F.lit(old), F.lit(new))


def best_url(spark, sf):
    """The URLs of every page, its example host read as several known ones."""
    url = F.col("url")
    face = F.regexp_replace(_read_as(url, "example.com", "facebook.com"), r"//[a-z]+\.facebook\.com", "//www.facebook.com")
    listed = F.array(
        F.concat(_read_as(url, "example.org", "facebook.com"), F.lit("/profile/of/the/page")),
        face,
        _read_as(url, "example.net", "de.wikipedia.org"),
        _read_as(url, "example.net", "en.wikipedia.org"),
        F.when(F.contains(url, F.lit("/fr/")), _read_as(url, "example.net", "es.wikipedia.org")),
    )
    pages = b.table(spark, sf, "pages").select("page_id", urls.all_urls(listed).alias("urls"))
    return pages.select(
        "page_id",
        urls.best_encyclopedia_url(F.col("urls")).alias("encyclopedia"),
        urls.best_host_url(F.col("urls"), "facebook.com").alias("facebook"),
        urls.best_host_url(F.col("urls"), "imdb.com").alias("imdb"),
    )


def home_page(spark, sf):
    """Own sites: the first word of a page's host as the artist's last name."""
    url = F.col("url")
    word = F.regexp_extract("url", r"//(?:m\.|www\.)?([a-z]+)\.example", 1)
    listed = F.array(
        url,
        F.concat(F.lit("http://the"), word, F.lit(".com/home")),
        F.concat(F.lit("http://"), word, F.lit(".com")),
        F.concat(F.lit("http://facebook.com/the"), word),
    )
    shown = F.when(F.contains(url, F.lit("?")), F.array(url)).otherwise(listed)
    pages = b.table(spark, sf, "pages").select("page_id", F.concat(F.lit("The "), word).alias("name"), shown.alias("urls"))
    return pages.select("page_id", "name", urls.home_page(F.col("name"), F.col("urls")).alias("home"))


def media_hash_url(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", urls.media_hash_url(F.col("url")).alias("media"))


def html_escape(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", text.escaped_name(F.col("html")).alias("escaped"))


def display_name(spark, sf):
    return b.table(spark, sf, "customer").select("c_custkey", text.display_name(F.col("c_name")).alias("shown"))


def _releases(spark, sf):
    """Every line as a release: its part and supplier are credited, returned goods without a collaborator id."""
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus", "o_orderdate"
    )
    ident = F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).otherwise(0)
    line = b.table(spark, sf, "lineitem").join(part, "l_partkey").join(orders, "l_orderkey")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("discogs_id"),
        F.concat(F.lit("<"), "o_orderpriority", F.lit(">")).alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy")).alias("released"),
        F.lit(None).cast("string").alias("country"),
        F.when(F.col("l_linestatus") == "O", F.array("p_name", "p_brand")).alias("extras_names"),
        F.array(ident, F.col("l_suppkey")).alias("extras_ids"),
        F.array("l_returnflag", "l_linestatus").alias("extras_roles"),
        F.array("p_brand").alias("artists_names"),
    )


def _brands(spark, sf):
    brand = b.table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    return brand.select("name", F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("id"))


def _main(spark, sf):
    return ic.main_artists(_releases(spark, sf), _brands(spark, sf))


def zip_explode(spark, sf):
    return ic.collaborations(_releases(spark, sf))


def graph_import_nodes(spark, sf):
    nodes = ic.artist_model_nodes(_main(spark, sf), ic.collaborations(_releases(spark, sf)))
    return nodes.withColumnRenamed("artistId:ID(Artist)", "id")


def graph_import_rels(spark, sf):
    rels = ic.played_with_relations(_main(spark, sf), ic.collaborations(_releases(spark, sf)))
    return rels.withColumnRenamed(ic.START_ARTIST, "start_id").withColumnRenamed(ic.END_ARTIST, "end_id")


def graph_import_releases(spark, sf):
    return ic.release_nodes(_releases(spark, sf)).withColumnRenamed("releaseId:ID(Release)", "id")


def graph_import_performed(spark, sf):
    rels = ic.performed_in(_main(spark, sf))
    return rels.withColumnRenamed(ic.START_ARTIST, "start_id").withColumnRenamed(ic.END_RELEASE, "end_id")


def graph_import_credited(spark, sf):
    rels = ic.credited_in(ic.collaborations(_releases(spark, sf)))
    return rels.withColumnRenamed(ic.START_COLLABORATOR, "start_id").withColumnRenamed(ic.END_RELEASE, "end_id")


QUERIES = {
    "name_search": name_search,
    "pattern_search": pattern_search,
    "literal_search": literal_search,
    "check_updates": check_updates,
    "update_log": update_log,
    "update_target": update_target,
    "selection_to_guests": selection_to_guests,
    "selected_ids": selected_ids,
    "json_claims": json_claims,
    "birth_year": birth_year,
    "best_url": best_url,
    "home_page": home_page,
    "media_hash_url": media_hash_url,
    "html_escape": html_escape,
    "display_name": display_name,
    "zip_explode": zip_explode,
    "graph_import_nodes": graph_import_nodes,
    "graph_import_rels": graph_import_rels,
    "graph_import_releases": graph_import_releases,
    "graph_import_performed": graph_import_performed,
    "graph_import_credited": graph_import_credited,
}

_TARGET = """
target as (select c_custkey as id, c_name as name, case when c_mktsegment <> 'MACHINERY' then 'Q' || c_custkey end as k,
    case when c_mktsegment <> 'BUILDING' then 'm' || c_custkey end as m,
    case when c_acctbal > 5000 then [c_mktsegment] end as lists, c_mktsegment as seg from customer),
sel as (select c_custkey as id, 'm' || (case when c_nationkey < 12 then c_custkey when c_nationkey < 20 then c_custkey + 1 end) as ms,
    case when c_acctbal > 0 then 'Q' || (case when c_nationkey < 12 then c_custkey when c_nationkey < 20 then c_custkey + 1 end) end as ks
  from customer),
pair as (select * from target join sel using (id))"""


def _status(e: str, s: str) -> str:
    return f"""case when {e} <> {s} then 'DISTINCT' when {e} = {s} then 'MATCHED' when {e} is null and {s} is not null then 'ADDED'
  when {e} is null and {s} is null then 'MATCHED' else 'ERROR' end"""


def _changed(e: str, s: str) -> str:
    return f"coalesce({e} <> {s}, {e} is null and {s} is not null)"


_FORM = r"regexp_replace(strip_accents(lower(regexp_replace(text, '[[:punct:]]', '', 'g'))), '[^\x00-\x7F]', '', 'g')"

_ESCAPE = "replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"

_COLABS = """
rels as (select l_orderkey * 10 + l_linenumber as discogs_id, '<' || o_orderpriority || '>' as title,
    case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y') else 'no info' end as released, 'no info' as country,
    p_name, p_brand, l_partkey, l_suppkey, l_returnflag, l_linestatus
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey),
colabs as (select discogs_id, title, released, country, p_name as colab_name,
    case when l_returnflag <> 'R' then l_partkey else 0 end as colab_id, l_returnflag as colab_role from rels where l_linestatus = 'O'
  union all select discogs_id, title, released, country, lower(p_brand), l_suppkey, l_linestatus from rels where l_linestatus = 'O'),
mains as (select discogs_id, lower(p_brand) as artist_name, regexp_extract(p_brand, '([0-9]+)', 1)::bigint as aid from rels)"""

SQL = {
    "pattern_search": r"""with f as (select p_partkey, lower(regexp_replace(p_name, '[[:punct:]]', '', 'g')) as form, p_name from part),
t as (select distinct lower(replace('^' || substr(p_name, 1, 3) || '.*' || right(p_name, 2) || '$', '_', ' ')) as term from part)
select p_partkey, term as search_name from f join t on regexp_matches(form, term)""",
    "literal_search": r"""with f as (select page_id, lower(regexp_replace(url, '[[:punct:]]', '', 'g')) as form from pages),
t as (select distinct lang as term from documents where lang is not null)
select page_id, term as search_name from f join t on contains(form, term)""",
    "name_search": f"""select doc_id, t as search_name from documents, (values {", ".join(f"('{t.replace('_', ' ').lower()}')" for t in TERMS)}) v(t)
where regexp_matches({_FORM}, '(?-s)' || t)""",
    "check_updates": f"""with {_TARGET} select name, id as discogs_id, m as musicbrainz_id, k as wikidata_id,
  ms as musicbrainz_id_selected, ks as wikidata_id_selected, {_changed('m', 'ms')} or {_changed('k', 'ks')} as update_status from pair""",
    "update_log": f"""with {_TARGET} select id as discogs_id, k as wikidata_id, m as musicbrainz_id, ms as musicbrainz_id_selected,
  ks as wikidata_id_selected, {_status('m', 'ms')} as "mbID_STATUS", {_status('k', 'ks')} as "wkID_STATUS" from pair""",
    "update_target": f"""with {_TARGET},
merged as (select id, name, coalesce(k, ks) as k, coalesce(m, ms) as m, lists, seg from pair),
kb as (select 'Q' || s_suppkey as k, s_suppkey::varchar as key, s_name from supplier
  where 'Q' || s_suppkey in (select ks from sel where ks is not null)),
mb as (select 'm' || p_partkey as m, p_brand, p_name || '|' || p_type as other from part
  where 'm' || p_partkey in (select ms from sel where ms is not null)),
two as (select id, name, coalesce(a.k, kb.k) as k, m, coalesce(lists[1], key) as images,
    coalesce(lists[1], key || '|' || s_name) as links, coalesce(seg, key) as instruments,
    coalesce(lists[1], s_name) as citizenships, case when key is not null then 't1|t2' when seg is not null then 't' end as births
  from merged a full join kb on kb.k = a.k)
select id as discogs_id, k as wikidata_id, coalesce(t.m, mb.m) as musicbrainz_id, name, coalesce(links, '') as wikidata_links,
  coalesce(citizenships, p_brand, '') as citizenships, coalesce(images, '') as images, coalesce(instruments, '') as instruments,
  coalesce(other, '') as other_urls, births from two t full join mb on mb.m = t.m""",
    "selection_to_guests": r"""select p_partkey as id, regexp_replace(trim(p_name), '\s+', '_', 'g') as name from part
where p_partkey in (select s_suppkey from supplier)""",
    "selected_ids": f"""with {_TARGET} select id as discogs_id, coalesce(ms, 'no info') as musicbrainz_id,
  coalesce(ks, 'no info') as wikidata_id from sel""",
    "json_claims": f"""with n as (select *, json_extract_string(props, '$.k') as k from events)
select 'Q' || event_id as id, 'x' || event_type as label, case when event_type <> 'view' then k end as mb_id,
  'Q' || k || '|Q' || k as genres, '{urls.COMMONS_FILE}' || k as images,
  'https://' || event_type || '.wikipedia.org/wiki/A_' || k as links, event_type = 'click' as human, event_type <> 'view' as in_music from n""",
    "birth_year": """select o_orderkey, case when o_orderpriority = '1-URGENT' then 1000 when o_orderstatus <> 'P' then year(o_orderdate) end as year
from orders""",
    "best_url": r"""with w as (select page_id, case when contains(url, 'example.net') then replace(url, 'example.net', 'en.wikipedia.org') end as en,
    case when contains(url, 'example.net') and contains(url, '/fr/') then replace(url, 'example.net', 'es.wikipedia.org') end as es,
    case when contains(url, 'example.com') then regexp_replace(replace(url, 'example.com', 'facebook.com'), '//[a-z]+\.facebook\.com', '//www.facebook.com', 'g') end as face,
    case when contains(url, 'example.org') then replace(url, 'example.org', 'facebook.com') || '/profile/of/the/page' end as other
  from pages)
select page_id, coalesce(es, en) as encyclopedia, case when contains(face, '//www.facebook.com/') then face
  when contains(face, '//facebook.com/') then face when contains(other, '//www.facebook.com/') or contains(other, '//facebook.com/') then other end as facebook,
  null::varchar as imdb from w""",
    "home_page": r"""with g as (select page_id, url, regexp_extract(url, '//(?:m\.|www\.)?([a-z]+)\.example', 1) as w from pages),
u as (select page_id, w, url, 1 as k, url as x from g
  union all select page_id, w, url, 2, 'http://the' || w || '.com/home' from g where not contains(url, '?')
  union all select page_id, w, url, 3, 'http://' || w || '.com' from g where not contains(url, '?')),
c as (select *, string_split(lower(x), '.com')[1] as front from u where suffix(x, '.com') or contains(x, '.com/')),
r as (select *, case when contains(front, 'the') and contains(front, w) then 1 when w <> '' and contains(front, w) then 2
    when contains(front, 'the') then 3 end as tier from c),
best as (select page_id, x as home from r where tier is not null
  qualify row_number() over (partition by page_id order by tier, length(x), not suffix(x, '.com'), k) = 1)
select page_id, 'The ' || w as name, home from g left join best using (page_id)""",
    "media_hash_url": f"""select page_id, '{urls.COMMONS_UPLOAD}/' || substr(md5(url), 1, 1) || '/' || substr(md5(url), 1, 2) || '/' || url as media
from pages""",
    "html_escape": f"select page_id, replace({_ESCAPE.format('lower(trim(html))')}, '　', '') as escaped from pages",
    "display_name": r"select c_custkey, regexp_replace(c_name, '[\s(\d)]*$', '') as shown from customer",
    "zip_explode": f"""with {_COLABS} select title, released, country, discogs_id, colab_name, colab_id, colab_role from colabs""",
    "graph_import_nodes": f"""with {_COLABS} select aid as id, artist_name as name from mains
union select colab_id, colab_name from colabs where colab_id <> 0""",
    "graph_import_rels": f"""with {_COLABS}
select start_id, end_id, role, title, year, country from (
  select distinct c.discogs_id, colab_name, colab_id as start_id, aid as end_id, colab_role as role, title, released as year, country
  from colabs c join mains m on m.discogs_id = c.discogs_id where colab_id <> 0 and colab_id <> aid)""",
    "graph_import_releases": f"with {_COLABS} select distinct discogs_id as id, title, country, released from rels",
    "graph_import_performed": f"with {_COLABS} select aid as start_id, discogs_id as end_id from mains",
    "graph_import_credited": f"""with {_COLABS} select colab_id as start_id, discogs_id as end_id, colab_role as role from
  (select distinct discogs_id, title, released, country, colab_name, colab_id, colab_role from colabs where colab_id <> 0)""",
}
