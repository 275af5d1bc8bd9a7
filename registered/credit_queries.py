"""Credit filters, roll-ups and the played-with relation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from collabnet import schemas
from collabnet.functions.arrays import or_empty, split_roles
from collabnet.operators import credits as cr
from collabnet.operators import pairs as pr
from collabnet.operators.containment import contained
from collabnet.plans import jobs
from collabnet.session import stored
from registered import bindings as b

ALLOWED = ["a", "o"]
DENIED = ["r"]
WORDS = ["urgent"]
ROLE_WORDS = ["Performer", "A", "o"]
VARIOUS = 1


def _kept(spark, sf):
    return cr.one_version(cr.multi_party(b.credits(spark, sf)))


def multi_party(spark, sf):
    return cr.multi_party(b.credits(spark, sf)).select("id_release", "id_artist", "role", "cant_arts")


def one_version_filter(spark, sf):
    return _kept(spark, sf).select("id_release", "id_artist", "role", "cant_rels", "cant_vers")


def role_filter(spark, sf):
    roles = cr.wanted_roles(split_roles(F.col("role")), ALLOWED, DENIED)
    return (
        b.credits(spark, sf)
        .select("id_release", "id_artist", roles.alias("roles"))
        .where(F.size("roles") > 0)
        .select("id_release", "id_artist", F.array_join("roles", "|").alias("roles"))
    )


def credit_merge(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    # A file of names that repeat is far smaller than its rows: never send copies through the driver.
    listed = b.credits(spark, sf, deal_parts=True).withColumnRenamed("id_artist", "id").join(part.hint("merge"), "id")
    merged = cr.merge_credits(listed, "id_release", ALLOWED, DENIED)
    return merged.select(
        "id_release", "id", F.array_join("names", "|").alias("names"), F.array_join("roles", "|").alias("roles")
    )


def contained_words(spark, sf):
    """Starts of part names in the names of all parts."""
    names = b.table(spark, sf, "part").select(F.col("p_name").alias("text"))
    return contained(names, names.select(F.substring("text", 1, 5).alias("word")))


def release_credits(spark, sf):
    """Orders as releases of the XML shape: the first line is the main artist, the others are extra artists."""
    line = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    role = F.when(F.col("l_linenumber") > 1, F.concat_ws(", ", "l_returnflag", "l_linestatus"))
    credit = F.struct(
        F.lit(None).cast("string").alias("anv"), F.col("l_partkey").alias("id"), F.lit(None).cast("string").alias("join"),
        F.col("p_name").alias("name"), role.alias("role"), F.lit(None).cast("string").alias("tracks"),
    )
    listed = lambda c: F.struct(F.collect_list(F.when(c, credit)).alias("artist"))
    first = F.col("l_linenumber") == 1
    people = line.groupBy(F.col("l_orderkey").alias("_id")).agg(listed(first).alias("artists"), listed(~first).alias("extraartists"))
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("_id"), F.struct(F.col("o_custkey").alias("_VALUE")).alias("master_id"), F.col("o_orderpriority").alias("title")
    )
    empty = {f.name: F.lit(None).cast(f.dataType) for f in T.StructType.fromDDL(schemas.RELEASE_XML) if f.name not in ("_id", "master_id", "title", "artists", "extraartists")}
    releases = orders.join(people, "_id").withColumns(empty)
    got = jobs.release_credits(releases, spark.createDataFrame([(w,) for w in ROLE_WORDS], "word string"))
    return got.select(
        "id_release", "id_artist", "master_id", "title",
        F.array_join("names_artist", "|").alias("names"), F.array_join("roles_artist", "|").alias("roles"),
    )


def solo_filter(spark, sf):
    size, name = F.col("p_size") % 3, F.col("p_name")
    members = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(name))
    artists = b.table(spark, sf, "part").select(
        "p_partkey", name.alias("name"), members.otherwise(F.array(name, "p_brand")).alias("members_name")
    )
    return cr.solo_artists(artists).select("p_partkey", "name")


def name_filter(spark, sf):
    def named(table, key, name):
        return b.table(spark, sf, table).select(
            F.lit(table).alias("kind"), F.col(key).cast("bigint").alias("id"), F.col(name).alias("name")
        )

    names = (
        named("documents", "doc_id", "text")
        .unionByName(named("conversations", "conv_id", "role"))
        .unionByName(named("part", "p_partkey", "p_name"))
        .unionByName(named("nation", "n_nationkey", "n_name"))
        .unionByName(named("customer", "c_custkey", "c_name"))
    )
    return cr.plain_names(names)


def version_collapse(spark, sf):
    return cr.version_collapse(_kept(spark, sf), compilation_words=WORDS, various=VARIOUS)


def sentinel_filter(spark, sf):
    return cr.version_collapse(b.credits(spark, sf), compilation_words=["no such word"], various=VARIOUS)


def compilation_filter(spark, sf):
    return cr.version_collapse(b.credits(spark, sf), compilation_words=WORDS, various=-1)


def played_with(spark, sf):
    """Only what the steps need is dealt out, and what several of them read is made once."""
    marked = b.credits(spark, sf).select(
        "id_artist", "id_release", "master_id", cr.compilations(WORDS, VARIOUS).alias("dropped")
    )
    kept = cr.one_version(stored(cr.multi_party(marked)))
    collapsed = stored(cr.version_collapse(kept, dropped="dropped").select("id_artist", "id_release"))
    lists = pr.pair_lists(collapsed, "id_artist", "id_release")
    return lists.select(
        F.col("src").alias("id_artist_out"),
        F.col("dst").alias("id_artist_in"),
        F.array_join("id_releases", "|").alias("id_releases"),
    )


def artist_rollup(spark, sf):
    listed = b.credits(spark, sf).withColumn("roles_artist", split_roles(F.col("role")))
    rolled = cr.artist_rollup(listed)
    return rolled.select(
        "id_artist", F.array_join("genres", "|").alias("genres"), F.array_join("roles_artist", "|").alias("roles")
    )


def release_dedup(spark, sf):
    kept = _kept(spark, sf).drop("role", "primary_artists")
    wide = cr.releases(kept.withColumn("genres", F.slice(or_empty(F.col("genres")), 1, 1)))
    return wide.select(
        "id_release",
        "master_id",
        "title",
        F.date_format("released", "yyyy-MM-dd").alias("released"),
        F.array_join("genres", "|").alias("genres"),
        F.array_join("formats", "|").alias("formats"),
        "cant_arts",
        "cant_vers",
    )


QUERIES = {
    "multi_party": multi_party,
    "one_version_filter": one_version_filter,
    "role_filter": role_filter,
    "credit_merge": credit_merge,
    "contained_words": contained_words,
    "release_credits": release_credits,
    "solo_filter": solo_filter,
    "name_filter": name_filter,
    "version_collapse": version_collapse,
    "sentinel_filter": sentinel_filter,
    "compilation_filter": compilation_filter,
    "played_with": played_with,
    "artist_rollup": artist_rollup,
    "release_dedup": release_dedup,
}

_COLLAPSE = """select id_artist, coalesce(master_id, -id_release) as master_id, min(id_release) as id_release
  from {source} group by 1, 2
  having not bool_or(lower(format) like '%{word}%') and not bool_or(primary_artist = {various})"""

_SPECIAL = r"""[~!@#$^%&*_+={}\[\]|;:"''<,>.?`/\\]"""

_ROLES = """roles as (
  select id_release, id_artist, role,
    list_filter([trim(x) for x in string_split(role, ',')],
                lambda r: not contains(lower(r), 'r') and (contains(lower(r), 'a') or contains(lower(r), 'o'))) as kept
  from credits)"""

SQL = {
    "multi_party": f"with {b.MULTI_SQL} select id_release, id_artist, role, cant_arts from multi",
    "one_version_filter": f"""with {b.MULTI_SQL}
select id_release, id_artist, role, count(*) over (partition by id_artist) as cant_rels, cant_vers from
  (select multi.*, cant_vers from multi join versions on m is not distinct from master_id)
qualify count(*) over (partition by id_artist) > 1 or cant_vers = 1""",
    "role_filter": f"""with {b.CREDITS_SQL}, {_ROLES}
select id_release, id_artist, array_to_string(kept, '|') as roles from roles where len(kept) > 0""",
    "credit_merge": f"""with {b.CREDITS_SQL}, {_ROLES},
facts as (select id_release, id_artist, unnest(kept) as r from roles)
select id_release, id_artist as id, string_agg(distinct p_name, '|' order by p_name) as names,
  string_agg(distinct r, '|' order by r) as roles
from facts join part on p_partkey = id_artist group by 1, 2""",
    "contained_words": """select distinct t.p_name as text, w.word
from part t join (select distinct substr(p_name, 1, 5) as word from part) w on contains(t.p_name, w.word)""",
    "release_credits": f"""with c as (
  select l_orderkey as id_release, l_partkey as id_artist, p_name,
    unnest(case when l_linenumber = 1 then ['{cr.MAIN_ROLE}'] else [l_returnflag, l_linestatus] end) as role
  from lineitem join part on p_partkey = l_partkey),
kept as (select * from c where regexp_matches(lower(role), '{"|".join(w.lower() for w in ROLE_WORDS)}')
  and not regexp_matches(lower(role), '{"|".join(cr.DENIED_ROLES)}'))
select id_release, id_artist, o_custkey as master_id, o_orderpriority as title,
  string_agg(distinct p_name, '|' order by p_name) as names, string_agg(distinct role, '|' order by role) as roles
from kept join orders on o_orderkey = id_release group by all""",
    "solo_filter": "select p_partkey, p_name as name from part where p_size % 3 < 2",
    "name_filter": f"""select * from (
  select 'documents' as kind, doc_id as id, text as name from documents
  union all select 'conversations', conv_id, role from conversations
  union all select 'part', p_partkey, p_name from part
  union all select 'nation', n_nationkey, n_name from nation
  union all select 'customer', c_custkey, c_name from customer)
where not regexp_matches(name, '{_SPECIAL}')""",
    "version_collapse": f"with {b.MULTI_SQL} {_COLLAPSE.format(source='kept', word='urgent', various=VARIOUS)}",
    "sentinel_filter": f"with {b.CREDITS_SQL} {_COLLAPSE.format(source='credits', word='no such word', various=VARIOUS)}",
    "compilation_filter": f"with {b.CREDITS_SQL} {_COLLAPSE.format(source='credits', word='urgent', various=-1)}",
    "played_with": f"""with {b.MULTI_SQL},
c as (select distinct id_artist, id_release from ({_COLLAPSE.format(source='kept', word='urgent', various=VARIOUS)}))
select a.id_artist as id_artist_out, i.id_artist as id_artist_in,
  string_agg(a.id_release, '|' order by a.id_release) as id_releases
from c a join c i on a.id_release = i.id_release and a.id_artist < i.id_artist group by 1, 2""",
    "artist_rollup": f"""with {b.CREDITS_SQL},
g as (select id_artist, p_type as x from credits union select id_artist, p_brand from credits),
r as (select distinct id_artist, trim(unnest(string_split(role, ','))) as x from credits)
select a.id_artist, genres, roles from
  (select id_artist, string_agg(x, '|' order by x) as genres from g group by 1) a
  join (select id_artist, string_agg(x, '|' order by x) as roles from r group by 1) c on c.id_artist = a.id_artist""",
    "release_dedup": f"""with {b.MULTI_SQL}
select distinct id_release, master_id, title, strftime(released, '%Y-%m-%d') as released,
  p_type as genres, format as formats, cant_arts, cant_vers from kept""",
}
