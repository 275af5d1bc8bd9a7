"""Registered queries of the operators for training text; each runs over its whole table."""

from __future__ import annotations

import uuid

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collabnet.llm import (
    decontaminate,
    fingerprint,
    langid,
    linededup,
    maxsketch,
    neardup,
    packing,
    pii,
    prefixtrie,
    quality,
    tokencount,
    topk,
    urlfilter,
)
from collabnet.session import left_join, shared_folder, stored

TOKEN_LIMIT = 512


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    judged = langid.identify(table(spark, sf, "documents"))
    id = F.col("row.doc_id")
    return judged.select(id.alias("doc_id"), langid.held_out(id).alias("held_out"), "lang_pred", "score")


def op2_exact_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole text of every document whose id is divisible by 50, against all documents."""
    docs = table(spark, sf, "documents")
    asked = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return topk.search(docs, asked)


def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    id = F.col("row.doc_id")
    return scored.select(
        id.alias("doc_id"),
        quality.held_out(id).alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted"),
    )


def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("bigint")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op5_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate groups on runs of four words."""
    return neardup.components(table(spark, sf, "documents"), k=4)


def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a window of a benchmark item, with the item."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf, "pages").select("page_id", "url"), URL_RULES)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into sequences of 2048; ids travel as their checksum."""
    parts = packing.pieces(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.place(parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf, "documents"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
with lines as (
  select doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(l) as line, unnest(range(len(l))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))),
repeated as (select key, max(doc_id) as keeper from lines where length(key) >= 20
             group by key having count(distinct doc_id) >= 3),
judged as (select doc_id, i, line, keeper is not null and keeper <> doc_id as dropped
           from lines left join repeated using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id"""


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts through a cache of the query's own, so that every run does all of its work."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    counted = tokencount.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def rebuilt(spark: SparkSession, turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (id, pos, digest, size) of the rebuilt conversations, and all their ids."""
    ids = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    ids = ids.select("id", (F.col("id") - F.col("id") % 5).alias("base"), (F.crc32(F.col("id").cast("string").cast("binary")) % 9).alias("h"))
    starts = turns.where(F.col("pos") < 8).withColumnRenamed("id", "base")  # a base's first turns, at most 8 of them
    heads = stored(ids.join(starts, "base").where(F.col("pos") < F.col("h")).select("id", "pos", "digest", "size"))
    taken = heads.groupBy("id").agg(F.count("*").alias("taken"))
    shifts = ids.join(taken, "id", "left").select("id", "h", (F.coalesce("taken", F.lit(0)) - F.col("h")).alias("shift"))
    own = turns.join(shifts, "id").where(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") + F.col("shift"))
    return heads.unionByName(own.select("id", "pos", "digest", "size")), ids.select("id")


def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Trie of the rebuilt conversations; the ids that end at a node as one digest."""
    conversations = table(spark, sf, "conversations")
    turns, ids = rebuilt(spark, stored(prefixtrie.turn_digests(conversations)), conversations)
    found = stored(prefixtrie.paths(turns, ids))
    ends = prefixtrie.listed_ids(found.select("id", prefixtrie.end_name(F.col("path")).alias("end")))
    nodes = prefixtrie.trie(found)
    return left_join(nodes, ends, "end").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ids_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


#: DuckDB has no CRC-32: eight shifts a byte over the decimal digits.
_SHIFT = "xor(x >> 1, 3988292384 * (x & 1))"
OP11_SQL = f"""
with recursive o as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
  from conversations where conv_id is not null),
crc as (
  select distinct conv_id, cast(conv_id as varchar) as digits, 1 as i, 0 as bit,
         xor(cast(4294967295 as bigint), cast(ascii(cast(conv_id as varchar)) as bigint)) as x from o
  union all
  select conv_id, digits, case when bit = 7 then i + 1 else i end, (bit + 1) % 8,
         xor({_SHIFT}, case when bit = 7 and i < length(digits) then cast(ascii(substr(digits, i + 1, 1)) as bigint) else 0 end)
  from crc where i <= length(digits)),
c as (select conv_id, conv_id - conv_id % 5 as base, xor(x, 4294967295) % 9 as h from crc where i > length(digits)),
lens as (select conv_id, count(*) as n from o group by 1),
rebuilt as (
  select c.conv_id, pos, role, text from c join o on o.conv_id = base where pos < h
  union all
  select c.conv_id, least(h, coalesce(n, 0)) + pos - h, role, text
  from c join o on o.conv_id = c.conv_id left join lens on lens.conv_id = base where pos >= h),
seq as (select c.conv_id, coalesce(l, []) as l from c left join (
  select conv_id, list({{'r': role, 't': text}} order by pos) as l from rebuilt group by 1) using (conv_id)),
pre as (select conv_id, len(l) as n, unnest(range(0, len(l) + 1)) as depth, l from seq),
cut as (select conv_id, n, depth, l[:depth] as p, case when depth > 0 then strlen(l[depth].t) else 0 end as size from pre),
nodes as (
  select depth, p, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from cut group by depth, p),
member as (select cut.conv_id, cut.depth, nodes.conv_id as node from cut join nodes using (depth, p)),
up as (select n.*, m.node as parent_conv_id from nodes n left join member m on m.conv_id = n.conv_id and m.depth = n.depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from up where depth > 0 group by 1, 2),
full_nodes as (select up.*, coalesce(n_children, 0) as n_children from up left join kids using (conv_id, depth)),
subs as (
  select m.node as conv_id, m.depth, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * size) as saved
  from full_nodes f join member m on m.conv_id = f.conv_id and m.depth <= f.depth group by 1, 2)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, cast(saved as bigint) as saved_tokens, ends_sha256
from full_nodes join subs using (conv_id, depth)"""


def op12_max_sketch_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return maxsketch.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
with found as (select doc_id, unnest({_TERMS}) as term from documents where text is not null),
tf as (select doc_id, term, count(*) as tf from found group by all),
doc as (select doc_id, sum(tf) as n from tf group by doc_id),
size as (select count(*) as total, sum(n) as len from doc),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark where text is not null),
df as (select term, count(*) as df from tf group by term),
w as (select term, cast(floor(1000 * ln(cast(2 * total + 2 as double) / (2 * df + 1))) as bigint) as w from df, size),
m as (select doc_id, 100 - 50 + (50 * n * total) // len as m from doc, size),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from asked join w using (term) join tf using (term) join m using (doc_id) group by all),
ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50"""


def op13_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and its edited text, against each other and against the next document."""
    return fingerprint.fingerprints(table(spark, sf, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_exact_topk_search": op2_exact_topk_search,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_pii": op4_pii,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_max_sketch_search": op12_max_sketch_search,
    "op13_fingerprints": op13_fingerprints,
}
SQL = {"op9_line_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_max_sketch_search": OP12_SQL}
