"""How the test tables stand in for credits, releases, people and sources (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collabnet.operators import paths as sp
from collabnet.operators.graph import degree, influence, undirected
from collabnet.operators.pairs import pair_counts, pair_events
from collabnet.session import cut_lineage

N_RELEVANTS = 13
N_CATEGORY_1 = 5


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Cast integer columns to the type SQL counts in."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def credits(spark: SparkSession, sf: str, deal_parts: bool = False) -> DataFrame:
    """Release x artist credits: orders are releases, parts are artists, customers are masters.

    Lines and orders meet by the id of the release, so what follows by release needs no
    other shuffle. ``deal_parts`` deals parts out however small their files are.
    """
    line = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("id_release"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("id_release"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return (
        line.join(orders, "id_release")
        .join(part.hint("merge") if deal_parts else part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "id_release",
            F.col("l_partkey").alias("id_artist"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") + 1).alias("master_id"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderdate").alias("released"),
            F.array("o_orderpriority").alias("formats"),
            F.array("l_suppkey").alias("primary_artists"),
            F.array("p_type", "p_brand").alias("genres"),
            F.concat_ws(",", "l_returnflag", "l_linestatus").alias("role"),
        )
    )


CREDITS_SQL = """
credits as (
  select l_orderkey + 1 as id_release, l_partkey as id_artist,
         case when o_orderstatus <> 'P' then o_custkey + 1 end as master_id,
         o_orderpriority as title, o_orderdate as released, o_orderpriority as format,
         l_suppkey as primary_artist, p_type, p_brand,
         l_returnflag || ',' || l_linestatus as role
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""

MULTI_SQL = CREDITS_SQL + """,
multi as (select * from (select *, count(*) over (partition by id_release) as cant_arts from credits) where cant_arts > 1),
versions as (select master_id as m, count(distinct id_release) as cant_vers from multi group by master_id),
kept as (
  select multi.*, cant_vers from multi
  join (select id_artist as a, count(*) as cant_rels from multi group by id_artist) on a = id_artist
  join versions on m is not distinct from master_id
  where cant_rels > 1 or cant_vers = 1)"""


def part_edges(spark: SparkSession, sf: str, min_common: int = 2) -> DataFrame:
    """Parts that share at least ``min_common`` orders."""
    return pair_counts(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", min_common)


def supplier_edges(spark: SparkSession, sf: str, min_common: int = 2) -> DataFrame:
    return pair_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey", min_common)


def edges_sql(entity: str = "l_partkey", min_common: int = 2, name: str = "edges") -> str:
    return f"""
{name}_p as (select distinct l_orderkey as e, {entity} as v from lineitem),
{name} as (select a.v as src, b.v as dst, count(*) as n_common
  from {name}_p a join {name}_p b on a.e = b.e and a.v < b.v
  group by 1, 2 having count(*) >= {min_common}),
{name}_both as (select src, dst from {name} union all select dst, src from {name}),
{name}_deg as (select src as id, count(*) as degree from {name}_both group by src)"""


def relevants(edges: DataFrame) -> DataFrame:
    """The 13 best connected vertices; the first 5 have category 1, the others category 2."""
    top = degree(edges).orderBy(F.col("degree").desc(), "id").limit(N_RELEVANTS)
    place = F.row_number().over(Window.orderBy(F.col("degree").desc(), "id")) - 1
    return top.select(
        "id",
        place.alias("ordinal"),
        F.when(place < N_CATEGORY_1, 1).otherwise(2).alias("category"),
    )


def relevants_sql(name: str = "edges") -> str:
    return f"""
relevants as (select id, row_number() over (order by degree desc, id) - 1 as ordinal,
    case when row_number() over (order by degree desc, id) <= {N_CATEGORY_1} then 1 else 2 end as category
  from {name}_deg order by degree desc, id limit {N_RELEVANTS})"""


def influence_sql(name: str = "edges") -> str:
    return f"""
weighted as (select d.id, d.degree, coalesce(3 - r.category, 0) as w
  from {name}_deg d left join relevants r on r.id = d.id),
boost as (select max(degree) as m from {name}_deg),
sums as (select b.src as id, sum(n.degree - 1) as sum_neighbor_degree, sum(n.degree - 1 + n.w * m) as sum_neighbor_relevance
  from {name}_both b join weighted n on n.id = b.dst, boost group by b.src),
scores as (select v.id, v.degree, s.sum_neighbor_degree, (v.degree - 1) * s.sum_neighbor_degree as ci,
    s.sum_neighbor_relevance, (v.degree - 1 + v.w * m) * s.sum_neighbor_relevance as cii
  from weighted v join sums s on s.id = v.id, boost)"""


def edge_orders(spark: SparkSession, sf: str, edges: DataFrame) -> DataFrame:
    """Long form (src, dst, event) of the part edges."""
    met = pair_events(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")
    return met.join(edges.select("src", "dst"), ["src", "dst"], "left_semi")


class PartNetwork:
    """Edges, relevants and scores of one graph; the edges are computed once."""

    def __init__(self, edges: DataFrame):
        self.edges = cut_lineage(edges)
        self.links = undirected(self.edges.select("src", "dst"))
        self.relevants = cut_lineage(relevants(self.edges))
        self.guests = degree(self.edges).select("id")

    def scores(self) -> DataFrame:
        return cut_lineage(influence(self.edges, self.relevants))

    def dag(self) -> sp.PathDag:
        return sp.shortest_path_dag(self.links, self.guests, self.relevants)
