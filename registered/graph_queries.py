"""Pairs, degree, influence, components, distances and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from collabnet.operators import components as cc
from collabnet.operators import graph as g
from collabnet.operators import pairs as pr
from collabnet.operators import pathcounts as pc
from collabnet.operators import paths as sp
from collabnet.session import cut_lineage
from registered import bindings as b


INFLUENCE = ["sum_neighbor_degree", "ci", "sum_neighbor_relevance", "cii"]


def _line(spark, sf):
    return b.table(spark, sf, "lineitem")


def pairs(spark, sf):
    return pr.pair_summary(
        _line(spark, sf), "l_partkey", "l_orderkey",
        F.count("*").alias("n_common"), F.min("event").alias("first_event"), F.max("event").alias("last_event"),
    )


def pairs_min_common(spark, sf):
    return b.part_edges(spark, sf, 2)


def pair_titles(spark, sf):
    met = pr.pair_events(_line(spark, sf), "l_partkey", "l_orderkey")
    titles = b.table(spark, sf, "orders")
    return pr.pair_titles(met, titles, "o_orderkey", "o_orderpriority").withColumnRenamed("event", "id_release")


def title_lists(spark, sf):
    met = pr.pair_events(_line(spark, sf), "l_partkey", "l_orderkey")
    titled = pr.pair_titles(met, b.table(spark, sf, "orders"), "o_orderkey", "o_orderpriority")
    shown = F.transform("id_title_list", lambda t: F.concat_ws(":", t.id_release.cast("string"), t.title))
    return pr.title_lists(titled).select("src", "dst", F.array_join(shown, "|").alias("id_title_list"))


def degree(spark, sf):
    return g.degree(b.part_edges(spark, sf, 1))


def neighbor_sum(spark, sf):
    edges = b.supplier_edges(spark, sf, 1)
    supplier = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    return g.neighbor_sum(edges, supplier, sum_nation=F.col("s_nationkey").cast("bigint"))


def collective_influence(spark, sf):
    return b.longs(g.influence(cut_lineage(b.part_edges(spark, sf, 1))), *INFLUENCE[:2])


def collective_initialized_influence(spark, sf):
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    return b.longs(g.influence(net.edges, net.relevants), *INFLUENCE)


def undirected_edges(spark, sf):
    return g.undirected(b.part_edges(spark, sf, 1), min_common=2)


def pruned_vertices(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return g.prune_vertices(part, b.part_edges(spark, sf, 2))


def components(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return cc.connected_components(b.part_edges(spark, sf, 2), part)


def landmark_distances(spark, sf):
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    return b.longs(sp.landmark_distances(net.links, net.relevants), "dist")


def distance_lists(spark, sf):
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    names = b.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.translate("p_name", " ", "_").alias("name")
    )
    far = sp.landmark_distances(net.links, net.relevants)
    return b.longs(sp.distance_lists(far, names, net.relevants.join(names, "id")), "distance")


def _shown(paths):
    return b.longs(paths, "key").select("guest", "relevant", "key", F.array_join("vertices", "-").alias("path"))


def all_shortest_paths(spark, sf):
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    return _shown(sp.all_shortest_paths(net.links, net.guests, net.relevants))


def all_shortest_paths_supplier(spark, sf):
    net = b.PartNetwork(b.supplier_edges(spark, sf, 2))
    return _shown(sp.all_shortest_paths(net.links, net.guests, net.relevants))


def path_counts(spark, sf):
    """Number of shortest paths of every pair, counted on the arcs."""
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    return b.longs(pc.pair_counts(net.dag()), "key", "n_paths")


def guests_without_path(spark, sf):
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    parts = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    paths = sp.all_shortest_paths(net.links, net.guests, net.relevants)
    return sp.guests_without_path(parts, net.links, paths)


E1 = b.edges_sql(min_common=1)
E2 = b.edges_sql(min_common=2)
R = b.relevants_sql()


def levels_sql(edges: str, max_len: int = 20) -> str:
    """CTEs ``walk`` (all levels a vertex is met at) and ``dist`` (the first one); SQL walks need a bound, here beyond all distances."""
    return f"""
walk as (
  select id as landmark, id, 0 as d from relevants
  union
  select w.landmark, e.dst, w.d + 1 from walk w join {edges}_both e on e.src = w.id where w.d < {max_len}),
dist as (select landmark, id, min(d) as dist from walk group by 1, 2)"""


def paths_sql(edges: str, max_len: int = 20) -> str:
    """CTE ``paths`` (guest, relevant, key, vertices)."""
    return levels_sql(edges, max_len) + f""",
tails as (
  select landmark, id, 0 as d, [id] as vertices from relevants_start
  union all
  select t.landmark, e.dst, t.d + 1, list_prepend(e.dst, t.vertices)
  from tails t join {edges}_both e on e.src = t.id
  join dist x on x.landmark = t.landmark and x.id = e.dst and x.dist = t.d + 1),
paths as (
  select id as guest, landmark as relevant, len(vertices) - 2 as key, vertices from tails where d > 0
  union all select id, landmark, 0, [id, id] from tails where d = 0)""".replace(
        "relevants_start", "(select id as landmark, id from relevants)"
    )


_PATH_TEXT = "select guest, relevant, cast(key as bigint) as key, array_to_string(vertices, '-') as path from paths"
_DEG_SCORES = "select id, cast(degree as bigint) as degree, cast(sum_neighbor_degree as bigint) as sum_neighbor_degree, cast(ci as bigint) as ci"

QUERIES = {
    "pairs": pairs,
    "pairs_min_common": pairs_min_common,
    "pair_titles": pair_titles,
    "title_lists": title_lists,
    "degree": degree,
    "neighbor_sum": neighbor_sum,
    "collective_influence": collective_influence,
    "collective_initialized_influence": collective_initialized_influence,
    "undirected_edges": undirected_edges,
    "pruned_vertices": pruned_vertices,
    "components": components,
    "landmark_distances": landmark_distances,
    "distance_lists": distance_lists,
    "all_shortest_paths": all_shortest_paths,
    "all_shortest_paths_supplier": all_shortest_paths_supplier,
    "path_counts": path_counts,
    "guests_without_path": guests_without_path,
}

_MET = "p as (select distinct l_orderkey as e, l_partkey as v from lineitem)"

SQL = {
    "pairs": f"""with {_MET}
select a.v as src, b.v as dst, count(*) as n_common, min(a.e) as first_event, max(a.e) as last_event
from p a join p b on a.e = b.e and a.v < b.v group by 1, 2""",
    "pairs_min_common": f"with {E2} select src, dst, n_common from edges",
    "pair_titles": f"""with {_MET}
select distinct a.v as src, b.v as dst, a.e as id_release, o_orderpriority as title
from p a join p b on a.e = b.e and a.v < b.v join orders on o_orderkey = a.e""",
    "title_lists": f"""with {_MET}
select a.v as src, b.v as dst, string_agg(a.e || ':' || o_orderpriority, '|' order by a.e, o_orderpriority) as id_title_list
from p a join p b on a.e = b.e and a.v < b.v join orders on o_orderkey = a.e group by 1, 2""",
    "degree": f"with {E1} select id, degree from edges_deg",
    "neighbor_sum": f"""with {b.edges_sql('l_suppkey', 1)}
select src as id, cast(sum(s_nationkey) as bigint) as sum_nation
from edges_both join supplier on s_suppkey = dst group by 1""",
    "collective_influence": f"""with {E1},
s as (select e.src as id, sum(d.degree - 1) as sum_neighbor_degree from edges_both e join edges_deg d on d.id = e.dst group by 1),
scores as (select d.id, degree, sum_neighbor_degree, (degree - 1) * sum_neighbor_degree as ci
  from edges_deg d join s on s.id = d.id)
{_DEG_SCORES} from scores""",
    "collective_initialized_influence": f"""with {E2}, {R}, {b.influence_sql()}
{_DEG_SCORES}, cast(sum_neighbor_relevance as bigint) as sum_neighbor_relevance, cast(cii as bigint) as cii from scores""",
    "undirected_edges": f"with {E2} select src, dst from edges_both",
    "pruned_vertices": f"""with {E2} select p_partkey as id, p_name from part
where p_partkey in (select id from edges_deg)""",
    "components": f"""with recursive {E2},
label as (
  select p_partkey as id, p_partkey as c from part
  union
  select e.dst, l.c from label l join edges_both e on e.src = l.id where l.c < e.dst)
select id, min(c) as component from label group by id""",
    "landmark_distances": f"""with recursive {E2}, {R}, {levels_sql('edges')}
select landmark, id, cast(dist as bigint) as dist from dist""",
    "distance_lists": f"""with recursive {E2}, {R}, {levels_sql('edges')}
select d.id as guest, replace(g.p_name, ' ', '_') as guest_name, d.landmark as relevant, r.p_name as relevant_name,
  cast(dist as bigint) as distance
from dist d join part g on g.p_partkey = d.id join part r on r.p_partkey = d.landmark""",
    "all_shortest_paths": f"with recursive {E2}, {R}, {paths_sql('edges')} {_PATH_TEXT}",
    "all_shortest_paths_supplier": f"""with recursive {b.edges_sql('l_suppkey', 2)}, {R}, {paths_sql('edges')} {_PATH_TEXT}""",
    "path_counts": f"""with recursive {E2}, {R}, {paths_sql('edges')}
select guest, relevant, cast(key as bigint) as key, count(*) as n_paths from paths group by all""",
    "guests_without_path": f"""with recursive {E2}, {R}, {levels_sql('edges')}
select id as guest, -1 as key from edges_deg where id not in (select id from dist)""",
}
