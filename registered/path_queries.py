"""Ranking of paths and the graphs and trees exported from the best ones."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from collabnet.operators import pairs as pr
from collabnet.operators import pathcounts as pc
from collabnet.operators import paths as sp
from collabnet.operators import ranking as rk
from collabnet.operators import subgraph as sg
from collabnet.operators import tree
from collabnet.operators.graph import Graph
from collabnet.plans import jobs
from collabnet.session import cut_lineage
from registered import bindings as b
from registered.graph_queries import INFLUENCE, levels_sql, paths_sql

MAX_RANK = 2
N_FLAT = 6  # digits kept of float results


class Ranked:
    """The network and the shortest paths between all parts and the relevants, as arcs."""

    def __init__(self, edges):
        self.net = b.PartNetwork(edges)
        self.dag = self.net.dag()

    @cached_property
    def vertices(self):
        return self.net.scores()

    @cached_property
    def through(self):
        return cut_lineage(pc.paths_through(self.dag))

    @cached_property
    def paths(self):
        """Every path, with its ranks."""
        return cut_lineage(rk.rank_paths(self.dag.paths(), self.vertices, self.through))

    def scored(self, max_rank=MAX_RANK):
        return pc.best_paths(self.dag, self.vertices.select("id", F.col("cii").alias("value")), max_rank)

    def best(self, max_rank=MAX_RANK):
        """The paths of rank_cii up to ``max_rank``; no others are spelled out."""
        return self.scored(max_rank).paths()


def _parts(spark, sf):
    return Ranked(b.part_edges(spark, sf, 2))


def _path_text():
    return F.array_join("vertices", "-").alias("path")


def rank_paths(spark, sf):
    ranked = b.longs(_parts(spark, sf).paths, "key", "cb", "sum_CI", "sum_CII", "rank_cb", "rank_ci", "rank_cii")
    return ranked.select(
        "guest", "relevant", "key", _path_text(), "path_count", "cb",
        "sum_CI", "sum_CII", "rank_cb", "rank_ci", "rank_cii",
    )


def _scores(spark, sf, *names):
    r = _parts(spark, sf)
    paths = r.dag.paths()
    scored = rk.path_scores(paths, r.vertices, r.through)
    named = scored.join(paths.select("path_id", "guest", "relevant", "vertices"), "path_id")
    return b.longs(named, *names).select("guest", "relevant", _path_text(), *names)


def path_overlap(spark, sf):
    return _scores(spark, sf, "cb")


def path_influence(spark, sf):
    return _scores(spark, sf, "sum_CI", "sum_CII")


def paths_through(spark, sf):
    return b.longs(_parts(spark, sf).through, "n_paths")


def score_ranks(spark, sf):
    """The best distinct scores of every pair and how many paths have them."""
    return b.longs(_parts(spark, sf).scored().ranks, "rank", "score", "n_paths").drop("dist")


def _best(paths):
    return b.longs(paths, "key", "rank", "score").select("guest", "relevant", "key", _path_text(), "rank", "score")


def best_paths(spark, sf):
    return _best(_parts(spark, sf).best())


def best_paths_by_overlap(spark, sf):
    """The same by ``cb``, whose vertex values belong to the pair."""
    r = _parts(spark, sf)
    values = r.through.withColumnRenamed("n_paths", "value")
    return _best(pc.best_paths(r.dag, values, MAX_RANK, per_pair=True, bare=0).paths())


def selected_vertex_ids(spark, sf):
    return rk.selected_vertex_ids(_parts(spark, sf).paths, 1)


def selected_release_ids(spark, sf):
    r = _parts(spark, sf)
    return rk.selected_release_ids(r.paths, 1, b.edge_orders(spark, sf, r.net.edges))


def path_edges(spark, sf):
    edges = b.longs(sp.path_edges(_parts(spark, sf).dag.paths()), "key", "pos")
    return edges.select("guest", "relevant", "key", "pos", "src", "dst")


def described_paths(spark, sf):
    """Paths with the names of their vertices and the weights of their edges."""
    r = _parts(spark, sf)
    names = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    wide = sp.described_paths(r.dag.paths(), names, r.net.edges)
    return wide.select(
        "guest", "relevant", _path_text(), F.array_join(F.col("vertex_rows.p_name"), "-").alias("names"),
        F.array_join(F.col("edge_rows.n_common").cast("array<string>"), "-").alias("weights"),
    )


def wide_paths(spark, sf):
    """Paths with one vertex between, a column for each place."""
    r = _parts(spark, sf)
    names = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    wide = sp.wide_paths(sp.described_paths(r.dag.paths(), names, r.net.edges), 1)
    return wide.select(
        F.col("from.id").alias("guest"), F.col("e0.n_common").alias("e0"), F.col("v1.id").alias("v1"), F.col("v1.p_name").alias("v1_name"),
        F.col("e1.n_common").alias("e1"), F.col("to.id").alias("relevant"),
    )


def short_paths(spark, sf):
    """The search with a bound of two edges."""
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    paths = sp.all_shortest_paths(net.links, net.guests, net.relevants, max_len=2)
    return b.longs(paths, "key").select("guest", "relevant", "key", _path_text())


def separation_lists(spark, sf):
    """Every guest's distances to the relevants as one list."""
    net = b.PartNetwork(b.part_edges(spark, sf, 2))
    names = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    graph = Graph(names, net.edges)
    lists = jobs.separation_lists(jobs.path_sizes(graph, names, net.relevants.join(names, "id")))
    shown = F.transform("grado_de_separacion", lambda x: F.concat_ws(":", x.name_relevant, x.distancia.cast("string")))
    return lists.select("guest", "guest_name", F.array_join(shown, "|").alias("distances"))


def create_graph(spark, sf):
    """Artists, pairs and releases to scored vertices with their component."""
    met = pr.pair_events(b.table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")
    relations = met.select(
        F.col("src").alias("id_artist_out"), F.col("dst").alias("id_artist_in"), F.col("event").alias("id_release")
    )
    artists = b.table(spark, sf, "part").select(F.col("p_partkey").alias("discogs_id"), F.col("p_name").alias("name"))
    releases = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id_release"), F.col("o_orderpriority").alias("title"))
    r = cut_lineage(b.relevants(b.part_edges(spark, sf, 1)))
    return b.longs(jobs.create_graph(artists, relations, releases, r).vertices, *INFLUENCE)


def compute_paths(spark, sf):
    """The path job with its rows for guests without a path."""
    r = _parts(spark, sf)
    named = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    paths = jobs.compute_paths(Graph(named, r.net.edges), named, r.net.relevants, 2)
    return b.longs(paths, "key").groupBy("guest", "key").agg(F.count("relevant").alias("n_paths"))


def path_vertices(spark, sf):
    r = _parts(spark, sf)
    rows = sg.vertex_rows(r.best(), r.net.guests, r.net.relevants)
    return rows.select(
        "id", "category", "class", F.array_join("levels", "|").alias("levels"),
        F.array_join("cat1Distances", "|").alias("cat1_distances"),
    )


def rank_links(spark, sf):
    return b.longs(sg.rank_links(_parts(spark, sf).best()), "rank")


def path_load(spark, sf):
    """Share of the best paths through a vertex, from counts on the arcs."""
    return _parts(spark, sf).scored().load().select("id", F.round("bc", N_FLAT).alias("bc"))


def subgraph_edges(spark, sf):
    r = _parts(spark, sf)
    rows = sg.relative_weight(sg.edge_rows(r.best(), r.net.edges))
    return b.longs(rows, "rank").select(
        "src", "dst", "rank", "guest", "n_common", F.round(F.col("weight").cast("double"), 4).alias("weight")
    )


def subgraph_edges_by_guest(spark, sf):
    """Every guest's graph with weights on a scale of its own."""
    r = _parts(spark, sf)
    rows = sg.relative_weight(sg.edge_rows(r.best(), r.net.edges, ["guest"]), ["guest"])
    return b.longs(rows, "rank").select("guest", "src", "dst", "rank", "n_common", F.round(F.col("weight").cast("double"), 4).alias("weight"))


def release_details(spark, sf):
    """The orders behind the edges of the best paths."""
    r = _parts(spark, sf)
    none = F.lit(None).cast("string")
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id_release"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("released"),
        none.alias("country"), F.array("o_orderstatus").alias("genres"), F.array(none).alias("labels"), none.alias("notes"),
        F.array("o_custkey").alias("primary_artists"), F.array(none).alias("primary_artist_names"),
    )
    used = sp.path_edges(r.best(max_rank=1)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    links = b.edge_orders(spark, sf, r.net.edges).join(used, ["src", "dst"], "left_semi").withColumnRenamed("event", "id_release")
    got = jobs.release_details(links, orders, ["src", "dst"])
    return got.select("src", "dst", "id_release", "title", "image", "released", F.array_join("genres", "|").alias("genres"))


def subgraph_degree(spark, sf):
    r = _parts(spark, sf)
    return sg.subgraph_degree(sg.edge_rows(r.best(), r.net.edges))


def closeness_by_guest(spark, sf):
    r = Ranked(b.supplier_edges(spark, sf, 2))
    best = r.best()
    ends = sp.path_steps(best).select("guest", "id").distinct()
    rows = sg.edge_rows(best, r.net.edges, ["guest"])
    return sg.closeness(rows, ends, ["guest"]).select("guest", "id", F.round("cc", N_FLAT).alias("cc"))


def nodes_by_relevant(spark, sf):
    r = _parts(spark, sf)
    rows = sg.vertex_rows(r.best(), r.net.guests, r.net.relevants, ["relevant"])
    return sg.indexed_nodes(rows, ["relevant"]).select(
        "relevant", "index", "id", "image", "class", "category", F.array_join("levels", "|").alias("levels")
    )


def links_by_relevant(spark, sf):
    r = _parts(spark, sf)
    best = r.best()
    nodes = sg.indexed_nodes(sp.path_steps(best).select("relevant", "id").distinct(), ["relevant"])
    rows = sg.edge_rows(best, r.net.edges, ["relevant"])
    return b.longs(sg.indexed_links(rows, nodes, ["relevant"]), "rank").select(
        "relevant", "source", "target", "rank", "guest", "n_common"
    )


def tree_rows(spark, sf):
    return b.longs(tree.tree_rows(_parts(spark, sf).best(max_rank=1)), "pos")


def tree_order(spark, sf):
    """Every node of the guests' nested documents with its number in document order."""
    return b.longs(tree.tree_order(tree.tree_rows(_parts(spark, sf).best(max_rank=1))), "pos")


QUERIES = {
    "rank_paths": rank_paths,
    "path_overlap": path_overlap,
    "path_influence": path_influence,
    "selected_vertex_ids": selected_vertex_ids,
    "selected_release_ids": selected_release_ids,
    "path_edges": path_edges,
    "described_paths": described_paths,
    "create_graph": create_graph,
    "compute_paths": compute_paths,
    "path_vertices": path_vertices,
    "rank_links": rank_links,
    "path_load": path_load,
    "subgraph_edges": subgraph_edges,
    "subgraph_degree": subgraph_degree,
    "closeness_by_guest": closeness_by_guest,
    "nodes_by_relevant": nodes_by_relevant,
    "links_by_relevant": links_by_relevant,
    "tree_rows": tree_rows,
    "tree_order": tree_order,
    "wide_paths": wide_paths,
    "short_paths": short_paths,
    "separation_lists": separation_lists,
    "subgraph_edges_by_guest": subgraph_edges_by_guest,
    "release_details": release_details,
    "paths_through": paths_through,
    "score_ranks": score_ranks,
    "best_paths": best_paths,
    "best_paths_by_overlap": best_paths_by_overlap,
}


def ranked_sql(entity: str = "l_partkey", min_common: int = 2) -> str:
    return f"""with recursive {b.edges_sql(entity, min_common)}, {b.relevants_sql()}, {b.influence_sql()}, {paths_sql('edges')},
numbered as (select row_number() over () as pid, * from paths),
inner_v as (select pid, guest, relevant, unnest(vertices[2:len(vertices)-1]) as id from numbered where key > 0),
through as (select relevant, guest, id, count(*) as n from inner_v group by all),
path_scores as (select pid, sum(n) as cb, sum(ci) as sum_ci, sum(cii) as sum_cii
  from inner_v join through using (relevant, guest, id) join scores using (id) group by pid),
ranked as (select n.pid, n.guest, n.relevant, n.key, n.vertices,
    count(*) over (partition by n.relevant, n.guest) as path_count,
    coalesce(cb, 0) as cb, coalesce(sum_ci, 1) as sum_ci, coalesce(sum_cii, 1) as sum_cii,
    dense_rank() over (partition by n.relevant, n.guest order by coalesce(cb, 0) desc) as rank_cb,
    dense_rank() over (partition by n.relevant, n.guest order by coalesce(sum_ci, 1) desc) as rank_ci,
    dense_rank() over (partition by n.relevant, n.guest order by coalesce(sum_cii, 1) desc) as rank_cii
  from numbered n left join path_scores s on s.pid = n.pid),
best as (select *, rank_cii as rank from ranked where rank_cii <= {MAX_RANK}),
steps as (select pid, guest, relevant, key, rank, unnest(range(0, len(vertices))) as pos, unnest(vertices) as id from best),
hops as (select a.pid, a.guest, a.relevant, a.key, a.rank, a.pos, a.id as src, n.id as dst
  from steps a join steps n on n.pid = a.pid and n.pos = a.pos + 1 where a.guest <> a.relevant),
ends as (select id as relevant, category from relevants)
"""


_RANKED = ranked_sql()
_TEXT = "array_to_string(vertices, '-') as path"
_LEVELS = "string_agg(distinct (key + 1 - pos), '|' order by (key + 1 - pos))"

SQL = {
    "rank_paths": _RANKED + f"""select guest, relevant, cast(key as bigint) as key, {_TEXT}, path_count, cast(cb as bigint) as cb,
  cast(sum_ci as bigint) as "sum_CI", cast(sum_cii as bigint) as "sum_CII", rank_cb, rank_ci, rank_cii from ranked""",
    "path_overlap": _RANKED + f"select guest, relevant, {_TEXT}, cast(cb as bigint) as cb from ranked where key > 0",
    "path_influence": _RANKED + f"""select guest, relevant, {_TEXT}, cast(sum_ci as bigint) as "sum_CI",
  cast(sum_cii as bigint) as "sum_CII" from ranked where key > 0""",
    "selected_vertex_ids": _RANKED + "select distinct unnest(vertices) as id from ranked where rank_ci <= 1 or rank_cii <= 1",
    "selected_release_ids": _RANKED + """, v as (select pid, unnest(range(0, len(vertices))) as pos, unnest(vertices) as id
  from ranked where (rank_ci <= 1 or rank_cii <= 1) and guest <> relevant),
h as (select distinct least(a.id, n.id) as lo, greatest(a.id, n.id) as hi from v a join v n on n.pid = a.pid and n.pos = a.pos + 1)
select distinct x.e as id from h join edges_p x on x.v = lo join edges_p y on y.v = hi and y.e = x.e""",
    "path_edges": _RANKED + """, v as (select pid, guest, relevant, key, unnest(range(0, len(vertices))) as pos, unnest(vertices) as id
  from ranked where guest <> relevant)
select a.guest, a.relevant, cast(a.key as bigint) as key, a.pos, a.id as src, n.id as dst
from v a join v n on n.pid = a.pid and n.pos = a.pos + 1""",
    "described_paths": _RANKED + f""", n as (select pid, guest, relevant, {_TEXT}, vertices, unnest(range(0, len(vertices))) as pos,
    unnest(vertices) as id from ranked),
names as (select pid, string_agg(p_name, '-' order by pos) as names from n join part on p_partkey = id group by pid),
weights as (select a.pid, string_agg(n_common, '-' order by a.pos) as weights from n a join n c on c.pid = a.pid and c.pos = a.pos + 1
  join edges e on e.src = least(a.id, c.id) and e.dst = greatest(a.id, c.id) group by a.pid)
select guest, relevant, {_TEXT}, names, weights from ranked join names using (pid) left join weights using (pid)""",
    "create_graph": f"""with recursive {b.edges_sql(min_common=1)}, {b.relevants_sql()}, {b.influence_sql()},
label as (select id, id as c from edges_deg
  union select e.dst, l.c from label l join edges_both e on e.src = l.id where l.c < e.dst),
comp as (select id, min(c) as component from label group by id)
select id, p_name as name, cast(degree as bigint) as degree, cast(sum_neighbor_degree as bigint) as sum_neighbor_degree,
  cast(ci as bigint) as ci, cast(sum_neighbor_relevance as bigint) as sum_neighbor_relevance, cast(cii as bigint) as cii, component
from scores join part on p_partkey = id join comp using (id)""",
    "compute_paths": f"""with recursive {b.edges_sql()}, {b.relevants_sql()}, {paths_sql('edges')}
select guest, key, count(*) as n_paths from paths group by all
union all select id, -1, 0 from edges_deg where id not in (select guest from paths)""",
    "path_vertices": _RANKED + f"""select s.id, coalesce(any_value(r.category), 0) as category, 'guest' as class,
  {_LEVELS} as levels,
  string_agg(distinct case when ends.category = 1 then key else -1 end, '|' order by case when ends.category = 1 then key else -1 end) as cat1_distances
from steps s join ends using (relevant) left join relevants r on r.id = s.id group by s.id""",
    "rank_links": _RANKED + """select a.id, c.id as linked, min(a.rank) as rank
from steps a join steps c on a.pid = c.pid group by 1, 2""",
    "path_load": _RANKED + """select id, round(count(distinct pid) / (select count(*) from best), 6) as bc from steps group by id""",
    "subgraph_edges": _RANKED + """, d as (select distinct src, dst, rank, guest from hops),
w as (select d.*, n_common from d join edges e on e.src = least(d.src, d.dst) and e.dst = greatest(d.src, d.dst))
select *, round(n_common / (select max(n_common) from w), 4) as weight from w""",
    "subgraph_degree": _RANKED + """, d as (select distinct src, dst, rank, guest from hops)
select id, 2 * count(*) as degree from (select src as id from d union all select dst from d) group by id""",
    "closeness_by_guest": ranked_sql("l_suppkey", 2) + """, l as (select distinct guest, src, dst from hops
  union select distinct guest, dst, src from hops),
vs as (select distinct guest, id from steps),
far as (select guest, id as s, id as v, 0 as d from vs
  union select f.guest, f.s, l.dst, f.d + 1 from far f join l on l.guest = f.guest and l.src = f.v
  where f.d < (select count(*) from relevants)),
dist2 as (select guest, s, v, min(d) as d from far group by all)
select guest, s as id, round(case when sum(d) > 0 then (select count(*) from vs where vs.guest = dist2.guest) / sum(d) else 0 end, 6) as cc
from dist2 group by guest, s""",
    "nodes_by_relevant": _RANKED + f"""select s.relevant, row_number() over (partition by s.relevant order by s.id) - 1 as index, s.id,
  s.id || '.jpg' as image, 'guest' as class, coalesce(any_value(r.category), 0) as category, {_LEVELS} as levels
from steps s left join relevants r on r.id = s.id group by s.relevant, s.id""",
    "links_by_relevant": _RANKED + """, vs as (select relevant, id, row_number() over (partition by relevant order by id) - 1 as i
  from (select distinct relevant, id from steps)),
d as (select distinct relevant, src, dst, rank, guest from hops)
select d.relevant, a.i as source, c.i as target, rank, guest, n_common from d
join vs a on a.relevant = d.relevant and a.id = d.src join vs c on c.relevant = d.relevant and c.id = d.dst
join edges e on e.src = least(d.src, d.dst) and e.dst = greatest(d.src, d.dst)""",
    "tree_rows": _RANKED + """, v as (select pid, guest, len(vertices) as n, unnest(range(0, len(vertices))) as pos, unnest(vertices) as id
  from ranked where rank_cii <= 1)
select distinct a.guest, a.pos, a.id, a.pos = a.n - 1 as is_end, p.id as parent
from v a join v p on p.pid = a.pid and p.pos = a.pos - 1""",
    "tree_order": _RANKED + """, v as (select pid, guest, len(vertices) as n, unnest(range(0, len(vertices))) as pos, unnest(vertices) as id
  from ranked where rank_cii <= 1),
t as (select distinct a.guest, a.pos, a.id, a.pos = a.n - 1 as is_end, p.id as parent
  from v a join v p on p.pid = a.pid and p.pos = a.pos - 1),
occ as (select distinct guest, cast(0 as bigint) as pos, guest as id, false as is_end, cast([] as bigint[]) as place from t
  union all
  select o.guest, t.pos, t.id, t.is_end, list_append(o.place, t.id * 2 + cast(t.is_end as bigint))
  from occ o join t on t.guest = o.guest and t.pos = o.pos + 1 and t.parent = o.id where not o.is_end),
told as (select *, row_number() over (partition by guest order by place) - 1 as preorder from occ)
select n.guest, n.preorder, p.preorder as parent_preorder, n.pos, n.id, n.is_end,
  (select count(*) from occ x where x.guest = n.guest and x.place[:len(n.place)] = n.place) as size
from told n left join told p on p.guest = n.guest and n.pos > 0 and p.place = n.place[:len(n.place) - 1]""",
    "paths_through": _RANKED + "select relevant, guest, id, n as n_paths from through",
    "score_ranks": _RANKED + """select relevant, guest, rank_cii as rank, cast(sum_cii as bigint) as score, count(*) as n_paths
from best group by all""",
    "best_paths": _RANKED + f"""select guest, relevant, cast(key as bigint) as key, {_TEXT}, rank, cast(sum_cii as bigint) as score
from best""",
    "best_paths_by_overlap": _RANKED + f"""select guest, relevant, cast(key as bigint) as key, {_TEXT}, rank_cb as rank,
  cast(cb as bigint) as score from ranked where rank_cb <= {MAX_RANK}""",
    "wide_paths": _RANKED + """select guest, a.n_common as e0, vertices[2] as v1, p_name as v1_name, c.n_common as e1, relevant
from ranked join part on p_partkey = vertices[2]
join edges a on a.src = least(vertices[1], vertices[2]) and a.dst = greatest(vertices[1], vertices[2])
join edges c on c.src = least(vertices[2], vertices[3]) and c.dst = greatest(vertices[2], vertices[3]) where key = 1""",
    "short_paths": f"""with recursive {b.edges_sql()}, {b.relevants_sql()}, {paths_sql('edges')}
select guest, relevant, cast(key as bigint) as key, {_TEXT} from paths where key <= 1""",
    "separation_lists": f"""with recursive {b.edges_sql()}, {b.relevants_sql()}, {levels_sql('edges')}
select d.id as guest, g.p_name as guest_name,
  string_agg(r.p_name || ':' || dist, '|' order by r.p_name, dist) as distances
from dist d join part g on g.p_partkey = d.id join part r on r.p_partkey = d.landmark group by 1, 2""",
    "subgraph_edges_by_guest": _RANKED + """, d as (select distinct src, dst, rank, guest from hops),
w as (select d.*, n_common from d join edges e on e.src = least(d.src, d.dst) and e.dst = greatest(d.src, d.dst))
select guest, src, dst, rank, n_common, round(n_common / (max(n_common) over (partition by guest)), 4) as weight from w""",
    "release_details": _RANKED + """, u as (select distinct least(src, dst) as src, greatest(src, dst) as dst from hops where rank = 1),
m as (select u.src, u.dst, x.e from u join edges_p x on x.v = u.src join edges_p y on y.v = u.dst and y.e = x.e)
select src, dst, e as id_release, o_orderpriority as title, e || '.jpg' as image, o_orderstatus as released, o_orderstatus as genres
from m join orders on o_orderkey = e""",
}
