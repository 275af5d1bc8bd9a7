import random

import pytest
from brute import components, distances, neighbors, random_edges, shortest_paths
from helpers import rows
from pyspark.sql import functions as F

from collabnet.operators import components as cc
from collabnet.operators import graph as g
from collabnet.operators import paths as sp
from collabnet.operators.components import connected_components, dense_components
from collabnet.operators.index import dense_index

EDGE = "src bigint, dst bigint"


def test_degree_and_influence(spark):
    rng = random.Random(3)
    data = random_edges(rng, 20, 40)
    near = neighbors(data)
    edges = spark.createDataFrame(data, EDGE)
    assert dict(rows(g.degree(edges))) == {v: len(n) for v, n in near.items()}
    cats = {0: 1, 1: 1, 2: 2, 3: 2}
    rel = spark.createDataFrame(list(cats.items()), "id bigint, category int")
    deg = {v: len(n) for v, n in near.items()}
    top = max(deg.values())
    weight = {v: 3 - cats[v] if v in cats else 0 for v in near}
    for r in g.influence(edges, rel).collect():
        v = r.id
        near_ci = sum(deg[n] - 1 for n in near[v])
        near_cii = sum(deg[n] - 1 + weight[n] * top for n in near[v])
        assert r.ci == (deg[v] - 1) * near_ci
        assert r.cii == (deg[v] - 1 + weight[v] * top) * near_cii
        assert (r.sum_neighbor_degree, r.sum_neighbor_relevance) == (near_ci, near_cii)
    assert rows(g.influence(edges), "id", "ci") == rows(g.influence(edges, rel), "id", "ci")


def test_undirected_has_both_ways_once(spark):
    edges = spark.createDataFrame([(1, 2, 2), (2, 1, 3), (1, 3, 1)], "src bigint, dst bigint, n_common int")
    assert rows(g.undirected(edges, 2)) == [(1, 2), (2, 1)]


def test_prune(spark):
    v = spark.createDataFrame([(1, "a"), (9, "z")], "id bigint, name string")
    assert rows(g.prune_vertices(v, spark.createDataFrame([(1, 2)], EDGE))) == [(1, "a")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = random_edges(rng, 60, 45) + [(70 + i, 71 + i) for i in range(25)] + [(100, 100)]
    vertices = set(range(60)) | set(range(70, 96)) | {100, 200}
    v = spark.createDataFrame([(x,) for x in vertices], "id bigint")
    got = dict(rows(connected_components(spark.createDataFrame(data, EDGE), v)))
    assert got == components(data, vertices)


def test_components_without_vertices_keep_loops(spark):
    got = dict(rows(connected_components(spark.createDataFrame([(5, 5), (1, 2)], EDGE))))
    assert got == {1: 1, 2: 1, 5: 5}


@pytest.mark.parametrize("shard", [2, 65536])
@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_brute_force(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(sp.sharded_adjacency, "__defaults__", ((), None, shard))
    rng = random.Random(seed)
    data = random_edges(rng, 40, 60) + [(90, 91)]
    near = neighbors(data)
    guests, relevants = [0, 1, 2, 3, 4, 90, 500], [3, 7, 8, 9, 91, 600]
    links = g.undirected(spark.createDataFrame(data, EDGE))
    got = sp.all_shortest_paths(
        links, spark.createDataFrame([(x,) for x in guests], "id bigint"),
        spark.createDataFrame([(x,) for x in relevants], "id bigint"),
    )
    want = [p for a in guests for b in relevants if a in near and b in near for p in shortest_paths(near, a, b)]
    found = [tuple(r.vertices) for r in got.collect()]
    assert sorted(found) == sorted(want)
    assert got.select("path_id").distinct().count() == len(want)
    assert all(r.key == len(r.vertices) - 2 for r in got.collect())


def test_distances_and_max_len(spark):
    data = [(i, i + 1) for i in range(15)]
    near = neighbors(data)
    links = g.undirected(spark.createDataFrame(data, EDGE))
    marks = spark.createDataFrame([(0,), (7,), (99,)], "id bigint")
    got = {(a, b): d for a, b, d in rows(sp.landmark_distances(links, marks), "landmark", "id", "dist")}
    want = {(m, v): d for m in (0, 7) for v, d in distances(near, m).items()} | {(99, 99): 0}
    assert got == want
    guests = spark.createDataFrame([(0,), (12,)], "id bigint")
    far = sp.all_shortest_paths(links, guests, spark.createDataFrame([(11,)], "id bigint"), max_len=10)
    assert rows(far, "guest", "key") == [(12, 0)]


def test_grouped_search_stays_in_its_graph(spark):
    links = spark.createDataFrame(
        [("a", 1, 2), ("a", 2, 1), ("b", 2, 3), ("b", 3, 2)], "grp string, src bigint, dst bigint"
    )
    marks = spark.createDataFrame([("a", 1), ("b", 3)], "grp string, id bigint")
    got = rows(sp.landmark_distances(links, marks, groups=["grp"]), "grp", "landmark", "id", "dist")
    assert got == [("a", 1, 1, 0), ("a", 1, 2, 1), ("b", 3, 2, 1), ("b", 3, 3, 0)]


def test_guests_without_path_need_an_edge(spark):
    links = g.undirected(spark.createDataFrame([(1, 2), (3, 4)], EDGE))
    guests = spark.createDataFrame([(1,), (3,), (9,)], "id bigint")
    paths = sp.all_shortest_paths(links, guests, spark.createDataFrame([(2,)], "id bigint"))
    assert rows(sp.guests_without_path(guests, links, paths)) == [(3, -1)]


def test_path_views(spark):
    paths = spark.createDataFrame(
        [(0, 1, 3, 1, [1, 2, 3]), (1, 1, 2, 0, [1, 2]), (2, 5, 5, 0, [5, 5])],
        "path_id bigint, guest bigint, relevant bigint, key int, vertices array<bigint>",
    )
    assert rows(sp.path_edges(paths), "path_id", "pos", "src", "dst") == [(0, 0, 1, 2), (0, 1, 2, 3), (1, 0, 1, 2)]
    assert rows(sp.inner_steps(paths), "path_id", "id") == [(0, 2)]
    vertices = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e")], "id bigint, name string")
    edges = spark.createDataFrame([(1, 2, 4), (2, 3, 6)], "src bigint, dst bigint, n_common int")
    wide = sp.described_paths(paths, vertices, edges)
    assert sp.wide_paths(wide, 1).columns == ["path_id", "from", "e0", "v1", "e1", "to"]
    one = sp.wide_paths(wide, 1).first()
    assert (one["from"].name, one.e0.n_common, one.v1.name, one.e1.n_common, one.to.name) == ("a", 4, "b", 6, "c")
    assert rows(sp.wide_paths(wide, 0), "from.name", "e0.n_common", "to.name") == [("a", 4, "b"), ("e", None, "e")]


def test_edge_filter(spark):
    links = g.undirected(spark.createDataFrame([(1, 2), (2, 3), (1, 9), (9, 3)], EDGE))
    one = spark.createDataFrame([(1,)], "id bigint")
    three = spark.createDataFrame([(3,)], "id bigint")
    found = sp.all_shortest_paths(links, one, three, edge_filter=(F.col("src") != 9) & (F.col("dst") != 9))
    assert [r.vertices for r in found.collect()] == [[1, 2, 3]]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("id"), (F.col("id") % 3).alias("grp"))
    whole = dense_index(df, ["id"])
    assert rows(whole, "index", "id") == sorted(((i, i * 7) for i in range(1000)), key=repr)
    grouped = dense_index(df, ["id"], ["grp"])
    for grp in range(3):
        ids = sorted(i * 7 for i in range(1000) if i % 3 == grp)
        got = {r["id"]: r["index"] for r in grouped.where(F.col("grp") == grp).collect()}
        assert got == {v: i for i, v in enumerate(ids)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dense_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    data = random_edges(rng, 60, 45) + [(70 + i, 71 + i) for i in range(25)]  # local minima, a long chain
    data += [(90, 150), (150, 70), (100, 100), (120, 110), (110, 120)]  # a loop, an edge both ways
    vertices = {v for e in data for v in e}
    got = rows(dense_components(spark.createDataFrame(data, EDGE)), "id", "component")
    assert got == sorted(components(data, vertices).items(), key=repr)


def test_dense_components_without_edges_between_trees(spark):
    assert rows(dense_components(spark.createDataFrame([(1, 2), (4, 3), (5, 5)], EDGE))) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]
    assert rows(dense_components(spark.createDataFrame([], EDGE))) == []


def test_dense_components_run_their_rounds_on_an_edge_per_vertex(spark, monkeypatch):
    seen = []
    labelled = cc._labelled
    monkeypatch.setattr(cc, "_labelled", lambda edges: (seen.append(edges.count()), labelled(edges))[1])
    data = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert {c for _, c in rows(dense_components(spark.createDataFrame(data, EDGE)))} == {0}
    assert seen == [39, 0]  # 780 edges
