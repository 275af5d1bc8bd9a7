import random
from collections import Counter, defaultdict

import pytest
from brute import distances, neighbors, random_edges, shortest_paths
from helpers import rows
from pyspark.sql import functions as F

from collabnet.operators import graph as g
from collabnet.operators import index
from collabnet.operators import pathcounts as pc
from collabnet.operators import paths as sp
from collabnet.operators import ranking as rk
from collabnet.operators import subgraph as sg
from collabnet.operators import tree
from collabnet.session import cut_lineage

GUESTS, RELEVANTS = [0, 1, 2, 5], {3: 1, 4: 2, 5: 1}


@pytest.fixture(scope="module")
def world(spark):
    """A small graph with its ranked paths, in Spark and in plain Python."""
    rng = random.Random(11)
    data = random_edges(rng, 14, 24)
    edges = spark.createDataFrame([(a, b, a + b + 1) for a, b in data], "src bigint, dst bigint, n_common bigint")
    near = neighbors(data)
    guests = spark.createDataFrame([(x,) for x in GUESTS], "id bigint")
    relevants = spark.createDataFrame(list(RELEVANTS.items()), "id bigint, category int")
    vertices = cut_lineage(g.influence(edges, relevants))
    paths = sp.all_shortest_paths(g.undirected(edges.select("src", "dst")), guests, relevants)
    ranked = cut_lineage(rk.rank_paths(paths, vertices))
    return {"near": near, "edges": edges, "guests": guests, "relevants": relevants, "vertices": vertices, "ranked": ranked}


def expected(world):
    score = {r.id: r for r in world["vertices"].collect()}
    out = {}
    for a in GUESTS:
        for b in RELEVANTS:
            if a not in world["near"] or b not in world["near"]:
                continue  # no edge, not in the graph
            group = shortest_paths(world["near"], a, b)
            for p in group:
                inner = p[1:-1]
                out[p] = (
                    len(group),
                    float(sum(sum(v in q for q in group) for v in inner)),
                    sum(score[v].ci for v in inner) if inner else 1,
                    sum(score[v].cii for v in inner) if inner else 1,
                )
    return out


def test_scores_and_ranks(world):
    want = expected(world)
    got = world["ranked"].collect()
    assert {tuple(r.vertices): (r.path_count, r.cb, r.sum_CI, r.sum_CII) for r in got} == want
    by_pair = defaultdict(list)
    for r in got:
        by_pair[r.guest, r.relevant].append(r)
    for group in by_pair.values():
        for score, rank in (("cb", "rank_cb"), ("sum_CI", "rank_ci"), ("sum_CII", "rank_cii")):
            values = sorted({r[score] for r in group}, reverse=True)
            assert all(r[rank] == values.index(r[score]) + 1 for r in group)


def test_best_paths_are_the_ranked_ones(world):
    dag = sp.shortest_path_dag(g.undirected(world["edges"].select("src", "dst")), world["guests"], world["relevants"])
    got = world["ranked"].collect()
    pairs = defaultdict(list)
    for r in got:
        pairs[r.guest, r.relevant].append(r)
    assert {(r.guest, r.relevant): (r.key, r.n_paths) for r in pc.pair_counts(dag).collect()} == {p: (x[0].key, len(x)) for p, x in pairs.items()}
    through = Counter((r.relevant, r.guest, v) for r in got for v in r.vertices[1:-1])
    assert {tuple(r)[:3]: r.n_paths for r in pc.paths_through(dag).collect()} == through
    counted = rk.path_scores(world["ranked"].select("path_id", "guest", "relevant", "key", "vertices"), world["vertices"], pc.paths_through(dag))
    assert {r.path_id: r.cb for r in counted.collect()} == {r.path_id: r.cb for r in got if r.key > 0}
    values = {
        "rank_ci": ("sum_CI", pc.best_paths(dag, world["vertices"].select("id", F.col("ci").alias("value")), 2)),
        "rank_cii": ("sum_CII", pc.best_paths(dag, world["vertices"].select("id", F.col("cii").alias("value")), 2)),
        "rank_cb": ("cb", pc.best_paths(dag, pc.paths_through(dag).withColumnRenamed("n_paths", "value"), 2, per_pair=True, bare=0)),
    }
    for rank, (score, chosen) in values.items():
        want = {tuple(r.vertices): (r.guest, r.relevant, r.key, r[rank], r[score]) for r in got if r[rank] <= 2}
        paths = chosen.paths().collect()
        assert {tuple(r.vertices): (r.guest, r.relevant, r.key, r["rank"], r.score) for r in paths} == want and len(paths) == len(want)
        for groups in ([], ["guest"], ["relevant"]):
            load = {tuple(r)[:-1]: r.bc for r in chosen.load(groups).collect()}
            picked = sg.path_load(sg.select_paths(world["ranked"], rank, 2), groups).select(*groups, "id", "bc").collect()
            assert load == pytest.approx({tuple(r)[:-1]: r.bc for r in picked})


def test_counts_on_a_ladder(spark):
    """Ten rungs with sixteen ways each: 2^40 shortest paths that nobody can spell out."""
    rungs, ways = 10, 16
    step = ways + 1
    data = [(step * i, step * i + k) for i in range(rungs) for k in range(1, step)]
    data += [(step * i + k, step * i + step) for i in range(rungs) for k in range(1, step)]
    links = g.undirected(spark.createDataFrame(data, "src bigint, dst bigint"))
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id bigint")
    end = step * rungs
    dag = sp.shortest_path_dag(links, ids(0), ids(end))
    assert rows(pc.pair_counts(dag), "guest", "relevant", "key", "n_paths") == [(0, end, 2 * rungs - 1, 2**40)]
    through = {r.id: int(r.n_paths) for r in pc.paths_through(dag).collect()}
    assert through == {v: 2**40 if v % step == 0 else 2**36 for v in range(1, end)}
    # way k of rung i is worth the digit 16 - k at place i to the base 16, so all paths differ in score
    value = [(step * i + k, (ways - k) * ways**i) for i in range(rungs) for k in range(1, step)]
    best = pc.best_paths(dag, spark.createDataFrame(value, "id bigint, value bigint"), 3)
    assert rows(best.ranks, "rank", "score", "n_paths") == [(r, 2**40 - r, 1) for r in (1, 2, 3)]
    spelled = {r["rank"]: r.vertices for r in best.paths().collect()}
    assert spelled[1] == [v for v in range(end + 1) if v % step < 2]
    assert spelled[3][:4] == [0, 3, step, step + 1] and len(spelled) == 3
    load = {r.id: r.bc for r in best.load().collect()}
    assert load[0] == load[end] == 1.0 and load[1] == load[2] == load[3] == pytest.approx(1 / 3)


def test_ranks_of_a_pair_with_most_scores(spark):
    """A pair with nine tenths of all scores is ranked in many tasks."""
    data = [(1, 1, i) for i in range(900)] + [(1, 1 + i % 50, i) for i in range(100)]
    scored = spark.createDataFrame([(r, g_, (7 * s) % 1000) for r, g_, s in data], "relevant bigint, guest bigint, cb bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ranked = rk._dense_rank(scored, "cb", "rank_cb")
        got = {(r.relevant, r.guest, r.cb): r.rank_cb for r in ranked.collect()}
        held = index.dense_index(scored.distinct(), ["cb"], ["relevant", "guest"], "n").groupBy(F.spark_partition_id()).count()
        parts = scored.distinct().repartitionByRange(8, "relevant", "guest", "cb").groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in parts.collect()) < 300 and held.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    by_pair = defaultdict(set)
    for r, g_, s in data:
        by_pair[r, g_].add((7 * s) % 1000)
    assert got == {(*p, s): sorted(x, reverse=True).index(s) + 1 for p, x in by_pair.items() for s in x}


def test_sums_before(spark):
    rng = random.Random(8)
    data = [(rng.choice([1, 1, 1, 1, 2, 3]), i, rng.randint(0, 9)) for i in range(400)]
    got = index.sums_before(spark.createDataFrame(data, "k bigint, at bigint, w bigint").repartition(5), ["at"], ["k"], "w").collect()
    assert {(r.k, r.at): r.before for r in got} == {(k, at): sum(w for k2, at2, w in data if k2 == k and at2 < at) for k, at, _ in data}


def test_search_with_more_landmarks_than_a_word_has_bits(spark):
    rng = random.Random(9)
    data = random_edges(rng, 150, 220)
    near = neighbors(data)
    links = g.undirected(spark.createDataFrame(data, "src bigint, dst bigint"))
    marks = spark.createDataFrame([(v,) for v in near], "id bigint")
    want = {(m, v): d for m in near for v, d in distances(near, m).items()}
    assert len(near) > 2 * sp.BITS
    got = sp.landmark_distances(links, marks).collect()
    assert {(r.landmark, r.id): r.dist for r in got} == want and len(got) == len(want)
    sums = {r.id: (r.sum_dist, r.n_met) for r in sp.summed_distances(links, marks).collect()}
    assert sums == {v: (sum(x.values()), len(x)) for v in near for x in [distances(near, v)]}


def best(world, max_rank=1):
    return sg.select_paths(world["ranked"], "rank_cii", max_rank)


def kept(world, max_rank=1):
    return [r for r in world["ranked"].collect() if r.rank_cii <= max_rank]


def test_id_lists(world, spark):
    chosen = [r for r in world["ranked"].collect() if r.rank_ci <= 1 or r.rank_cii <= 1]
    ids = {v for r in chosen for v in r.vertices}
    assert {r.id for r in rk.selected_vertex_ids(world["ranked"], 1).collect()} == ids
    events = world["edges"].select("src", "dst", (F.col("src") * 100 + F.col("dst")).alias("event"))
    used = {min(a, b) * 100 + max(a, b) for r in chosen for a, b in zip(r.vertices, r.vertices[1:]) if a != b}
    assert {r.id for r in rk.selected_release_ids(world["ranked"], 1, events).collect()} == used


def test_vertex_rows(world):
    levels, near = defaultdict(set), defaultdict(set)
    for r in kept(world):
        for pos, v in enumerate(r.vertices):
            levels[v].add(r.key + 1 - pos)
            near[v].add(r.key if RELEVANTS[r.relevant] == 1 else -1)
    for r in sg.vertex_rows(best(world), world["guests"], world["relevants"]).collect():
        assert r.levels == sorted(levels.pop(r.id)) and r.cat1Distances == sorted(near[r.id])
        assert r.category == RELEVANTS.get(r.id, 0)
        assert r["class"] == ("guest" if r.id in GUESTS else "relevant" if r.id in RELEVANTS else "other")
    assert not levels


def test_rank_links_and_load(world):
    paths = kept(world, 2)
    want = {}
    for r in paths:
        for a in r.vertices:
            for b in r.vertices:
                want[a, b] = min(want.get((a, b), 99), r.rank_cii)
    got = {(r.id, r.linked): r["rank"] for r in sg.rank_links(best(world, 2)).collect()}
    assert got == want
    load = {r.id: r.bc for r in sg.path_load(best(world, 2)).collect()}
    for v, bc in load.items():
        assert bc == pytest.approx(sum(v in r.vertices for r in paths) / len(paths))


def edge_set(paths, group=lambda r: None):
    return {
        (group(r), a, b, r.rank_cii, r.guest) for r in paths for a, b in zip(r.vertices, r.vertices[1:]) if a != b
    }


def test_degree_and_weight(world):
    rows_ = sg.edge_rows(best(world, 2), world["edges"])
    edges = edge_set(kept(world, 2))
    assert rows_.count() == len(edges)
    want = defaultdict(int)
    for _, a, b, _, _ in edges:
        want[a] += 2
        want[b] += 2
    assert {r.id: r.degree for r in sg.subgraph_degree(rows_).collect()} == want
    near = neighbors([(a, b) for _, a, b, _, _ in edges])
    pairs = {r.id: r.degree for r in sg.subgraph_degree(rows_, distinct_pairs=True).collect()}
    assert pairs == {v: len(n) for v, n in near.items()}
    weights = [r.weight for r in sg.relative_weight(rows_).collect()]
    assert max(weights) == 1.0 and min(weights) > 0
    tops = defaultdict(int)
    for r in rows_.collect():
        tops[r.guest] = max(tops[r.guest], r.n_common)
    each = sg.relative_weight(rows_, ["guest"]).collect()
    assert len(each) == len(edges)
    assert all(r.weight == pytest.approx(r.n_common / tops[r.guest]) for r in each)


def test_weight_has_a_scale_per_group(spark):
    rows_ = spark.createDataFrame([(1, 10), (1, 5), (2, 2)], "guest bigint, n_common bigint")
    got = {(r.guest, r.n_common): r.weight for r in sg.relative_weight(rows_, ["guest"]).collect()}
    assert got == {(1, 10): 1.0, (1, 5): 0.5, (2, 2): 1.0}


@pytest.mark.parametrize("groups", [[], ["guest"]])
def test_closeness(world, groups):
    paths = kept(world)
    ends = sp.path_steps(best(world)).select(*groups, "id").distinct()
    got = sg.closeness(sg.edge_rows(best(world), world["edges"], groups), ends, groups).collect()
    for r in got:
        mine = [p for p in paths if not groups or p.guest == r.guest]
        near = neighbors([(a, b) for _, a, b, _, _ in edge_set(mine)])
        total = sum(distances(near, r.id).values())
        n = len({v for p in mine for v in p.vertices})
        assert r.cc == pytest.approx(n / total if total else 0.0)
    assert len(got) == ends.count()


def test_indexes(world):
    nodes = sg.indexed_nodes(sp.path_steps(best(world)).select("relevant", "id").distinct(), ["relevant"])
    by = defaultdict(list)
    for r in nodes.orderBy("relevant", "index").collect():
        by[r.relevant].append((r["index"], r.id))
    for listed in by.values():
        assert [i for i, _ in listed] == list(range(len(listed)))
        assert [v for _, v in listed] == sorted(v for _, v in listed)
    rows_ = sg.edge_rows(best(world), world["edges"], ["relevant"])
    for r in sg.indexed_links(rows_, nodes, ["relevant"]).collect():
        index = {v: i for i, v in by[r.relevant]}
        assert (r.source, r.target) == (index[r.src], index[r.dst])
    for r in sg.indexed_rank_links(sg.rank_links(best(world), ["relevant"]), nodes, ["relevant"]).collect():
        assert r.linked_index in {i for i, _ in by[r.relevant]}


def plain_tree_order(rows_):
    """(guest, number, parent's number, pos, id, is_end, size) of the nested documents."""
    below = defaultdict(set)
    for guest, pos, v, end, parent in rows_:
        below[guest, pos, parent].add((v, end))
    out = set()

    def walk(guest, pos, v, end, number, above):
        size = 1
        for child, child_end in sorted(below[guest, pos + 1, v]) if not end else ():
            size += walk(guest, pos + 1, child, child_end, number + size, number)
        out.add((guest, number, above, pos, v, end, size))
        return size

    for guest in {r[0] for r in rows_}:
        walk(guest, 0, guest, False, 0, None)
    return out


def test_tree(world):
    want = {
        (r.guest, i, r.vertices[i], i == len(r.vertices) - 1, r.vertices[i - 1])
        for r in kept(world)
        for i in range(1, len(r.vertices))
    }
    got = tree.tree_rows(best(world))
    assert {tuple(r) for r in got.select("guest", "pos", "id", "is_end", "parent").collect()} == want
    columns = ["guest", "preorder", "parent_preorder", "pos", "id", "is_end", "size"]
    order = tree.tree_order(got)
    listed = [tuple(r) for r in order.select(*columns).collect()]
    assert set(listed) == plain_tree_order(want) and len(set(listed)) == len(listed)
    numbered = [(r.guest, r.preorder) for r in tree.in_document_order(order).collect()]
    assert numbered == sorted(numbered)
    assert tree.tree_order(got.limit(0)).count() == 0


def test_tree_with_shared_nodes_and_many_children(spark):
    # two ways to vertex 50, which has 300 children, one of them an end and an inner vertex
    paths = [[0, a, 50, 100 + i] for a in (1, 2) for i in range(300)] + [[0, 1, 50, 100, 900], [7, 50]]
    df = spark.createDataFrame([(p[0], p) for p in paths], "guest bigint, vertices array<bigint>")
    got = tree.tree_rows(df)
    want = plain_tree_order({(p[0], i, p[i], i == len(p) - 1, p[i - 1]) for p in paths for i in range(1, len(p))})
    listed = [tuple(r) for r in tree.tree_order(got).collect()]
    assert set(listed) == want and len(listed) == len(want) == 1 + 2 * (1 + 1 + 302) + 2


def test_distance_lists(world, spark):
    far = sp.landmark_distances(g.undirected(world["edges"].select("src", "dst")), world["relevants"])
    names = world["guests"].withColumn("name", F.concat(F.lit("g_"), "id"))
    rel = world["relevants"].withColumn("name", F.concat(F.lit("r_"), "id"))
    got = rows(sp.distance_lists(far, names, rel), "guest", "relevant", "relevant_name", "distance")
    want = []
    for a in GUESTS:
        for b in RELEVANTS:
            d = distances(world["near"], b).get(a) if b in world["near"] else (0 if a == b else None)
            if d is not None:
                want.append((a, b, f"r {b}", d))
    assert got == sorted(want, key=repr)
