"""Every registered query against its SQL and the plan rules it keeps; results under heavy skew."""

import re
from pathlib import Path

import duckdb
import pytest
from brute import distances, neighbors, pair_counts
from helpers import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from collabnet.operators import credits as cr
from collabnet.operators import graph as g
from collabnet.operators import pairs as pr
from collabnet.operators import paths as sp
from collabnet.operators import ranking as rk
from collabnet.session import full_join
from registered import credit_queries, function_queries, graph_queries, path_queries, resolve_queries
from tools import check

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
CORE = [graph_queries, credit_queries, resolve_queries, path_queries, function_queries]
QUERIES = {name: fn for module in CORE for name, fn in module.QUERIES.items()}
SQL = {name: sql for module in CORE for name, sql in module.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query_keeps_the_rules_and_equals_its_sql(spark, duck, name):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    ran = store.executionsList(int(before), 1_000)
    plans = [ran.apply(i).physicalPlanDescription() for i in range(ran.size())]
    assert plans
    for plan in plans:  # of every job on the way, not only what follows the last stored table
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert not re.search("EvalPython|PythonUDF|MapIn|InPandas|InArrow", plan)
    assert len(df.columns) == len(set(df.columns))
    cur = duck.execute(SQL[name])
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert check.rows(df.columns, got) == check.rows(columns, want)


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_library_never_collects():
    for path in (ROOT / "collabnet").rglob("*.py"):
        if path.parent.name == "llm":  # has tests of its own
            continue
        text = path.read_text()
        assert ".collect()" not in text and "toPandas" not in text and "localCheckpoint" not in text, path
        assert ".rdd" not in text, path


HOT = 400


def test_pairs_with_a_third_of_all_rows_in_one_event(spark):
    data = [(0, e) for e in range(HOT)] + [(1 + i % 200, (i * 7) % HOT) for i in range(2 * HOT)]
    df = spark.createDataFrame(data, "event bigint, entity bigint")
    for n in (1, 2):
        got = {(a, b): c for a, b, c in rows(pr.pair_counts(df, "entity", "event", n, block=32), "src", "dst", "n_common")}
        assert got == pair_counts(data, n)


def test_hot_event_is_not_expanded_for_common_thresholds(spark):
    data = [(0, e) for e in range(HOT)] + [(1 + i, e) for i in range(50) for e in (i, i + 1, i + 2)]
    parts = spark.createDataFrame(data, "event bigint, entity bigint")
    kept, left_out = pr._split_crowded(parts, 1)
    assert left_out.where("event = 0").count() == HOT
    assert kept.where("event = 0").isEmpty()


def test_paths_through_a_hub(spark):
    data = [(0, i) for i in range(1, HOT)] + [(i, i + HOT) for i in range(1, 100)]
    near = neighbors(data)
    links = g.undirected(spark.createDataFrame(data, "src bigint, dst bigint"))
    marks = spark.createDataFrame([(1 + HOT,), (0,)], "id bigint")
    adjacency = sp.sharded_adjacency(links, shard=50)
    per_shard = adjacency.groupBy("src", "shard").count().agg(F.max("count")).first()[0]
    assert per_shard < 100 and adjacency.count() == links.count()
    got = {(a, b): d for a, b, d in rows(sp.landmark_distances(links, marks), "landmark", "id", "dist")}
    assert got == {(m, v): d for m in (1 + HOT, 0) for v, d in distances(near, m).items()}


def test_ranks_of_a_pair_with_most_paths(spark):
    # 0 -> {1..60} -> 99: sixty paths of one pair; 98 - 99 is a direct one
    data = [(0, i) for i in range(1, 61)] + [(i, 99) for i in range(1, 61)] + [(98, 99)]
    edges = spark.createDataFrame(data, "src bigint, dst bigint")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id bigint")
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    vertices = vertices.withColumn("ci", F.col("id") % 3).withColumn("cii", F.col("id") % 5)
    ranked = rk.rank_paths(sp.all_shortest_paths(g.undirected(edges), ids(0, 98), ids(99)), vertices)
    got = ranked.where("guest = 0").select("path_count", "sum_CII", "rank_cii").distinct().collect()
    assert {(r.path_count, r.sum_CII, r.rank_cii) for r in got} == {(60, s, 5 - s) for s in range(5)}
    assert rows(ranked.where("guest = 98"), "cb", "sum_CI", "rank_cb") == [(0.0, 1, 1)]


def test_null_masters_in_one_group(spark):
    data = [(i, i, None) for i in range(300)] + [(1000, 1, 5), (1001, 2000, 6)]
    df = spark.createDataFrame(data, "id_release bigint, id_artist bigint, master_id bigint")
    got = rows(cr.one_version(df), "id_artist", "cant_rels", "cant_vers")
    assert got == [(1, 2, 1), (1, 2, 300), (2000, 1, 1)]


def test_full_join_with_hot_and_null_keys(spark):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(None, i) for i in range(200)] + [(2, 0)], "k int, x int")
    right = spark.createDataFrame([(1, "a"), (3, "c"), (None, "n")], "k int, y string")
    got = full_join(left, right, "k")
    assert got.count() == 403
    assert rows(got.where("y is not null").groupBy("y").count()) == [("a", 200), ("c", 1), ("n", 1)]
