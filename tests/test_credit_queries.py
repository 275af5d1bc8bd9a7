"""Queries on credits, on rows of their own: null and repeated keys, orders without lines and lines without parts."""

import datetime
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from helpers import rows

from collabnet.operators import credits as cr
from registered import bindings, credit_queries

LINES = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string"
ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
PARTS = "p_partkey bigint, p_name string, p_type string, p_brand string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    some = lambda *x: rng.choice([*x, *x, *x, None])
    day = datetime.datetime(2000, 1, 1)
    lines = [(some(*range(40)), some(*range(12)), some(1, 2, 3), some("R", "A", "N"), some("O", "F")) for _ in range(220)]
    orders = [(some(*range(36)), some(*range(9)), some("O", "F", "P"), some("1-URGENT", "2-HIGH", "5-LOW"), day) for _ in range(45)]
    parts = [(some(*range(11)), some("red bolt", "hot ring", "nut"), "T", "B") for _ in range(14)]
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (("lineitem", lines, LINES), ("orders", orders, ORDERS), ("part", parts, PARTS)):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, lines, orders, parts


def _credits(lines, orders, parts):
    """(release, artist, master, priority, supplier, role) for every match of the three tables."""
    for o, p, s, flag, status in lines:
        for key, customer, state, priority, _ in orders:
            for part, _, _, _ in parts:
                if o is not None and p is not None and o == key and p == part:
                    master = customer + 1 if state is not None and state != "P" and customer is not None else None
                    yield o + 1, p, master, priority, s, ",".join(x for x in (flag, status) if x is not None)


def test_credit_merge_sends_no_parts_through_the_driver(spark, tables):
    folder, lines, orders, parts = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # parts pass as small
    try:
        merged = credit_queries.credit_merge(spark, folder)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        got = {(r.id_release, r.id): (r.names, r.roles) for r in merged.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"BroadcastHashJoin \[(l_partkey|id|p_partkey)#", plan)
    want = {}
    for release, artist, _, _, _, role in _credits(lines, orders, parts):
        for name in (n for k, n, _, _ in parts if k == artist):
            for r in role.split(","):
                if r and "r" not in r.lower() and ("a" in r.lower() or "o" in r.lower()):
                    names, roles = want.setdefault((release, artist), (set(), set()))
                    names.update({name} - {None})
                    roles.add(r)
    assert got == {k: ("|".join(sorted(n)), "|".join(sorted(r))) for k, (n, r) in want.items()}


def test_played_with_reads_the_lines_once(spark, tables):
    folder, lines, orders, parts = tables
    met = credit_queries.played_with(spark, folder)
    assert "l_orderkey" not in met._jdf.queryExecution().optimizedPlan().toString()  # pairs read kept credits
    got = {(r.id_artist_out, r.id_artist_in): r.id_releases for r in met.collect()}
    every = list(_credits(lines, orders, parts))
    sizes = Counter(release for release, *_ in every)
    multi = [c for c in every if sizes[c[0]] > 1]
    busy, versions = Counter(c[1] for c in multi), defaultdict(set)
    for release, _, master, *_ in multi:
        versions[master].add(release)
    groups = defaultdict(list)
    for c in multi:
        if busy[c[1]] > 1 or len(versions[c[2]]) == 1:
            groups[c[1], -c[0] if c[2] is None else c[2]].append(c)
    events = defaultdict(set)
    for (artist, _), found in groups.items():
        if not any(c[4] == 1 or "urgent" in (c[3] or "").lower() for c in found):
            events[min(c[0] for c in found)].add(artist)
    want = defaultdict(list)
    for event, artists in sorted(events.items()):
        for pair in combinations(sorted(artists), 2):
            want[pair].append(str(event))
    assert want and got == {k: "|".join(v) for k, v in want.items()}


def test_collapse_takes_a_flag_made_before(spark, tables):
    listed = bindings.credits(spark, tables[0])
    marked = listed.select("id_artist", "id_release", "master_id", cr.compilations(["urgent"], 1).alias("dropped"))
    whole = rows(cr.version_collapse(listed, compilation_words=["urgent"], various=1))
    assert whole and rows(cr.version_collapse(marked, dropped="dropped")) == whole
