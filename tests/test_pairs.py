import random

import pytest
from brute import pair_counts
from helpers import rows
from pyspark.sql import functions as F

from collabnet.operators import pairs as pr

SCHEMA = "event bigint, entity bigint"


def _credits(seed, n_events=30, n_entities=25, hot=True):
    rng = random.Random(seed)
    data = [(rng.randrange(n_events), rng.randrange(n_entities)) for _ in range(250)]
    if hot:  # one event holds about a third of all rows
        data += [(1000, e) for e in range(n_entities)] * 5
    return data + [(None, 1), (1, None)]


@pytest.mark.parametrize("block", [3, 512])
@pytest.mark.parametrize("min_common", [1, 2, 3, 5])
def test_counts_equal_brute_force(spark, block, min_common):
    data = _credits(min_common)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(s, d): n for s, d, n in rows(pr.pair_counts(df, "entity", "event", min_common, block), "src", "dst", "n_common")}
    assert got == pair_counts(data, min_common)


def test_pairs_are_canonical_and_met_once_per_event(spark):
    df = spark.createDataFrame(_credits(7), SCHEMA)
    met = rows(pr.pair_events(df, "entity", "event", block=4), "src", "dst", "event")
    assert all(s < d for s, d, _ in met)
    assert len(met) == len(set(met))
    assert met == rows(pr.pair_events(df, "entity", "event"), "src", "dst", "event")


def test_block_cells_bound_the_work_of_a_task(spark):
    data = [(1, e) for e in range(100)]
    left, right = pr._block_cells(spark.createDataFrame(data, SCHEMA), 10)
    cells = left.groupBy("event", "lo", "hi").count().agg({"count": "max"}).first()[0]
    assert cells <= 30  # hashing spreads 100 rows over 10 blocks


def test_lists_and_titles(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], SCHEMA)
    assert rows(pr.pair_lists(df, "entity", "event")) == [(1, 2, [1, 2])]
    titles = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "id bigint, title string")
    titled = pr.pair_titles(pr.pair_events(df, "entity", "event"), titles, "id", "title")
    lists = pr.title_lists(titled).first().id_title_list
    assert [(x.id_release, x.title) for x in lists] == [(1, "a"), (2, "b")]


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 3)], "src int, dst int, n_common int")
    assert rows(df.where(pr.at_least(2)), "src", "dst") == [(1, 3), (2, 3)]


@pytest.mark.parametrize("block", [4, 512])
def test_rows_of_a_task_do_not_grow_with_the_input(spark, monkeypatch, block):
    monkeypatch.setattr("collabnet.session.ROWS_PER_TASK", 100)

    def largest(df):
        return df.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]

    for n_events in (200, 2000):
        data = [(e, (7 * e + k * k) % 5003) for e in range(n_events) for k in range(6)]
        df = spark.createDataFrame(data, SCHEMA)
        assert largest(pr.pair_events(df, "entity", "event", block)) <= 600
        assert largest(pr.pair_counts(df, "entity", "event", 1, block)) <= 600
        lists = pr.pair_lists(df, "entity", "event")
        assert largest(lists) <= 600
        assert lists.agg(F.sum(F.size("id_releases"))).first()[0] == 15 * n_events
