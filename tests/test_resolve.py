import random

import pytest
from helpers import rows

from collabnet.functions import urls
from collabnet.operators import lookup, resolve, update
from collabnet.session import full_join


def test_full_join_passes_null_keys(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k bigint, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k bigint, y string")
    assert rows(full_join(a, b, "k"), "k", "x", "y") == sorted(
        [(1, "a", "p"), (None, "b", None), (3, "c", None), (None, None, "q"), (4, None, "r")], key=repr
    )


def test_countries(spark):
    areas = [(1, "AR", 1), (2, "UY", 1), (10, "Province", 2), (11, "City", 3), (20, "Both", 3), (30, "Island", None)]
    links = [(10, 1), (11, 10), (20, 10), (20, 2), (1, 2)]
    chain = [(100 + i, f"L{i}", 4) for i in range(12)]
    areas += chain + [(200, "Ring", 4), (201, "Ring", 4)]
    links += [(100, 10), *[(100 + i, 99 + i) for i in range(1, 12)], (200, 201), (201, 200)]
    got = rows(
        resolve.area_countries(
            spark.createDataFrame(areas, "areaID bigint, area_name string, area_type int"),
            spark.createDataFrame(links, "areaID bigint, area2ID bigint"),
        ),
        "areaID",
        "country",
    )
    assert got == sorted(
        [(1, "AR"), (2, "UY"), (10, "AR"), (11, "AR"), (20, "AR"), (20, "UY"), *[(100 + i, "AR") for i in range(12)]],
        key=repr,
    )


def test_kb_artists_and_labels(spark):
    entities = spark.createDataFrame(
        [("Q1", "12", "m", "N", ["G1", "G9"], ["I1"], None, ["C1"], None, ["l", None]), ("Q2", None, None, "M", [], [], None, [], ["i"], None)],
        "wikidata_id string, discogs_id string, musicbrainz_id string, name string, genre_ids array<string>, "
        "instrument_ids array<string>, date_of_birth_calendar array<struct<time:string,calendar:string>>, "
        "citizenship_ids array<string>, images array<string>, links array<string>",
    )
    labels = spark.createDataFrame([("G1", "Jazz"), ("I1", "Bass"), ("C1", "AR"), ("X", "x")], "id string, label string")
    got = rows(
        resolve.kb_artists(entities, labels), "wikidata_id", "discogs_id", "genres3", "instruments", "citizenships",
        "images", "wikidata_links",
    )
    assert got == [("Q1", 12, ["Jazz"], ["Bass"], ["AR"], [], ["l"]), ("Q2", None, [], [], [], ["i"], [])]
    strict = rows(resolve.kb_artists(entities, labels, strict_ids=True), "wikidata_id", "discogs_id")
    assert strict == [("Q1", 12), ("Q2", 0)]


def test_search(spark):
    artists = spark.createDataFrame([(1, "José Pérez"), (2, "Jose P."), (3, None), (4, "Ann")], "id bigint, name string")
    assert rows(lookup.search_names(artists, ["jose_p"]), "id", "search_name") == [(1, "jose p"), (2, "jose p")]
    assert rows(lookup.search_names(artists, ["^a.n$", "an"]), "id", "search_name") == [(4, "^a.n$"), (4, "an")]
    assert rows(lookup.search_names(artists, ["^a.n$"], literal=True)) == []


def test_selection(spark):
    chosen = spark.createDataFrame([(1, "m", None)], "discogs_id bigint, musicbrainz_id string, wikidata_id string")
    known = spark.createDataFrame([(1, "José  X"), (2, "B")], "discogs_id bigint, name string")
    assert rows(lookup.selection_to_guests(chosen, known)) == [(1, "Jose_X")]
    assert rows(lookup.selected_ids(chosen)) == [(1, "m", "no info")]


TARGET = (
    "discogs_id bigint, name string, wikidata_id string, musicbrainz_id string, wikidata_links array<string>, "
    "citizenships array<string>, images array<string>, instruments array<string>, "
    "date_of_birth_calendar array<struct<time:string,calendar:string>>, other_urls array<string>"
)


def _target(spark):
    empty = []
    return spark.createDataFrame(
        [
            (1, "a", "Q1", "m1", empty, empty, empty, ["i"], None, None),
            (2, "b", None, None, empty, ["X"], empty, empty, [("t", "c")], ["u"]),
            (3, "c", None, "m3", ["w"], empty, empty, empty, None, None),
            (4, "d", "Q4", None, empty, empty, empty, empty, None, None),
        ],
        TARGET,
    )


def _selection(spark):
    return spark.createDataFrame(
        [(1, "m1", "Q9"), (2, "m2", "Q2"), (4, None, None)],
        "discogs_id bigint, musicbrainz_id string, wikidata_id string",
    )


def test_status_and_check(spark):
    log = rows(update.update_log(_target(spark), _selection(spark)), "discogs_id", "mbID_STATUS", "wkID_STATUS")
    assert log == [(1, "MATCHED", "DISTINCT"), (2, "ADDED", "ADDED"), (4, "MATCHED", "ERROR")]
    checked = update.check_updates(_target(spark), _selection(spark))
    assert rows(checked, "discogs_id", "update_status") == [(1, True), (2, True), (4, False)]
    assert update.any_changed(checked)
    assert not update.any_changed(checked.where("discogs_id = 4"))


def _sources(spark):
    kb = spark.createDataFrame(
        [("Q2", ["img"], ["wl"], ["ins"], ["AR"], [("t1", "c"), ("t2", "c")]), ("Q9", ["no"], [], [], [], None), ("Q7", ["z"], [], [], [], None)],
        "wikidata_id string, images array<string>, wikidata_links array<string>, instruments array<string>, "
        "citizenships array<string>, date_of_birth_calendar array<struct<time:string,calendar:string>>",
    )
    mb = spark.createDataFrame(
        [("m1", "UY", ["o1"]), ("m2", None, []), ("m5", "BR", [])], "musicbrainz_id string, country string, other_urls array<string>"
    )
    return kb, mb


def test_update_keeps_existing_ids_and_fills_open_lists(spark):
    got = update.update_target(_target(spark), _selection(spark), *_sources(spark))
    by_id = {r.discogs_id: r for r in got.collect()}
    assert by_id[1].wikidata_id == "Q1" and by_id[1].citizenships == ["UY"] and by_id[1].other_urls == ["o1"]
    two = by_id[2]
    assert (two.wikidata_id, two.musicbrainz_id, two.images, two.instruments) == ("Q2", "m2", ["img"], ["ins"])
    assert two.citizenships == ["X"] and len(two.date_of_birth_calendar) == 2 and two.other_urls == ["u"]
    assert by_id[3].wikidata_links == ["w"] and by_id[3].images == []
    assert by_id[4].wikidata_id == "Q4"
    assert by_id[None].wikidata_id == "Q9"  # chosen, but artist 1 kept its own id
    assert got.count() == 5


def test_update_can_prefer_the_selection(spark):
    got = update.update_target(_target(spark), _selection(spark), *_sources(spark), prefer="selected")
    assert rows(got.where("discogs_id = 1"), "wikidata_id", "images") == [("Q9", ["no"])]


def test_resolution_chain(spark):
    kb = spark.createDataFrame(
        [("Q1", 1, None, ["k"], ["im"], ["i"], ["c"], ["g"], None), ("Q2", None, "m2", [], [], [], [], [], None)],
        "wikidata_id string, discogs_id bigint, musicbrainz_id string, wikidata_links array<string>, images array<string>, "
        "instruments array<string>, citizenships array<string>, genres3 array<string>, "
        "date_of_birth_calendar array<struct<time:string,calendar:string>>",
    )
    mb = spark.createDataFrame(
        [("m1", "1", None, "AR", None, ["u1"]), ("m2", "2", "Q2", "UY", urls.KB_PROFILE + "Q2", []), ("m3", None, None, "BR", None, ["lost"])],
        "musicbrainz_id string, discogs_id string, wikidata_id string, country string, wikidata_url string, other_urls array<string>",
    )
    rolled = resolve.resolved_rollup(resolve.resolve_sources(kb, mb))
    got = {r.discogs_id: r for r in rolled.collect()}
    assert set(got) == {1, 2}
    assert (got[1].wikidata_id, got[1].musicbrainz_id, got[1].citizenships) == ("Q1", "m1", ["AR", "c"])
    assert got[1].other_urls == ["u1"] and got[1].musicbrainz_url == [urls.MB_PROFILE + "m1"]
    assert (got[2].wikidata_id, got[2].musicbrainz_id, got[2].citizenships) == ("Q2", "m2", ["UY"])
    assert got[2].wikidata_id_others is None
    primary = spark.createDataFrame(
        [(1, "A B", None, ["x"], "p", ["J"], ["Bass"]), (7, "C", None, None, None, [], [])],
        "id_artist bigint, name string, namevariations array<string>, urls array<string>, profile string, "
        "genres array<string>, roles_artist array<string>",
    )
    unified = {r.discogs_id: r for r in resolve.unify_artists(primary, rolled).collect()}
    assert unified[1].genres == ["J", "g"] and unified[1].url_discogs.endswith("/1-A-B")
    assert unified[7].wikidata_id is None and unified[7].citizenships == [] and unified[7].other_urls is None
    assert len(resolve.unify_artists(primary, rolled).columns) == 20


def test_url_columns(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (2, 99)], "id bigint, urlID bigint")
    u = spark.createDataFrame(
        [(10, urls.PRIMARY_PROFILE + "77"), (11, "http://z"), (12, urls.KB_PROFILE + "Q3")], "urlID bigint, url string"
    )
    got = rows(resolve.url_columns(links, u), "id", "discogs_id", "wikidata_id", "other_urls")
    assert got == [(1, "77", None, ["http://z"]), (2, None, "Q3", [])]


def test_hierarchy_of_a_thousand_levels_and_a_cycle(spark):
    areas = [(i, f"a{i}", 1 if i == 1000 else 3) for i in range(1001)] + [(2000 + i, f"c{i}", 3) for i in range(5)] + [(3000, "two", 3), (3001, "other", 1)]
    links = [(i, i + 1) for i in range(1000)] + [(2000 + i, 2000 + (i + 1) % 5) for i in range(5)] + [(3000, 998), (3000, 3001), (1000, 3001), (2004, 4000)]
    got = resolve.area_countries(
        spark.createDataFrame(areas, "areaID bigint, area_name string, area_type int"), spark.createDataFrame(links, "areaID bigint, area2ID bigint")
    )
    want = [(i, "a1000") for i in range(1001)] + [(3000, "a1000"), (3000, "other"), (3001, "other")]
    assert rows(got, "areaID", "country") == sorted(want, key=repr)


@pytest.mark.parametrize("most", [0, 1, 4, 1000])
def test_labels_listed_most_are_looked_up_in_place(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "LOOKED_UP", most)
    rng = random.Random(most)
    ids = lambda n: [rng.choice(["a", "a", "a", "b", "b", "c", "d", "none", None]) for _ in range(rng.randrange(n))]
    data = [(rng.choice(["k1", "k2", f"k{i}", None]), ids(4), ids(3), rng.choice([[], None, ["a"]])) for i in range(60)]
    names = [("a", "A"), ("b", "B2"), ("b", "B1"), ("c", "C"), ("d", None), ("unused", "U"), (None, "N")]
    entities = spark.createDataFrame(data, "key string, x array<string>, y array<string>, z array<string>")
    labels = spark.createDataFrame(names, "id string, label string")
    want = {}
    for key, *lists in data:
        if any(lists):
            mine = want.setdefault(key, ([], [], []))
            for i, found in enumerate(lists):
                mine[i].extend(n for x in found or [] for k, n in names if k == x and x is not None and n is not None)
    named = resolve.regroup_labels(entities, labels, "key", {"xs": "x", "ys": "y", "zs": "z"})
    got = {r.key: (r.xs, r.ys, r.zs) for r in named.collect()}
    assert got == {k: tuple(sorted(x) for x in v) for k, v in want.items()}


def test_labels_sent_to_all_tasks_are_bounded(spark, monkeypatch):
    listed = spark.createDataFrame([(n,) for n in [9, 9, 7, 7, 7, 1]], "n bigint")
    assert [resolve._least_of_most(listed, "n", most) for most in (1, 2, 4, 5, 6)] == [1 << 62, 9, 9, 7, 1]
    monkeypatch.setattr(resolve, "LOOKED_UP", 1)
    entities = spark.createDataFrame([(i, ["hot", f"id{i % 5}"]) for i in range(50)], "key int, x array<string>")
    labels = spark.createDataFrame([("hot", "H"), *((f"id{i}", f"L{i}") for i in range(5))], "id string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = resolve.regroup_labels(entities, labels, "key", {"xs": "x"})
        plan = named._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    assert named.where("size(xs) = 2 and array_contains(xs, 'H')").count() == 50
