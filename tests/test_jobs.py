"""The whole chain on hand-written files: ingest, unify, graph, paths, ranking, exports, search, update."""

import json
from pathlib import Path

import pytest
from helpers import rows
from pyspark.sql import functions as F

from collabnet.functions import urls
from collabnet.operators import importcsv as ic
from collabnet.operators import pairs as pr
from collabnet.plans import jobs
from collabnet.sources import files, sinks
from collabnet import schemas

ROLES = ["guitar", "bass", "drum", "performer"]


def _credit(i, name, role=""):
    return f"<artist><id>{i}</id><name>{name}</name><role>{role}</role></artist>"


def _release(i, main, extra=(), tracks=(), master=None, title=None, fmt="LP"):
    parts = [f'<release id="{i}" status="A">']
    if master:
        parts.append(f'<master_id is_main_release="true">{master}</master_id>')
    parts.append(f"<title>{title or f'T{i}'}</title><released>1990-0{i % 9 + 1}-00</released><country>AR</country>")
    parts.append("<genres><genre>Jazz</genre></genres>")
    parts.append(f"<formats><format><descriptions><description>{fmt}</description></descriptions></format></formats>")
    parts.append('<labels><label name="L"/></labels><notes>line one\nline two</notes>')
    parts.append("<artists>" + "".join(_credit(*c) for c in main) + "</artists>")
    parts.append("<extraartists>" + "".join(_credit(*c) for c in extra) + "</extraartists>")
    inner = "".join(f"<track><extraartists>{_credit(*c)}</extraartists></track>" for c in tracks)
    parts.append(f"<tracklist>{inner}</tracklist></release>")
    return "".join(parts)


NAMES = {1: "Ana Bo", 2: "Cy Do", 3: "Ed Fu", 4: "Gil Ho", 5: "Ian Jo", 6: "The Band", 7: "Bad.Name"}


def _files(base: Path):
    a = {i: (i, n) for i, n in NAMES.items()}
    releases = [
        _release(1, [a[1], a[2]]),
        _release(2, [a[1], a[2]]),
        _release(3, [a[2]], [(3, "Ed Fu", "Guitar, Producer")], master=50),
        _release(4, [a[2]], [(3, "Ed Fu", "Bass")], tracks=[(4, "Gil Ho", "Drums")]),
        _release(5, [a[3]], tracks=[(4, "Gil Ho", "Drums")]),
        _release(6, [a[3]], tracks=[(4, "Gil Ho", "Drums"), (2, "Cy Do", "Mixed By")]),
        _release(7, [a[5]]),
        _release(8, [a[1], a[5]], fmt="Compilation"),
        _release(9, [a[6], a[1]]),
        _release(10, [a[7], a[1]]),
    ]
    base.joinpath("releases.xml").write_text("<releases>\n" + "\n".join(releases) + "\n</releases>\n")
    artists = []
    for i, name in NAMES.items():
        members = "<members><id>1</id><name id='1'>Ana Bo</name><id>2</id><name id='2'>Cy Do</name></members>" if i == 6 else ""
        site = f"<urls><url>http://www.{name.split()[-1].lower()}.com</url></urls>" if i < 3 else ""
        artists.append(f"<artist><id>{i}</id><name>{name}</name><realname/>{members}{site}<profile>P{i}</profile></artist>")
    base.joinpath("artists.xml").write_text("<artists>\n" + "\n".join(artists) + "</artists>")

    def tsv(name, lines):
        base.joinpath(name).write_text("".join("\t".join(x) + "\n" for x in lines))

    null = "\\N"

    def mb(i, gid, name, kind, area):
        return [i, gid, name, name] + [null] * 6 + [kind, area]

    tsv("artist", [mb("1", "g1", "Ana Bo", "1", "11"), mb("2", "g2", 'Cy "Do', "1", null), mb("3", "g3", "Grp", "2", "11")])
    tsv("area", [["1", "x", "Argentina", "1"], ["11", "x", "Cordoba", "3"], ["12", "x", "Nowhere", null]])
    tsv("l_area_area", [["9", "9", "1", "11"]])
    tsv("url", [["5", "x", urls.PRIMARY_PROFILE + "1"], ["6", "x", urls.KB_PROFILE + "Q1"], ["7", "x", "http://ana.example/"]])
    tsv("l_artist_url", [["0", "0", "1", "5"], ["0", "0", "1", "6"], ["0", "0", "1", "7"]])

    def claim(value):
        return [{"mainsnak": {"datavalue": {"value": value}}}]

    def entity(q, name, human=True, **more):
        claims = {"P31": claim({"id": "Q5" if human else "Q6"}), "P106": claim({"id": "Q100"})} | more
        return {"id": q, "labels": {"en": {"value": name}}, "descriptions": {}, "claims": claims, "sitelinks": {}}

    entities = [
        entity("Q1", "Ana Bo", P136=claim({"id": "Q50"}), P27=claim({"id": "Q51"}),
               P569=claim({"time": "+1961-10-20T00:00:00Z", "calendarmodel": "http://x/Q1985727"})),
        entity("Q2", "Cy Do", P1953=claim("2"), P434=claim("g2"), P1303=claim({"id": "Q52"})),
        entity("Q50", "jazz", human=False),
        entity("Q51", "Argentina", human=False),
        entity("Q52", "Piano", human=False),
        {"id": "Q99", "labels": [], "claims": [], "sitelinks": []},
    ]
    lines = ",\n".join(json.dumps(e) for e in entities)
    base.joinpath("entities.json").write_text(f"[\n{lines}\n]\n")
    base.joinpath("guests.csv").write_text("id,name\n4,Gil_Ho\n1,Ana_Bo\n5,Ian_Jo\n")
    base.joinpath("relevants.csv").write_text('id,name,category\n1,"Ana_Bo",1\n2,"Cy_Do",2\n')
    base.joinpath("selection.tsv").write_text("4\tno info\tQ9\n1\tg1\tQ1\n")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("world")
    _files(base)
    at = lambda name: str(base / name)
    credits = jobs.ingest_releases(spark, at("releases.xml"), at("credits"), ROLES)
    artists = jobs.ingest_artists(spark, at("artists.xml"), at("artists"))
    mb = jobs.ingest_relational_dump(
        spark,
        {"artist": at("artist"), "area": at("area"), "area_area": at("l_area_area"), "url": at("url"), "artist_url": at("l_artist_url")},
        at("mb"),
    )
    kb, labels = jobs.ingest_entities(spark, at("entities.json"), at("kb"))
    jobs.unify(credits, artists, mb, kb, labels, at("final"))
    guests, relevants = files.read_guests(spark, at("guests.csv")), files.read_relevants(spark, at("relevants.csv"))
    unified = spark.read.parquet(at("final/dfArtists"))
    graph = jobs.create_graph(
        unified, spark.read.parquet(at("final/dfArtistsRel")), spark.read.parquet(at("final/dfReleases")), relevants
    )
    sinks.write_graph(graph, at("graph"))
    found = jobs.compute_paths(graph, guests, relevants, min_common=2)
    sinks.write_paths(found, at("paths"))
    ranked = jobs.rank_paths(files.read_ranked(spark, at("paths")), graph.vertices)
    sinks.write_paths(ranked, at("ranked"))
    return {
        "at": at, "credits": credits, "artists": artists, "mb": mb, "kb": kb, "labels": labels, "guests": guests,
        "relevants": relevants, "unified": unified, "graph": graph, "paths": found,
        "ranked": files.read_ranked(spark, at("ranked")),
        "releases": spark.read.parquet(at("final/dfReleases")),
        "relations": spark.read.parquet(at("final/dfArtistsRel")),
    }


def test_credits(world):
    got = rows(world["credits"], "id_release", "id_artist", "roles_artist")
    assert (3, 3, ["Guitar"]) in got and (1, 1, ["Release Performer"]) in got
    assert not any(r == 6 and a == 2 for r, a, _ in got)  # mixed by
    row = world["credits"].where("id_release = 3 and id_artist = 2").first()
    assert (row.master_id, row.title, row.genres, row.formats, row.labels) == (50, "T3", ["Jazz"], ["LP"], ["L"])
    assert row.primary_artists == [2] and row.notes == "line one\nline two"


def test_artist_and_dump_tables(world):
    assert rows(world["artists"].where("size(members_name) > 0"), "id_artist", "members_name") == [(6, ["Ana Bo", "Cy Do"])]
    assert rows(world["artists"].where("id_artist = 1"), "urls", "aliases") == [(["http://www.bo.com"], [])]
    assert rows(world["mb"]["artist"], "id", "artist_name", "areaID") == [(1, "Ana Bo", 11), (2, 'Cy "Do', None)]
    assert rows(world["mb"]["area"], "areaID", "area_type") == [(1, 1), (11, 3), (12, None)]


def test_entities(world):
    assert rows(world["kb"], "wikidata_id", "discogs_id", "musicbrainz_id") == [("Q1", None, None), ("Q2", "2", "g2")]
    assert world["labels"].count() == 6


def test_unified(world):
    got = {r.discogs_id: r for r in world["unified"].collect()}
    assert 6 not in got and 7 not in got
    assert (got[1].wikidata_id, got[1].musicbrainz_id) == ("Q1", "g1")
    assert got[1].citizenships == ["Argentina"] and got[1].other_urls == ["http://ana.example/"]
    assert (got[2].wikidata_id, got[2].instruments) == ("Q2", ["Piano"])
    assert got[1].profile == "P1" and got[4].roles == ["Drums"]


def test_graph(world):
    edges = {(r.src, r.dst): [x.id_release for x in r.id_title_list] for r in pr.title_lists(world["graph"].titles).collect()}
    assert edges[1, 2] == [1, 2] and edges[3, 4] == [4, 5, 6] and edges[2, 3] == [3, 4] and edges[2, 4] == [4]
    assert {(r.src, r.dst): r.n_common for r in world["graph"].edges.collect()} == {k: len(v) for k, v in edges.items()}
    lists = jobs.played_with_lists(world["relations"])
    assert {(r.id_artist_out, r.id_artist_in): r.id_releases for r in lists.collect()} == edges
    vertices = {r.id: r for r in world["graph"].vertices.collect()}
    assert {v.component for v in vertices.values()} == {1}
    assert vertices[2].degree == 3


def test_paths(world):
    got = {(r.guest, r.relevant): (r.key, r.vertices) for r in world["paths"].collect()}
    assert got[4, 1] == (2, [4, 3, 2, 1]) and got[4, 2] == (1, [4, 3, 2])
    assert got[1, 1] == (0, [1, 1]) and got[1, 2] == (0, [1, 2])
    assert (5, None) not in got  # not on the filtered graph
    sizes = jobs.path_sizes(world["graph"], world["guests"], world["relevants"])
    assert rows(sizes, "guest", "relevant_name", "distance") == [
        (1, "Ana Bo", 0), (1, "Cy Do", 1), (4, "Ana Bo", 3), (4, "Cy Do", 2),
    ]
    lists = {r.guest: len(r.grado_de_separacion) for r in jobs.separation_lists(sizes).collect()}
    assert lists == {1: 2, 4: 2}


def test_ranked(world):
    assert world["ranked"].count() == 4
    assert set(world["ranked"].columns) >= {"path_count", "cb", "sum_CI", "sum_CII", "rank_cb", "rank_ci", "rank_cii"}


def _json_lines(path):
    return [json.loads(x) for f in sorted(Path(path).rglob("part-*")) for x in f.read_text().splitlines()]


def test_exports(world):
    at, w = world["at"], world
    jobs.export_ids(w["ranked"], w["graph"], 1, at("ids"), "2019")
    assert sorted(x["id"] for x in _json_lines(at("ids/vertices_id_list_2019"))) == [1, 2, 3, 4]
    assert sorted(x["id"] for x in _json_lines(at("ids/edges_id_list_2019"))) == [1, 2, 3, 4, 5, 6]

    jobs.export_graph(w["ranked"], w["graph"], w["guests"], w["relevants"], 2, at("graphs"), "2019")
    base = at("graphs/ED2019_RANKCII")
    nodes = sorted(_json_lines(f"{base}/nodes"), key=lambda n: n["index"])
    assert [n["index"] for n in nodes] == [0, 1, 2, 3]
    assert {n["id"]: n["class"] for n in nodes} == {1: "guest", 2: "relevant", 3: "other", 4: "guest"}
    assert max(x["weight"] for x in _json_lines(f"{base}/links")) == 1.0
    assert {x["title"] for x in _json_lines(f"{base}/link_titles")} == {"T1", "T2", "T3", "T4", "T5", "T6"}
    one = next(n for n in nodes if n["id"] == 1)
    assert one["mbLink"] == urls.MB_PROFILE + "g1" and one["cc"] > 0 and one["bc"] > 0
    assert any(x["id"] == 1 and x["rank"] == 1 for x in _json_lines(f"{base}/rank_links"))

    jobs.export_graph_by_guest(w["ranked"], w["graph"], w["guests"], w["relevants"], w["releases"], 2, at("by_guest"), "2019")
    nodes = _json_lines(at("by_guest/ED2019_RANKCII_by_guest/nodes/guest=4"))
    assert sorted(n["id"] for n in nodes) == [1, 2, 3, 4]
    born = next(n for n in nodes if n["id"] == 1)
    assert born["yearOfBirth"] == 1961 and born["homePageUrl"] == "http://www.bo.com"
    links = _json_lines(at("by_guest/ED2019_RANKCII_by_guest/releases/guest=4"))
    assert {x["title"] for x in links} >= {"T1", "T2", "T3", "T4"} and all(x["country"] == "AR" for x in links)

    jobs.export_graph_by_relevant(w["ranked"], w["graph"], w["guests"], w["relevants"], 2, at("by_rel"), "2019")
    assert len(_json_lines(at("by_rel/relevant_selector"))) == 2
    two = _json_lines(at("by_rel/ED2019_BY_RELEVANT_rank_cii/nodes/relevant=2"))
    assert sorted(n["id"] for n in two) == [1, 2, 3, 4]
    assert len(_json_lines(at("by_rel/ED2019_BY_RELEVANT_rank_cii/links/relevant=2"))) == 3

    jobs.export_tree(w["ranked"], w["graph"], w["releases"], at("tree"), "2019")
    lines = _json_lines(at("tree/tree_graph_2019"))
    assert [(x["guest"], x["preorder"]) for x in lines] == sorted((x["guest"], x["preorder"]) for x in lines)
    four = [(x["pos"], json.loads(x["json"])["discogs_id"]) for x in lines if x["guest"] == 4]
    assert four == [(0, 4), (1, 3), (2, 2), (3, 1), (2, 2)] or four == [(0, 4), (1, 3), (2, 2), (2, 2), (3, 1)]
    assert {x["id_release"] for x in _json_lines(at("tree/tree_graph_links_2019"))} == {1, 2, 3, 4, 5, 6}


def test_best_paths_straight_from_the_graph(world):
    for rank in ("rank_ci", "rank_cii", "rank_cb"):
        got = jobs.best_paths(world["graph"], world["guests"], world["relevants"], 1, rank=rank)
        want = world["ranked"].where(F.col(rank) <= 1)
        assert rows(got, "guest", "relevant", "key", "vertices") == rows(want, "guest", "relevant", "key", "vertices")


def test_groups_are_written_as_few_files(spark, tmp_path):
    """A directory per group, not a file per task and group."""
    rows_ = spark.range(0, 4000, 1, 16).select((F.col("id") % 20).alias("guest"), F.col("id").alias("x"))
    sinks.write_groups(rows_, str(tmp_path / "groups"), ["guest"])
    files_ = [p.parent.name for p in (tmp_path / "groups").rglob("part-*.json")]
    assert len(files_) == len(set(files_)) == 20
    sinks.write_paths(rows_.withColumnRenamed("guest", "key"), str(tmp_path / "paths"))
    assert len(list((tmp_path / "paths").rglob("part-*.parquet"))) == 20
    assert spark.read.json(str(tmp_path / "groups")).count() == 4000
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        one = spark.range(0, 20000, 1, 16).select(F.lit(1).alias("guest"), F.xxhash64("id").alias("x"))
        sinks.write_groups(one, str(tmp_path / "hot"), ["guest"])  # a large group is split
        assert len(list((tmp_path / "hot").rglob("part-*.json"))) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_search_select_update(world, spark):
    at = world["at"]
    dg = spark.read.parquet(at("final/tmp2/discogs"))
    found = jobs.search_artists(dg, "primary", ["ana_bo", "ho"])
    assert rows(found, "discogs_id", "search_name") == [(1, "ana bo"), (4, "ho")]
    jobs.write_candidates(found, at("found"))
    assert Path(at("found/search_name=ho")).exists()
    mb = spark.read.parquet(at("final/tmp2/musicbrainz"))
    assert rows(jobs.search_artists(mb, "mb", ["ana"]), "musicbrainz_url") == [(urls.MB_PROFILE + "g1",)]
    kb = spark.read.parquet(at("final/tmp2/wikidata"))
    assert rows(jobs.search_artists(kb, "kb", ["cy"]), "wikidata_url") == [(urls.KB_PROFILE + "Q2",)]

    selection = files.read_selection(spark, at("selection.tsv"))
    assert rows(selection) == [(1, "g1", "Q1"), (4, None, "Q9")]
    jobs.selection_to_guests(selection, found, at("chosen"))
    assert rows(spark.read.csv(at("chosen/guests"), header=True)) == [("1", "Ana_Bo"), ("4", "Gil_Ho")]
    assert ("4\tno info\tQ9",) in rows(spark.read.text(at("chosen/artists")))
    assert jobs.check_updates(world["unified"], selection, at("status"))
    jobs.update_target(world["unified"], selection, kb, mb, at("updated"))
    after = {r.discogs_id: r.wikidata_id for r in spark.read.parquet(at("updated/dfArtists")).collect()}
    assert after[4] == "Q9" and after[1] == "Q1" and len(after) == world["unified"].count()
    assert "ADDED" in [r.wkID_STATUS for r in spark.read.csv(at("updated/log/log"), header=True).collect()]


def test_import_csv(world, spark):
    at = world["at"]
    flat = jobs.import_releases(files.read_xml(spark, at("releases.xml"), "release", schemas.RELEASE_XML))
    known = world["artists"].select(F.col("id_artist").alias("id"), "name")
    main, colabs = ic.main_artists(flat, known), ic.collaborations(flat)
    rels = rows(ic.played_with_relations(main, colabs), ic.START_ARTIST, ic.END_ARTIST, "role", "title")
    assert rels == [(3, 2, "Bass", "T4"), (3, 2, "Guitar, Producer", "T3")]
    assert (3, "ed fu") in rows(ic.artist_model_nodes(main, colabs))
    jobs.collab_csv(flat, known, at("import"))
    text = "".join(p.read_text() for p in Path(at("import/model2/collaborators")).glob("part-*"))
    assert "collabId:ID(Collaborator)" in text


def test_converters(spark, tmp_path):
    quads = tmp_path / "map.tql"
    quads.write_text("<a> <b> <c> <d> .\n  <a>  <b> <c> <d> . \n\n# x\n<a> <b> <c2> <d> .\n<broken>\n")
    types = tmp_path / "type.tql"
    types.write_text("<e> <is> <http://x/y/Artist> <c> .\n<e> <is> <http://x/y/Artist> <c> .\n")
    jobs.nquads_to_parquet(spark, str(quads), str(types), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/statements"))) == [("a", "b", "c", "d"), ("a", "b", "c2", "d")]
    assert rows(spark.read.parquet(str(tmp_path / "out/types"))) == [("<e>", "Artist")]
    xml = tmp_path / "x.xml"
    xml.write_text("<r><item id='1'><n>a</n></item><item id='2'><n>b</n></item></r>")
    jobs.xml_to_parquet(spark, str(xml), "item", str(tmp_path / "xml"))
    assert rows(spark.read.parquet(str(tmp_path / "xml")), "_id", "n") == [(1, "a"), (2, "b")]


def test_people_files_keep_their_order(world):
    assert rows(world["guests"], "ordinal", "id") == [(1, 4), (2, 1), (3, 5)]
    assert rows(world["relevants"], "ordinal", "id", "category") == [(0, 1, 1), (1, 2, 2)]
