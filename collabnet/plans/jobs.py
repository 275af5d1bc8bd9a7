"""End-to-end jobs (E1-E24): thin compositions of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collabnet import schemas
from collabnet.functions import claims, dates, urls
from collabnet.functions.arrays import or_empty
from collabnet.functions.text import display_name, spaced
from collabnet.operators import credits as cr
from collabnet.operators import graph as gr
from collabnet.operators import importcsv as ic
from collabnet.operators import lookup, pairs, pathcounts, paths, ranking, resolve, subgraph, tree
from collabnet.operators import update as up
from collabnet.operators.components import dense_components
from collabnet.session import cut_lineage, stored
from collabnet.sources import files, sinks

# ---------------------------------------------------------------- ingest


def _listed(credits: Column, role: Column | None = None) -> Column:
    """Credits of one list as (id, name, role); a missing list is empty."""

    def one(c: Column) -> Column:
        given = c.getField("role") if role is None else role
        return F.struct(c.getField("id").alias("id"), c.getField("name").alias("name"), given.alias("role"))

    empty = F.array().cast("array<struct<id:bigint,name:string,role:string>>")
    return F.coalesce(F.transform(credits, one), empty)


def release_credits(releases: DataFrame, allowed_roles: list[str] | DataFrame) -> DataFrame:
    """Release rows of the XML shape -> one row per release and credited artist.

    ``allowed_roles`` are the words a role must contain one of: a list, or a table
    such as ``credits.instrument_words`` makes.
    """
    per_track = F.coalesce(F.col("tracklist.track"), F.array())
    every = F.concat(
        _listed(F.col("artists.artist"), F.lit(cr.MAIN_ROLE)),
        _listed(F.col("extraartists.artist")),
        F.flatten(F.transform(per_track, lambda t: _listed(t.artists.artist))),
        F.flatten(F.transform(per_track, lambda t: _listed(t.extraartists.artist))),
    )
    listed = releases.select(F.col("_id").alias("id_release"), F.explode(every).alias("c")).select("id_release", "c.*")
    merged = cr.merge_credits(listed, "id_release", allowed_roles).select(
        "id_release",
        F.col("id").alias("id_artist"),
        F.col("names").alias("names_artist"),
        F.col("roles").alias("roles_artist"),
    )
    described = releases.select(
        F.col("_id").alias("id_release"),
        F.col("master_id._VALUE").alias("master_id"),
        "title",
        "released",
        "country",
        or_empty(F.col("genres.genre")).alias("genres"),
        or_empty(F.flatten(F.filter(F.col("formats.format.descriptions.description"), lambda d: d.isNotNull()))).alias(
            "formats"
        ),
        or_empty(F.col("artists.artist.id"), "bigint").alias("primary_artists"),
        or_empty(F.col("artists.artist.name")).alias("primary_artist_names"),
        or_empty(F.col("labels.label._name")).alias("labels"),
        "notes",
    )
    return described.join(merged, "id_release")


def ingest_releases(spark: SparkSession, xml: str, out: str, allowed_roles: list[str] | DataFrame) -> DataFrame:
    """Release XML -> credit table."""
    parsed = files.read_xml(spark, xml, "release", schemas.RELEASE_XML)
    sinks.write_table(release_credits(parsed, allowed_roles), out)
    return spark.read.parquet(out)


def artist_table(parsed: DataFrame) -> DataFrame:
    """Artist rows of the XML shape -> flat artist table, lists never null."""
    return parsed.select(
        F.col("id").alias("id_artist"),
        "name",
        "realname",
        or_empty(F.col("aliases.name._VALUE")).alias("aliases"),
        or_empty(F.col("namevariations.name")).alias("namevariations"),
        or_empty(F.col("groups.name._VALUE")).alias("groups"),
        or_empty(F.col("members.id"), "bigint").alias("members_id"),
        or_empty(F.col("members.name._VALUE")).alias("members_name"),
        or_empty(F.col("urls.url")).alias("urls"),
        "profile",
    )


def ingest_artists(spark: SparkSession, xml: str, out: str) -> DataFrame:
    """Artist XML -> artist table."""
    sinks.write_table(artist_table(files.read_xml(spark, xml, "artist", schemas.ARTIST_XML)), out)
    return spark.read.parquet(out)


def ingest_relational_dump(spark: SparkSession, dump: dict[str, str], out: str) -> dict[str, DataFrame]:
    """Dump files by table name -> parquet tables."""
    for name, path in dump.items():
        sinks.write_table(files.read_dump(spark, path, name), f"{out}/{name}")
    return {name: spark.read.parquet(f"{out}/{name}") for name in dump}


def entity_artists(entities: DataFrame) -> DataFrame:
    """Parsed entities -> people in music."""
    e = "e"
    return entities.where(claims.is_human(e) & claims.is_in_music(e)).select(
        F.col("e.id").alias("wikidata_id"),
        claims.first_text(e, claims.P_PRIMARY_ID).alias("discogs_id"),
        claims.first_text(e, claims.P_MB_ID).alias("musicbrainz_id"),
        claims.first_text(e, claims.P_ALLMUSIC_ID).alias("allmusic_id"),
        claims.first_text(e, claims.P_SONGKICK_ID).alias("songkick_id"),
        claims.english(e, "labels").alias("name"),
        claims.item_ids(e, claims.P_GENRE).alias("genre_ids"),
        claims.item_ids(e, claims.P_INSTRUMENT).alias("instrument_ids"),
        claims.birth_dates(e).alias("date_of_birth_calendar"),
        claims.item_ids(e, claims.P_CITIZENSHIP).alias("citizenship_ids"),
        claims.images(e).alias("images"),
        claims.site_links(e).alias("links"),
    )


def entity_labels(entities: DataFrame) -> DataFrame:
    """Parsed entities -> (id, label, description)."""
    return entities.select(
        F.col("e.id").alias("id"),
        claims.english("e", "labels").alias("label"),
        F.lower(claims.english("e", "descriptions")).alias("description"),
    )


def ingest_entities(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Entity JSON -> artist and label tables."""
    entities = files.read_entities(spark, path)
    sinks.write_table(entity_artists(entities), f"{out}/artists")
    sinks.write_table(entity_labels(entities), f"{out}/labels")
    return spark.read.parquet(f"{out}/artists"), spark.read.parquet(f"{out}/labels")


# ---------------------------------------------------------------- unify


def build_credits(credits: DataFrame, artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filtered credits joined with their solo artists, and the release table (E5)."""
    kept = cr.one_version(cr.multi_party(credits))
    solo = cr.plain_names(cr.solo_artists(artists))
    return kept.join(solo, "id_artist"), cr.releases(kept)


def build_played_with(joined: DataFrame) -> DataFrame:
    """Filtered credits -> (id_artist_out, id_artist_in, id_release), a row per pair and common release."""
    collapsed = cr.version_collapse(joined)
    return pairs.pair_events(collapsed, "id_artist", "id_release").select(
        F.col("src").alias("id_artist_out"), F.col("dst").alias("id_artist_in"), F.col("event").alias("id_release")
    )


def played_with_lists(relations: DataFrame) -> DataFrame:
    """The same with ``id_releases`` as a list, one row per pair."""
    return relations.groupBy("id_artist_out", "id_artist_in").agg(
        F.array_sort(F.collect_list("id_release")).alias("id_releases")
    )


def primary_artists(joined: DataFrame) -> DataFrame:
    """Primary-source artists with rolled-up genres and roles."""
    described = joined.select("id_artist", "name", "namevariations", "urls", "profile").distinct()
    return described.join(cr.artist_rollup(joined), "id_artist")


def unify(
    credits: DataFrame, artists: DataFrame, mb: dict[str, DataFrame], kb: DataFrame, labels: DataFrame, out: str
) -> None:
    """Three sources -> unified artists, pairs, releases and the three per-source tables."""
    spark = credits.sparkSession
    joined, releases = build_credits(credits, artists)
    joined = cut_lineage(joined)
    sinks.write_table(build_played_with(joined), f"{out}/dfArtistsRel")
    sinks.write_table(releases, f"{out}/dfReleases")
    sinks.write_table(
        primary_artists(joined).withColumn(
            "url_discogs", urls.primary_url(F.col("id_artist"), F.col("name"))
        ),
        f"{out}/tmp2/discogs",
    )
    sinks.write_table(
        resolve.mb_artists(mb["artist"], mb["area"], mb["area_area"], mb["artist_url"], mb["url"]),
        f"{out}/tmp2/musicbrainz",
    )
    sinks.write_table(resolve.kb_artists(kb, labels), f"{out}/tmp2/wikidata")
    rolled = resolve.resolved_rollup(
        resolve.resolve_sources(
            spark.read.parquet(f"{out}/tmp2/wikidata"), spark.read.parquet(f"{out}/tmp2/musicbrainz")
        )
    )
    primary = spark.read.parquet(f"{out}/tmp2/discogs")
    sinks.write_table(resolve.unify_artists(primary, rolled), f"{out}/dfArtists")


# ---------------------------------------------------------------- graph and paths


def create_graph(
    artists: DataFrame, relations: DataFrame, releases: DataFrame, relevants: DataFrame
) -> gr.Graph:
    """Unified tables -> vertices with degree, component and influence, edges with titles.

    Edges are stored; the titles, a row for every common event, are made when they are read.
    """
    long = relations.select(
        F.col("id_artist_out").alias("src"), F.col("id_artist_in").alias("dst"), F.col("id_release").alias("event")
    )
    titles = pairs.pair_titles(long, releases, "id_release", "title")
    edges = stored(titles.groupBy("src", "dst").agg(F.count("*").alias("n_common")))
    scores = gr.influence(edges, relevants)
    components = dense_components(edges)
    vertices = artists.withColumnRenamed("discogs_id", "id").join(scores, "id").join(components, "id")
    return gr.Graph(vertices, edges, titles)


def compute_paths(
    graph: gr.Graph, guests: DataFrame, relevants: DataFrame, min_common: int = 2, max_len: int | None = None
) -> DataFrame:
    """All shortest paths guest -> relevant on the filtered graph.

    Guests on the filtered graph without any path, or with a given ``max_len`` none
    of that many edges at most, are added with key -1.
    """
    links = gr.undirected(graph.edges, min_common)
    known = gr.prune_vertices(graph.vertices.select("id"), graph.edges.where(pairs.at_least(min_common)))
    found = paths.all_shortest_paths(
        links, guests.join(known, "id", "left_semi"), relevants.join(known, "id", "left_semi"), max_len
    )
    return found.unionByName(paths.guests_without_path(guests, links, found), allowMissingColumns=True)


def path_sizes(graph: gr.Graph, guests: DataFrame, relevants: DataFrame, more_than: int = 1) -> DataFrame:
    """Distances guest -> relevant over edges with more than ``more_than`` common events."""
    links = gr.undirected(graph.edges, more_than + 1)
    return paths.distance_lists(paths.landmark_distances(links, relevants), guests, relevants)


def separation_lists(sizes: DataFrame) -> DataFrame:
    """Per guest the list of (relevant, distance) (A11); as long as the list of relevants."""
    one = F.struct(F.col("relevant_name").alias("name_relevant"), F.col("distance").alias("distancia"))
    return sizes.groupBy("guest", "guest_name").agg(
        F.array_sort(F.collect_list(one)).alias("grado_de_separacion")
    )


def rank_paths(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """Paths -> ranked paths; rows of guests without path drop out."""
    return ranking.rank_paths(found.where(F.col("relevant").isNotNull()), vertices)


def best_paths(
    graph: gr.Graph, guests: DataFrame, relevants: DataFrame, max_rank: int, min_common: int = 2, rank: str = "rank_cii"
) -> DataFrame:
    """The paths of rank up to ``max_rank``, straight from the graph (E11 and E13 in one).

    ``rank`` is rank_ci, rank_cii or rank_cb and names the rank's column. Only these
    paths are spelled out, so a graph with very many shortest paths is ranked, too.
    """
    links = gr.undirected(graph.edges, min_common)
    known = gr.prune_vertices(graph.vertices.select("id"), graph.edges.where(pairs.at_least(min_common)))
    dag = paths.shortest_path_dag(links, guests.join(known, "id", "left_semi"), relevants.join(known, "id", "left_semi"))
    if rank == "rank_cb":
        best = pathcounts.best_paths(dag, pathcounts.paths_through(dag).withColumnRenamed("n_paths", "value"), max_rank, per_pair=True, bare=0)
    else:
        value = F.col(rank.removeprefix("rank_")).alias("value")
        best = pathcounts.best_paths(dag, graph.vertices.select("id", value), max_rank)
    return best.paths().withColumnRenamed("rank", rank)


# ---------------------------------------------------------------- exports


def export_ids(ranked: DataFrame, graph: gr.Graph, max_rank: int, out: str, label: str) -> None:
    """Vertex and release id lists of the best paths."""
    sinks.write_rows(ranking.selected_vertex_ids(ranked, max_rank), f"{out}/vertices_id_list_{label}", "json")
    sinks.write_rows(
        ranking.selected_release_ids(ranked, max_rank, graph.titles), f"{out}/edges_id_list_{label}", "json"
    )


def profile_columns() -> list[Column]:
    """Links and birth data of a vertex."""
    known = urls.all_urls(F.col("urls"), F.col("wikidata_links"), F.col("other_urls"))
    shown = display_name(F.col("name"))
    return [
        urls.profile_url(urls.MB_PROFILE, F.col("musicbrainz_id")).alias("mbLink"),
        urls.profile_url(urls.KB_PROFILE, F.col("wikidata_id")).alias("wikiLink"),
        urls.best_encyclopedia_url(known).alias("wikipediaUrl"),
        *[urls.best_host_url(known, host).alias(name) for name, host in urls.PROFILE_HOSTS.items()],
        urls.home_page(shown, known).alias("homePageUrl"),
        dates.birth_time(F.col("date_of_birth_calendar")).alias("dateOfBirthStr"),
        dates.parse_time(dates.birth_time(F.col("date_of_birth_calendar"))).alias("dateOfBirth"),
        dates.birth_year(F.col("date_of_birth_calendar")).alias("yearOfBirth"),
    ]


@dataclass(frozen=True)
class GraphRows:
    """Rows of one or many exported graphs.

    ``nodes`` and ``links`` are one row each; ``link_titles`` has a row per link
    and release, ``rank_links`` a row per node and linked node with the best rank
    of a path through both.
    """

    nodes: DataFrame
    links: DataFrame
    link_titles: DataFrame
    rank_links: DataFrame

    def write(self, path: str, groups: list[str]) -> None:
        for name, rows in vars(self).items():
            sinks.write_groups(rows, f"{path}/{name}", groups)


LINK = ["source", "target"]


def graph_rows(
    ranked: DataFrame,
    graph: gr.Graph,
    guests: DataFrame,
    relevants: DataFrame,
    max_rank: int,
    rank: str = "rank_cii",
    groups: list[str] = (),
    centralities: bool = True,
    profiles: bool = False,
) -> GraphRows:
    """The graphs spanned by the best paths.

    ``groups``: none for one graph, ``["guest"]`` or ``["relevant"]`` for one each.
    """
    groups = list(groups)
    key = groups + ["id"]
    best = cut_lineage(subgraph.select_paths(ranked, rank, max_rank))
    rows = cut_lineage(subgraph.edge_rows(best, graph.edges, groups))
    rolled = subgraph.vertex_rows(best, guests, relevants, groups)
    if centralities:
        ends = cut_lineage(rolled.select(*key))
        rolled = (
            rolled.join(subgraph.subgraph_degree(rows, groups), key)
            .join(subgraph.path_load(best, groups), key)
            .join(subgraph.closeness(rows, ends, groups), key)
        )
    described = graph.vertices.select(
        "id",
        (display_name(F.col("name")) if profiles else F.col("name")).alias("name"),
        F.col("degree").alias("degree_origin"),
        "ci",
        "cii",
        "citizenships",
        "instruments",
        *(profile_columns() + [F.col("profile")] if profiles else profile_columns()[:2]),
    )
    nodes = cut_lineage(subgraph.indexed_nodes(rolled.join(described, "id"), groups))
    first = groups + ["index", "id"]
    nodes = nodes.select(*first, *[c for c in nodes.columns if c not in first])

    linked = subgraph.indexed_rank_links(subgraph.rank_links(best, groups), nodes, groups)
    # a guest's graph has a scale of its own, the graphs of the relevants share one
    weighed = subgraph.relative_weight(rows, [g for g in groups if g == "guest"])
    links = cut_lineage(subgraph.indexed_links(weighed, nodes, groups))
    number = guests.select(F.col("id").alias("guest"), F.col("ordinal").alias("path_id"))
    shown = links.join(number, "guest", "left").select(
        *dict.fromkeys([*groups, *LINK, "weight", "n_common", "path_id", "guest"]), F.col("rank").alias(rank)
    )
    used = links.select(*groups, *LINK, "src", "dst").distinct()
    titles = subgraph.with_edge_columns(used, graph.titles).select(
        *groups, *LINK, F.col("event").alias("id_release"), "title", urls.image_file(F.col("event")).alias("image")
    )
    return GraphRows(nodes, shown, titles, linked)


def export_graph(ranked, graph, guests, relevants, max_rank: int, out: str, label: str) -> None:
    """Node/link graph for both rankings (E15), as row files."""
    for rank, name in (("rank_ci", f"ED{label}_RANKCI"), ("rank_cii", f"ED{label}_RANKCII")):
        graph_rows(ranked, graph, guests, relevants, max_rank, rank).write(f"{out}/{name}", [])


def release_details(links: DataFrame, releases: DataFrame, keys: list[str]) -> DataFrame:
    """Long link rows with the details of each release (J20): keys plus one release per row."""
    return links.join(
        releases.select(
            "id_release", "title", urls.image_file(F.col("id_release")).alias("image"), "released", "country",
            "genres", "labels", "notes", "primary_artists", "primary_artist_names",
        ),
        "id_release",
    ).select(
        *keys, "id_release", "title", "image", "released", "country", "genres", "labels", "notes",
        "primary_artists", "primary_artist_names",
    )


def export_graph_by_guest(ranked, graph, guests, relevants, releases, max_rank: int, out: str, label: str) -> None:
    """One graph per guest with release details and profiles (E16), all guests in one job."""
    base = f"{out}/ED{label}_RANKCII_by_guest"
    rows = graph_rows(ranked, graph, guests, relevants, max_rank, "rank_cii", ["guest"], profiles=True)
    rows.write(base, ["guest"])
    keys = ["guest", *LINK]
    detailed = release_details(rows.link_titles.select(*keys, "id_release"), releases, keys)
    sinks.write_groups(detailed, f"{base}/releases", ["guest"])


def export_graph_by_relevant(ranked, graph, guests, relevants, max_rank: int, out: str, label: str) -> None:
    """One graph per relevant and the selector list."""
    selector = relevants.select(
        F.lit(label).alias("year"), F.col("ordinal").alias("path_rel_id"), spaced(F.col("name")).alias("name"), "id"
    )
    sinks.write_rows(selector, f"{out}/relevant_selector", "json")
    for rank in ("rank_ci", "rank_cii"):
        rows = graph_rows(
            ranked, graph, guests, relevants, max_rank, rank, ["relevant"], centralities=False
        )
        rows.write(f"{out}/ED{label}_BY_RELEVANT_{rank}", ["relevant"])


def tree_attributes(vertices: DataFrame) -> DataFrame:
    """(id, json): the JSON object of a tree node without its children."""
    return vertices.select(
        "id",
        F.to_json(
            F.struct(
                "name",
                urls.image_file(F.col("id")).alias("image"),
                F.col("id").alias("discogs_id"),
                *profile_columns(),
                "citizenships",
                "instruments",
                "profile",
            )
        ).alias("json"),
    )


def tree_nodes(ranked: DataFrame, vertices: DataFrame) -> DataFrame:
    """Nodes of the trees of the best paths of every pair, numbered in document order, with their attributes."""
    nodes = cut_lineage(tree.tree_order(tree.tree_rows(subgraph.select_paths(ranked, "rank_cii", 1))))
    used = vertices.join(nodes.select("id").distinct(), "id", "left_semi")
    return nodes.join(tree_attributes(used), "id").select(*nodes.columns, "json")


def export_tree(ranked: DataFrame, graph: gr.Graph, releases: DataFrame, out: str, label: str) -> None:
    """Trees of the best paths of every pair as JSON lines in document order, and the link file.

    A line has the node's number, its parent's, its depth and its attributes; a reader
    that nests the lines as they come has each guest's document.
    """
    best = cut_lineage(subgraph.select_paths(ranked, "rank_cii", 1))
    sinks.write_rows(tree.in_document_order(tree_nodes(best, graph.vertices)), f"{out}/tree_graph_{label}", "json")
    used = paths.path_edges(best).select("src", "dst").distinct()
    long = subgraph.with_edge_columns(used, graph.titles.select("src", "dst", F.col("event").alias("id_release")))
    sinks.write_rows(release_details(long, releases, ["src", "dst"]), f"{out}/tree_graph_links_{label}", "json")


# ---------------------------------------------------------------- search and update


def search_artists(artists: DataFrame, source: str, terms: list[str] | DataFrame, literal: bool = False) -> DataFrame:
    """Candidates of one source for every term (E19); ``source`` is primary, mb or kb."""
    if source == "primary":
        found = lookup.search_names(artists, terms, "name", literal)
        return found.select("name", "url_discogs", F.col("id_artist").alias("discogs_id"), "search_name")
    if source == "mb":
        found = lookup.search_names(artists, terms, "artist_name", literal)
        url = urls.profile_url(urls.MB_PROFILE, F.col("musicbrainz_id")).alias("musicbrainz_url")
        return found.select("artist_name", url, "musicbrainz_id", "search_name")
    found = lookup.search_names(artists, terms, "name", literal)
    url = urls.profile_url(urls.KB_PROFILE, F.col("wikidata_id")).alias("wikidata_url")
    return found.select("name", url, "wikidata_id", "search_name")


def write_candidates(candidates: DataFrame, out: str) -> None:
    """Candidates as CSV, one directory per term, in one write (K5)."""
    candidates.write.mode("overwrite").partitionBy("search_name").csv(out, header=True)


def selection_to_guests(selection: DataFrame, candidates: DataFrame, out: str) -> None:
    """Guest CSV and the selected-id table for the update."""
    sinks.write_rows(lookup.selection_to_guests(selection, candidates), f"{out}/guests", "csv")
    tabbed = lookup.selected_ids(selection).select(
        F.concat_ws("\t", F.col("discogs_id").cast("string"), "musicbrainz_id", "wikidata_id").alias("value")
    )
    sinks.write_rows(tabbed, f"{out}/artists", "text")


def check_updates(target: DataFrame, selection: DataFrame, out: str) -> bool:
    """Status CSV; returns whether any selected artist needs an update."""
    checked = cut_lineage(up.check_updates(target, selection))
    sinks.write_rows(checked, f"{out}/update_status", "csv")
    return up.any_changed(checked)


def update_target(
    target: DataFrame, selection: DataFrame, kb: DataFrame, mb: DataFrame, out: str, prefer: str = "existing"
) -> None:
    """Updated table, log and id register (E22). ``out`` must not be where ``target`` is read from."""
    sinks.write_table(up.update_target(target, selection, kb, mb, prefer), f"{out}/dfArtists")
    sinks.write_rows(up.update_log(target, selection), f"{out}/log/log", "csv")
    sinks.write_rows(up.id_register(selection), f"{out}/ids/artists", "csv")


# ---------------------------------------------------------------- converters


def import_releases(releases: DataFrame) -> DataFrame:
    """Release rows of the XML shape -> the flat rows the graph-import CSVs start from."""
    return releases.select(
        F.col("_id").alias("discogs_id"),
        "title",
        "released",
        "country",
        F.col("artists.artist.name").alias("artists_names"),
        F.col("extraartists.artist.name").alias("extras_names"),
        F.col("extraartists.artist.id").alias("extras_ids"),
        F.col("extraartists.artist.role").alias("extras_roles"),
    )


def collab_csv(releases: DataFrame, artists: DataFrame, out: str) -> None:
    """Both graph models as import CSVs."""
    main, collaborators = ic.main_artists(releases, artists), ic.collaborations(releases)
    sinks.import_csv(ic.artist_model_nodes(main, collaborators), f"{out}/model1/artists")
    sinks.import_csv(ic.played_with_relations(main, collaborators), f"{out}/model1/relations")
    sinks.import_csv(ic.artist_nodes(main), f"{out}/model2/artists")
    sinks.import_csv(ic.release_nodes(releases), f"{out}/model2/releases")
    sinks.import_csv(ic.performed_in(main), f"{out}/model2/relationships_main")
    sinks.import_csv(ic.collaborator_nodes(collaborators), f"{out}/model2/collaborators")
    sinks.import_csv(ic.credited_in(collaborators), f"{out}/model2/relationships_collab")


def nquads_to_parquet(spark: SparkSession, statements: str, types: str, out: str) -> None:
    """N-quad files -> parquet."""
    sinks.write_table(files.read_quads(spark, statements), f"{out}/statements")
    sinks.write_table(files.read_entity_types(spark, types), f"{out}/types")


def xml_to_parquet(spark: SparkSession, xml: str, row_tag: str, out: str) -> None:
    """Any XML file -> parquet."""
    sinks.write_table(files.infer_xml(spark, xml, row_tag), out)


