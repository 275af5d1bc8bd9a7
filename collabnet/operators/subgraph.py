"""The subgraph spanned by selected paths: edges, vertices, centralities.

All functions take ``groups``: no column for one graph of all paths, ``["guest"]``
or ``["relevant"]`` for one graph per guest or per relevant. All graphs are made
in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.functions.urls import image_file
from collabnet.operators.graph import both_ways
from collabnet.operators.index import dense_index
from collabnet.operators.paths import path_edges, path_steps, summed_distances


def select_paths(ranked: DataFrame, rank: str, max_rank: int) -> DataFrame:
    """Paths of rank up to ``max_rank`` with that rank as column ``rank``."""
    return ranked.where(F.col(rank) <= max_rank).withColumn("rank", F.col(rank))


def edge_rows(paths: DataFrame, edges: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Distinct (groups, src, dst, rank, guest) over the path edges, with the edge's columns.

    ``edges`` is canonical (src < dst); its other columns are attached.
    """
    keys = list(dict.fromkeys([*groups, "src", "dst", "rank", "guest"]))
    steps = path_edges(paths).join(paths.select("path_id", "rank"), "path_id").select(*keys).distinct()
    return with_edge_columns(steps, edges)


def with_edge_columns(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Join rows with (src, dst) in any direction to canonical edge rows (src < dst)."""
    info = edges.withColumnRenamed("src", "_lo").withColumnRenamed("dst", "_hi")
    return (
        steps.withColumn("_lo", F.least("src", "dst"))
        .withColumn("_hi", F.greatest("src", "dst"))
        .join(info, ["_lo", "_hi"])
        .drop("_lo", "_hi")
    )


def relative_weight(rows: DataFrame, groups: list[str] = (), n: str = "n_common") -> DataFrame:
    """Add ``weight``: common events over the largest number of the row's group, as float."""
    groups = list(groups)
    if not groups:
        top = rows.agg(F.max(n)).scalar()
        return rows.withColumn("weight", (F.col(n) / top).cast("float"))
    tops = rows.groupBy(*groups).agg(F.max(n).alias("_top"))
    return rows.join(tops, groups).withColumn("weight", (F.col(n) / F.col("_top")).cast("float")).drop("_top")


def node_class(is_guest: Column, is_relevant: Column) -> Column:
    """guest before relevant before other."""
    return F.when(is_guest, "guest").when(is_relevant, "relevant").otherwise("other")


def vertex_rows(
    paths: DataFrame, guests: DataFrame, relevants: DataFrame, groups: list[str] = ()
) -> DataFrame:
    """One row per vertex on the paths: levels, distances to category 1, category and class.

    The level counts down from the guest (key + 1) to the relevant (0). Both sets
    have at most as many elements as a path has vertices.
    """
    ends = relevants.select(F.col("id").alias("relevant"), F.col("category").alias("end_category"))
    steps = path_steps(paths).join(ends, "relevant", "left")
    near = F.when(F.col("end_category") == 1, F.col("key")).otherwise(-1)
    rolled = (
        steps.withColumn("level", F.col("key") + 1 - F.col("pos"))
        .withColumn("near", near)
        .groupBy(*groups, "id")
        .agg(
            F.array_sort(F.collect_set("level")).alias("levels"),
            F.array_sort(F.collect_set("near")).alias("cat1Distances"),
        )
    )
    listed = guests.select("id").distinct().withColumn("_guest", F.lit(True))
    known = relevants.select("id", F.col("category").alias("_category"))
    return (
        rolled.join(listed, "id", "left")
        .join(known, "id", "left")
        .withColumn("category", F.coalesce("_category", F.lit(0)))
        .withColumn("class", node_class(F.col("_guest").isNotNull(), F.col("_category").isNotNull()))
        .drop("_guest", "_category")
    )


def rank_links(paths: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, id, linked, rank): best rank of a path through both vertices.

    One pass serves all rank thresholds. A path brings at most (length + 1)^2 rows.
    """
    return (
        paths.select(*groups, "rank", "vertices", F.explode("vertices").alias("id"))
        .select(*groups, "id", "rank", F.explode("vertices").alias("linked"))
        .groupBy(*groups, "id", "linked")
        .agg(F.min("rank").alias("rank"))
    )


def path_load(paths: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, id, bc): share of the paths that contain the vertex."""
    groups = list(groups)
    through = (
        paths.select(*groups, F.explode(F.array_distinct("vertices")).alias("id"))
        .groupBy(*groups, "id")
        .agg(F.count("*").alias("n"))
    )
    if groups:
        totals = paths.groupBy(*groups).agg(F.count("*").alias("total"))
        return through.join(totals, groups).withColumn("bc", F.col("n") / F.col("total")).drop("n", "total")
    total = paths.agg(F.count("*")).scalar()
    return through.withColumn("bc", F.col("n") / total).drop("n")


def closeness(rows: DataFrame, vertices: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, id, cc): number of vertices over the summed distances to the reachable ones.

    Needs all distances inside each graph, so it is meant for the subgraphs of a
    selection; with ``groups`` the work is the sum over the graphs. Every vertex is a
    landmark of the search, and distances being the same both ways, the sum over the
    landmarks that meet a vertex is its own; a pair is a bit, never a row.
    """
    groups = list(groups)
    links = both_ways(rows.select(*groups, "src", "dst")).distinct()
    ends = vertices.select(*groups, "id")
    sums = ends.join(summed_distances(links, ends, groups).drop("n_met"), groups + ["id"], "left")
    if groups:
        sizes = vertices.groupBy(*groups).agg(F.count("*").alias("n"))
        sums = sums.join(sizes, groups)
    else:
        sums = sums.withColumn("n", vertices.agg(F.count("*")).scalar())
    cc = F.when(F.col("sum_dist") > 0, F.col("n") / F.col("sum_dist")).otherwise(0.0)
    return sums.withColumn("cc", cc).drop("n", "sum_dist")


def subgraph_degree(rows: DataFrame, groups: list[str] = (), distinct_pairs: bool = False) -> DataFrame:
    """(groups, id, degree).

    Counts both directions of every edge row, and a pair has a row per rank and
    guest; ``distinct_pairs`` counts each neighbour once.
    """
    groups = list(groups)
    if distinct_pairs:
        return both_ways(rows.select(*groups, "src", "dst")).distinct().groupBy(
            *groups, F.col("src").alias("id")
        ).agg(F.count("*").alias("degree"))
    return (
        rows.select(*groups, F.explode(F.array("src", "dst")).alias("id"))
        .groupBy(*groups, "id")
        .agg((2 * F.count("*")).alias("degree"))
    )


def indexed_nodes(nodes: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Nodes with a dense 0-based ``index`` by id in each graph (W6) and their image file."""
    return dense_index(nodes, ["id"], groups).withColumn("image", image_file(F.col("id")))


def indexed_links(rows: DataFrame, nodes: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Edge rows with the indexes of their ends as ``source`` and ``target``."""
    groups = list(groups)
    place = nodes.select(*groups, "id", "index")
    return rows.join(
        place.withColumnRenamed("id", "src").withColumnRenamed("index", "source"), groups + ["src"]
    ).join(place.withColumnRenamed("id", "dst").withColumnRenamed("index", "target"), groups + ["dst"])


def indexed_rank_links(links: DataFrame, nodes: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Rank links with the index of the linked vertex (F34): (groups, id, rank, linked_index)."""
    groups = list(groups)
    place = nodes.select(*groups, F.col("id").alias("linked"), F.col("index").alias("linked_index"))
    return links.join(place, groups + ["linked"]).select(*groups, "id", "rank", "linked_index")
