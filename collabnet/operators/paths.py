"""Distances and all shortest paths on an undirected graph.

One level-synchronous search from all landmarks at once replaces a search per pair.
Sixty-four landmarks share a machine word: a row of a level is a vertex, a batch of
landmarks and a mask with a bit for each landmark that meets the vertex at this
distance. Masks are merged by ``bit_or`` on the map side and counted by ``bit_count``.
What lies on a shortest path is kept as arcs (``PathDag``), whose number the graph
bounds; paths are spelled out only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.operators.index import dense_index
from collabnet.session import stored, union_all

SHARD = 65_536
ROWS_PER_PARTITION = 1_000_000
BITS = 64  # landmarks of a batch


def sharded_adjacency(
    links: DataFrame, groups: list[str] = (), targets: DataFrame | None = None, shard: int = SHARD
) -> DataFrame:
    """Adjacency rows prepared for repeated expansion.

    ``links`` holds both directions. The neighbour list of a hub is cut into
    shards of about ``shard`` rows, so no task expands a whole hub; ``dst_shards``
    tells the next round into how many shards the reached vertex is cut, and
    ``dst_target`` whether it is one of ``targets`` (id).
    """
    groups = list(groups)
    sizes = links.groupBy(*groups, "src").agg(
        F.ceil(F.count("*") / F.lit(shard)).cast("int").alias("shards")
    )
    hubs = sizes.where(F.col("shards") > 1)
    src_hubs = hubs.withColumnRenamed("shards", "src_shards")
    dst_hubs = hubs.withColumnRenamed("src", "dst").withColumnRenamed("shards", "dst_shards")
    marked = links.join(src_hubs, groups + ["src"], "left").join(dst_hubs, groups + ["dst"], "left")
    if targets is None:
        marked = marked.withColumn("dst_target", F.lit(False))
    else:
        wanted = targets.select(F.col("id").alias("dst"), F.lit(True).alias("dst_target"))
        marked = marked.join(wanted, "dst", "left")
    return (
        marked.withColumn("src_shards", F.coalesce("src_shards", F.lit(1)))
        .withColumn("dst_shards", F.coalesce("dst_shards", F.lit(1)))
        .withColumn("dst_target", F.coalesce("dst_target", F.lit(False)))
        .withColumn("shard", F.pmod(F.xxhash64("dst"), F.col("src_shards")).cast("int"))
        .select(*groups, "src", "shard", "dst", "src_shards", "dst_shards", "dst_target")
    )


def _expand(frontier: DataFrame, adjacency: DataFrame, groups: list[str], keep: list[str]) -> DataFrame:
    """Join frontier rows (..., id, shards) with the neighbours of ``id``."""
    cells = frontier.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return cells.withColumnRenamed("id", "src").select(*groups, *keep, "src", "shard").join(
        adjacency, groups + ["src", "shard"]
    )


def _width(links: DataFrame) -> int:
    """Partitions for the cached adjacency: as its rows need, and for small ones as many as the cores or shuffles take."""
    spark = links.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(-(-links.count() // ROWS_PER_PARTITION), least)


def landmark_places(landmarks: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, landmark, batch, bit): the landmarks (groups, id) in batches of 64 within their group."""
    groups = list(groups)
    placed = dense_index(landmarks.select(*groups, "id").distinct(), ["id"], groups, "place")
    return stored(
        placed.select(
            *groups,
            F.col("id").alias("landmark"),
            F.floor(F.col("place") / BITS).cast("bigint").alias("batch"),
            (F.col("place") % BITS).cast("int").alias("bit"),
        )
    )


class MaskLevels:
    """Search from many landmarks: ``levels[d]`` holds (groups, batch, id, shards, target, mask).

    A vertex has a row per batch with a landmark at distance d.
    """

    def __init__(self, adjacency: DataFrame, groups: list[str], places: DataFrame):
        self.adjacency = adjacency
        self.groups = groups
        self.places = places
        self.levels: list[DataFrame] = []

    def release(self) -> None:
        """Drop the cached adjacency; the levels are stored and stay readable."""
        self.adjacency.unpersist()

    def spelled(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``batch`` and a ``mask`` as one row per landmark in the mask."""
        bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit("mask", b) == 1)
        kept = [c for c in rows.columns if c not in ("batch", "mask")]
        each = rows.withColumn("bit", F.explode(bits))
        return each.join(self.places, [*self.groups, "batch", "bit"]).select(*kept, "landmark")

    def distances(self) -> DataFrame:
        far = [
            level.select(*self.groups, "batch", "id", "mask", F.lit(d).alias("dist"))
            for d, level in enumerate(self.levels)
        ]
        return self.spelled(union_all(far)).select(*self.groups, "landmark", "id", "dist")

    def summed(self) -> DataFrame:
        """(groups, id, sum_dist, n_met): summed distances to the landmarks that meet the vertex, and their number."""
        far = [
            level.groupBy(*self.groups, "id").agg(
                (F.sum(F.bit_count("mask")) * d).alias("sum_dist"), F.sum(F.bit_count("mask")).alias("n_met")
            )
            for d, level in enumerate(self.levels)
        ]
        return union_all(far).groupBy(*self.groups, "id").agg(F.sum("sum_dist").alias("sum_dist"), F.sum("n_met").alias("n_met"))


def search_levels(
    links: DataFrame,
    landmarks: DataFrame,
    max_len: int | None = None,
    targets: DataFrame | None = None,
    groups: list[str] = (),
) -> MaskLevels:
    """Search from all ``landmarks`` (groups, id) at once; call ``release`` when done with the adjacency.

    The graph is undirected, so a neighbour of level d lies in level d - 1, d or
    d + 1; taking the bits of the last two levels out is enough and no set of all
    visited vertices is carried. With ``targets`` (id) the search ends as soon as
    every reachable pair has been met.
    """
    groups = list(groups)
    if targets is not None:
        targets = targets.select("id").distinct()
    # Cached partitioned and sorted by the expansion key: the rounds shuffle and sort
    # frontiers, not edges. Blocks lost with an executor are computed again.
    by = groups + ["src", "shard"]
    adjacency = (
        sharded_adjacency(links, groups, targets)
        .repartition(_width(links), *by)
        .sortWithinPartitions(*by)
        .persist()
    )
    search = MaskLevels(adjacency, groups, landmark_places(landmarks, groups))
    try:
        _search(search, max_len, targets)
    except BaseException:
        search.release()
        raise
    return search


def _search(search: MaskLevels, max_len: int | None, targets: DataFrame | None) -> None:
    groups, adjacency, levels = search.groups, search.adjacency, search.levels
    vertex = adjacency.groupBy(*groups, F.col("src").alias("id")).agg(F.max("src_shards").alias("shards"))
    start = search.places.select(
        *groups, "batch", F.col("landmark").alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")).alias("mask")
    ).join(vertex, groups + ["id"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    if targets is None:
        start = start.withColumn("target", F.lit(False))
    else:
        start = start.join(targets.withColumn("target", F.lit(True)), "id", "left").withColumn(
            "target", F.coalesce("target", F.lit(False))
        )
    cell = groups + ["batch", "id"]
    columns = [*cell, "shards", "target", "mask"]
    levels.append(stored(start.select(*columns)))

    def n_met(level: DataFrame) -> int:
        return level.where("target").agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0]

    open_pairs = None
    if targets is not None:
        open_pairs = levels[0].count() * targets.count() - n_met(levels[0])
    none = F.lit(0).cast("bigint")
    while (max_len is None or len(levels) <= max_len) and (open_pairs is None or open_pairs > 0):
        found = _expand(levels[-1], adjacency, groups, ["batch", "mask"]).select(
            *groups, "batch", F.col("dst").alias("id"), F.col("dst_shards").alias("shards"), F.col("dst_target").alias("target"),
            "mask", none.alias("known"),
        )
        known = [level.select(*cell, "shards", "target", none.alias("mask"), F.col("mask").alias("known")) for level in levels[-2:]]
        merged = union_all([found, *known]).groupBy(*cell).agg(
            F.max("shards").alias("shards"), F.max("target").alias("target"), F.bit_or("mask").alias("mask"), F.bit_or("known").alias("known")
        )
        fresh = merged.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not("known"))).where(F.col("mask") != 0)
        reached = stored(fresh.select(*columns))
        met = 0 if open_pairs is None else n_met(reached)
        if met == 0 and reached.isEmpty():
            break
        levels.append(reached)
        if open_pairs is not None:
            open_pairs -= met


def landmark_distances(
    links: DataFrame, landmarks: DataFrame, max_len: int | None = None, groups: list[str] = ()
) -> DataFrame:
    """(groups, landmark, id, dist) for every reachable pair; a landmark has distance 0 to itself."""
    search = search_levels(links, landmarks, max_len, groups=groups)
    search.release()
    return search.distances()


def summed_distances(links: DataFrame, landmarks: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(groups, id, sum_dist, n_met) of every vertex that a landmark reaches, without a row per pair."""
    search = search_levels(links, landmarks, groups=groups)
    search.release()
    return search.summed()


class PathDag:
    """All shortest paths of the pairs as arcs (G7, G9); as many rows as there are arcs, however many paths they make.

    ``arcs[d]`` holds (relevant, id, dst): an edge from distance d to d - 1 of a relevant
    that is on a shortest path of some guest. ``ends[d]`` holds (relevant, guest), the
    guests at distance d. A guest that is itself a relevant is at distance 0.
    """

    def __init__(self, arcs: dict[int, DataFrame], ends: list[DataFrame]):
        self.arcs = arcs
        self.ends = ends

    def paths(self) -> DataFrame:
        """(path_id, guest, relevant, key, vertices) of every path; tails are built upwards, each once for all guests behind it."""
        relevant = F.col("relevant")
        tails, found = None, [self.ends[0].select("relevant", "guest", F.array("guest", "guest").alias("vertices"))]
        for d, arcs in sorted(self.arcs.items()):
            if d == 1:
                tails = arcs.select(relevant, "id", F.array("id", "dst").alias("vertices"))
            else:
                longer = arcs.join(tails.withColumnRenamed("id", "dst"), ["relevant", "dst"])
                tails = longer.select(relevant, "id", F.concat(F.array("id"), "vertices").alias("vertices"))
            tails = stored(tails)
            own = self.ends[d].withColumnRenamed("guest", "id")
            found.append(tails.join(own, ["relevant", "id"], "left_semi").select("relevant", F.col("id").alias("guest"), "vertices"))
        paths = union_all(found).select("guest", "relevant", (F.size("vertices") - 2).alias("key"), "vertices")
        # Numbered once on stored rows, so a re-run task cannot renumber them.
        return stored(paths.withColumn("path_id", F.monotonically_increasing_id()))


def shortest_path_dag(
    links: DataFrame,
    guests: DataFrame,
    relevants: DataFrame,
    max_len: int | None = None,
    edge_filter: Column | None = None,
) -> PathDag:
    """The arcs of all shortest paths from each guest to each relevant, found from the relevants and followed from the guests."""
    if edge_filter is not None:
        links = links.where(edge_filter)
    links = links.select("src", "dst").where(F.col("src") != F.col("dst"))
    known = links.select(F.col("src").alias("id")).distinct()
    guests = guests.select("id").distinct().join(known, "id", "left_semi")
    relevants = relevants.select("id").distinct().join(known, "id", "left_semi")
    search = search_levels(links, relevants, max_len, targets=guests)
    levels = search.levels
    cell = ["batch", "id", "shards", "mask"]
    try:
        at_guest = [level.where("target").select(*cell) for level in levels]
        masked: dict[int, DataFrame] = {}
        active = at_guest[-1]
        for d in range(len(levels) - 1, 0, -1):
            lower = levels[d - 1].select("batch", F.col("id").alias("dst"), F.col("mask").alias("below"))
            steps = _expand(active, search.adjacency, [], ["batch", "mask"]).join(lower, ["batch", "dst"])
            steps = steps.withColumn("mask", F.col("mask").bitwiseAND(F.col("below"))).where(F.col("mask") != 0)
            masked[d] = stored(steps.select("batch", F.col("src").alias("id"), "dst", "dst_shards", "mask"))
            through = masked[d].select("batch", F.col("dst").alias("id"), F.col("dst_shards").alias("shards"), "mask")
            active = through.unionByName(at_guest[d - 1]).groupBy("batch", "id").agg(
                F.max("shards").alias("shards"), F.bit_or("mask").alias("mask")
            )
    finally:
        search.release()
    arcs = {d: search.spelled(m.drop("dst_shards")).withColumnRenamed("landmark", "relevant") for d, m in masked.items()}
    ends = [search.spelled(m.drop("shards")).select(F.col("landmark").alias("relevant"), F.col("id").alias("guest")) for m in at_guest]
    return PathDag(arcs, ends)


def all_shortest_paths(
    links: DataFrame,
    guests: DataFrame,
    relevants: DataFrame,
    max_len: int | None = None,
    edge_filter: Column | None = None,
) -> DataFrame:
    """Every shortest path from each guest to each relevant.

    Returns (path_id, guest, relevant, key, vertices): ``vertices`` runs from
    guest to relevant and ``key`` is the number of vertices between them. Guest =
    relevant gives the trivial path [g, g] with key 0, as a direct edge does.

    There may be exponentially many; ``pathcounts`` counts and ranks them without
    spelling them out.
    """
    return shortest_path_dag(links, guests, relevants, max_len, edge_filter).paths()


def guests_without_path(guests: DataFrame, links: DataFrame, paths: DataFrame) -> DataFrame:
    """Guests that have an edge but no path to any relevant, as rows with key -1."""
    known = links.select(F.col("src").alias("id")).distinct()
    return (
        guests.select("id")
        .distinct()
        .join(known, "id", "left_semi")
        .join(paths.select(F.col("guest").alias("id")).distinct(), "id", "left_anti")
        .select(F.col("id").alias("guest"), F.lit(-1).alias("key"))
    )


def distance_lists(distances: DataFrame, guests: DataFrame, relevants: DataFrame) -> DataFrame:
    """(guest, relevant, distance) with names, underscores shown as spaces."""
    g = guests.select("id", F.col("name").alias("guest_name"))
    r = relevants.select(F.col("id").alias("landmark"), F.translate("name", "_", " ").alias("relevant_name"))
    return (
        distances.join(g, "id")
        .join(r, "landmark")
        .select(
            F.col("id").alias("guest"),
            "guest_name",
            F.col("landmark").alias("relevant"),
            "relevant_name",
            F.col("dist").alias("distance"),
        )
    )


def path_steps(paths: DataFrame) -> DataFrame:
    """One row per path position: (path_id, guest, relevant, key, pos, id)."""
    return paths.select("path_id", "guest", "relevant", "key", F.posexplode("vertices").alias("pos", "id"))


def inner_steps(paths: DataFrame) -> DataFrame:
    """Positions strictly between guest and relevant."""
    return path_steps(paths).where((F.col("pos") > 0) & (F.col("pos") <= F.col("key")))


def path_edges(paths: DataFrame) -> DataFrame:
    """One row per edge of each path (G14): (path_id, guest, relevant, key, pos, src, dst).

    A trivial path has no edge.
    """
    hop = F.transform(
        F.sequence(F.lit(0), F.size("vertices") - 2),
        lambda i: F.struct(
            i.alias("pos"), F.get("vertices", i).alias("src"), F.get("vertices", i + 1).alias("dst")
        ),
    )
    return (
        paths.where(F.col("guest") != F.col("relevant"))
        .select("path_id", "guest", "relevant", "key", F.explode(hop).alias("hop"))
        .select("path_id", "guest", "relevant", "key", "hop.pos", "hop.src", "hop.dst")
    )


def described_paths(paths: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Add the vertex rows and edge rows of each path as lists of structs in path order.

    Searches carry ids only; the attributes are joined to the positions
    afterwards. ``edges`` is canonical. The lists are as long as the path.
    """

    def listed(steps: DataFrame, rows: DataFrame, key: list[str], out: str) -> DataFrame:
        one = F.struct("pos", F.struct(*[F.col(c) for c in rows.columns]).alias("row"))
        joined = steps.join(rows, key).groupBy("path_id").agg(F.array_sort(F.collect_list(one)).alias(out))
        return joined.withColumn(out, F.col(f"{out}.row"))

    steps = path_steps(paths).select("path_id", "pos", "id")
    hops = path_edges(paths).select(
        "path_id", "pos", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    )
    return paths.join(listed(steps, vertices, ["id"], "vertex_rows"), "path_id", "left").join(
        listed(hops, edges, ["src", "dst"], "edge_rows"), "path_id", "left"
    )


def wide_paths(described: DataFrame, key: int) -> DataFrame:
    """Paths of one key as columns ``from, e0, v1, e1 .. to`` of structs."""
    names = ["from"] + [f"v{i}" for i in range(1, key + 1)] + ["to"]
    vertex = [F.get("vertex_rows", F.lit(i)).alias(n) for i, n in enumerate(names)]
    edge = [F.get("edge_rows", F.lit(i)).alias(f"e{i}") for i in range(key + 1)]
    ordered = [c for pair in zip(vertex, edge) for c in pair] + vertex[-1:]
    return described.where(F.col("key") == key).select("path_id", *ordered)
