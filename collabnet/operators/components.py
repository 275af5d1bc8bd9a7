"""Connected components by alternating large-star and small-star rounds.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Each round is a minimum per vertex, which combines on the map side, and one join
of that minimum back to the edges, which adaptive execution splits on a hub.

Where edges far outnumber vertices, ``dense_components`` goes over the edges twice
only: its rounds run on one edge per vertex, then on the few edges between the trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collabnet.operators.graph import both_ways
from collabnet.session import cut_lineage, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of every vertex to the smallest vertex it sees."""
    near = both_ways(edges)
    low = near.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
    return (
        near.where(F.col("dst") > F.col("src"))
        .join(low, "src")
        .select(F.col("low").alias("src"), "dst")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect every vertex and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("dst").agg(F.min("src").alias("low"))
    joined = edges.join(low, "dst").select(
        F.explode(F.array("src", "dst")).alias("v"), F.col("low").alias("src")
    )
    return joined.where(F.col("v") != F.col("src")).select("src", F.col("v").alias("dst")).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every leaf has one centre and no centre is a leaf."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("v"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")),
                F.struct(F.col("src").alias("v"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")),
            )
        ).alias("e")
    ).select("e.*")
    bad = (
        ends.groupBy("v")
        .agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        .where((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("centre") > 0)))
    )
    return bad.isEmpty()


def _labelled(state: DataFrame) -> DataFrame:
    """(id, component) of the vertices of ``state``: edges (src, dst), ``src < dst``."""
    while True:
        state = cut_lineage(_small_star(_large_star(state)))
        if _is_forest_of_stars(state):
            break
    return state.select(F.col("dst").alias("id"), F.col("src").alias("component")).unionByName(
        state.select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    )


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component); the component is named after its smallest vertex.

    ``vertices`` (id) adds the vertices without an edge, each its own component.
    """
    edges = cut_lineage(
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    )
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id"))
    labelled = _labelled(edges.where(F.col("src") != F.col("dst")))
    alone = loops if vertices is None else vertices.select("id").unionByName(loops)
    alone = alone.distinct().join(labelled, "id", "left_anti").withColumn("component", F.col("id"))
    return labelled.unionByName(alone)


def dense_components(edges: DataFrame) -> DataFrame:
    """The same as ``connected_components(edges)``, for a stored table of very many edges.

    Every vertex is tied to its smallest neighbour, one edge per vertex at most. The
    edges that remain between these trees, each once, tie the trees together.
    """
    low = stored(
        both_ways(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low"))
    )
    trees = _labelled(low.where(F.col("low") < F.col("id")).select(F.col("low").alias("src"), F.col("id").alias("dst")))
    roots = stored(_relabelled(low.select("id", F.col("id").alias("root")), "root", trees))
    at = roots.hint("shuffle_hash")  # the edges need no sort
    between = (
        edges.join(at.select(F.col("id").alias("src"), F.col("root").alias("a")), "src")
        .join(at.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
        .where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    )
    joined = _labelled(stored(between.distinct()))
    return _relabelled(roots, "root", joined).withColumnRenamed("root", "component")


def _relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by its component in ``labels``, where it has one."""
    found = labels.select(F.col("id").alias(column), F.col("component"))
    return rows.join(found, column, "left").select(
        *[F.coalesce("component", column).alias(c) if c == column else F.col(c) for c in rows.columns]
    )
