"""Path scores and ranks per (relevant, guest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collabnet.operators.index import dense_index
from collabnet.operators.pathcounts import COUNT, PAIR
from collabnet.operators.paths import inner_steps, path_edges, path_steps


def path_scores(paths: DataFrame, vertices: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """(path_id, cb, sum_CI, sum_CII) for the paths with inner vertices.

    cb sums, over the inner vertices, the number of paths of the same pair that
    contain the vertex: ``through`` (relevant, guest, id, n_paths), as
    ``pathcounts.paths_through`` takes it from the arcs. Without it the given paths
    are counted; guest and relevant are never inner vertices of a shortest path of
    their pair, so counting inner positions counts paths.
    """
    inner = inner_steps(paths)
    if through is None:
        through = inner.groupBy(*PAIR, "id").agg(F.count("*").alias("n_paths"))
    return (
        inner.join(through, PAIR + ["id"])
        .join(vertices.select("id", "ci", "cii"), "id", "left")
        .groupBy("path_id")
        .agg(
            F.sum("n_paths").cast(COUNT).alias("cb"),
            F.sum("ci").cast(COUNT).alias("sum_CI"),
            F.sum("cii").cast(COUNT).alias("sum_CII"),
        )
    )


def _dense_rank(scored: DataFrame, score: str, out: str) -> DataFrame:
    """Dense rank, descending, within the pair.

    The distinct scores are range-partitioned by pair and score, numbered inside their
    partition and shifted by the scores before, so a pair's scores are dealt to many tasks.
    """
    distinct = scored.select(*PAIR, score).distinct().withColumn("_falling", -F.col(score))
    ranks = dense_index(distinct, ["_falling"], PAIR, out).withColumn(out, F.col(out) + 1).drop("_falling")
    return scored.join(ranks, PAIR + [score])


def rank_paths(paths: DataFrame, vertices: DataFrame, through: DataFrame | None = None) -> DataFrame:
    """Add path_count, cb, sum_CI, sum_CII and their dense ranks.

    A path without inner vertices scores cb = 0 and sums of 1. Every path is a row;
    ``pathcounts.best_paths`` ranks without that.
    """
    counts = paths.groupBy(*PAIR).agg(F.count("*").alias("path_count"))
    scored = (
        paths.join(path_scores(paths, vertices, through), "path_id", "left")
        .withColumn("cb", F.coalesce("cb", F.lit(0).cast(COUNT)))
        .withColumn("sum_CI", F.coalesce("sum_CI", F.lit(1).cast(COUNT)))
        .withColumn("sum_CII", F.coalesce("sum_CII", F.lit(1).cast(COUNT)))
        .join(counts, PAIR)
    )
    for score, out in (("cb", "rank_cb"), ("sum_CI", "rank_ci"), ("sum_CII", "rank_cii")):
        scored = _dense_rank(scored, score, out)
    return scored


def selected_vertex_ids(ranked: DataFrame, max_rank: int) -> DataFrame:
    """Distinct vertex ids over paths with rank_ci or rank_cii up to ``max_rank``."""
    chosen = ranked.where((F.col("rank_ci") <= max_rank) | (F.col("rank_cii") <= max_rank))
    return path_steps(chosen).select("id").distinct()


def selected_release_ids(ranked: DataFrame, max_rank: int, edge_events: DataFrame) -> DataFrame:
    """Distinct release ids behind the edges of the same paths.

    ``edge_events`` is the long form (src, dst, event) of the edges, src < dst.
    """
    chosen = ranked.where((F.col("rank_ci") <= max_rank) | (F.col("rank_cii") <= max_rank))
    used = path_edges(chosen).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edge_events.join(used.distinct(), ["src", "dst"], "left_semi").select(F.col("event").alias("id")).distinct()
