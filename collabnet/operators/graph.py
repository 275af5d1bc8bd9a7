"""Property graph: degree, neighbour sums, collective influence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collabnet.session import cut_lineage

_FACTOR, _PRODUCT = "decimal(20,0)", "decimal(38,0)"  # degrees; sums and products of them


@dataclass(frozen=True)
class Graph:
    """Vertices (id, ...), canonical edges (src, dst, n_common) and, in long form, the
    events behind the edges: titles (src, dst, event, title)."""

    vertices: DataFrame
    edges: DataFrame
    titles: DataFrame | None = None


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse in one pass over the edges (U1); other columns are kept."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    turn = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    return edges.select(F.explode(turn).alias("e"), *rest).select("e.src", "e.dst", *rest)


def undirected(edges: DataFrame, min_common: int = 1, n_common: str = "n_common") -> DataFrame:
    """Weight-filtered undirected edge list without duplicates."""
    strong = edges.where(F.col(n_common) >= min_common) if n_common in edges.columns else edges
    return both_ways(strong.select("src", "dst")).distinct()


def prune_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that occur in an edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.join(ends, "id", "left_semi")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree) over edge rows; isolated vertices are absent."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("id"))
        .groupBy("id")
        .agg(F.count("*").alias("degree"))
    )


def neighbor_sum(edges: DataFrame, attributes: DataFrame, **sums) -> DataFrame:
    """Sum expressions over the attribute rows of all neighbours.

    ``attributes`` is keyed by ``id``; ``sums`` maps output names to columns of it.
    """
    links = both_ways(edges.select("src", "dst")).select(F.col("src").alias("to"), F.col("dst").alias("id"))
    return (
        links.join(attributes.hint("shuffle_hash"), "id")  # the links need no sort
        .groupBy("to")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        .withColumnRenamed("to", "id")
    )


def category_weight(relevants: DataFrame) -> DataFrame:
    """(id, weight): 2 for category 1, 1 for category 2 (P20); others have no row."""
    return relevants.select("id", (3 - F.col("category")).cast("bigint").alias("weight")).where(
        F.col("category").isin(1, 2)
    )


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(_FACTOR)


def influence(edges: DataFrame, relevants: DataFrame | None = None, alpha: float = 1) -> DataFrame:
    """Collective influence, and with ``relevants`` its category-weighted variant.

    ci  = (deg - 1) * sum over neighbours of (deg - 1)
    cii = (deg - 1 + w a M) * sum over neighbours of (deg - 1 + w a M),  M = largest degree

    Both neighbour sums come out of one pass over the edges, because the second
    is the first plus ``a M`` times the summed weights. Sums and products are
    decimals of 38 digits, those with a fractional ``alpha`` doubles.
    """
    deg = cut_lineage(degree(edges))
    less_one = _wide(F.col("degree") - 1)
    ci = (less_one * F.col("sum_neighbor_degree")).cast(_PRODUCT)
    if relevants is None:
        sums = neighbor_sum(edges, deg, sum_neighbor_degree=less_one)
        return deg.join(sums, "id").select("id", "degree", F.col("sum_neighbor_degree").cast(_PRODUCT).alias("sum_neighbor_degree"), ci.alias("ci"))
    weighted = deg.join(category_weight(relevants), "id", "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0).cast("bigint"))
    )
    sums = neighbor_sum(
        edges, weighted, sum_neighbor_degree=less_one, sum_neighbor_weight=F.col("weight")
    )
    whole = alpha == int(alpha)
    kind = _PRODUCT if whole else "double"
    boost = _wide(deg.agg(F.max("degree")).scalar()) * (F.lit(int(alpha)).cast(_FACTOR) if whole else F.lit(float(alpha)))
    return (
        weighted.join(sums, "id")
        .withColumn("boost", boost.cast(_FACTOR if whole else "double"))
        .withColumn("ci", ci)
        .withColumn("sum_neighbor_degree", F.col("sum_neighbor_degree").cast(_PRODUCT))
        .withColumn(
            "sum_neighbor_relevance",
            (F.col("sum_neighbor_degree") + F.col("boost") * _wide("sum_neighbor_weight")).cast(kind),
        )
        .withColumn(
            "cii",
            ((less_one + F.col("boost") * _wide("weight")) * F.col("sum_neighbor_relevance")).cast(kind),
        )
        .select("id", "degree", "sum_neighbor_degree", "ci", "sum_neighbor_relevance", "cii")
    )
