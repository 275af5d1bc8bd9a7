"""Path trees: guest -> ... -> relevants, merged where paths meet at the same position.

The tree is kept as rows. In document order a node's number is its parent's, plus one,
plus the sizes of the subtrees of its elder siblings: sizes are summed bottom-up, level
by level, and numbers dealt out top-down. Sorted by guest and number the rows are the
document, which a reader writes nested as they come; nothing is folded into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collabnet.operators.index import sums_before
from collabnet.session import stored, union_all

NODE = ["guest", "pos", "id", "is_end"]


def tree_rows(paths: DataFrame) -> DataFrame:
    """Distinct (guest, pos, id, is_end, parent) with pos >= 1; at pos 1 the parent is the guest.

    Within a guest, a vertex at a position is one node whatever led to it, and
    its children are those of all its paths.
    """
    hop = F.transform(
        F.sequence(F.lit(1), F.size("vertices") - 1),
        lambda i: F.struct(
            i.alias("pos"),
            F.get("vertices", i).alias("id"),
            (i == F.size("vertices") - 1).alias("is_end"),
            F.get("vertices", i - 1).alias("parent"),
        ),
    )
    return paths.select("guest", F.explode(hop).alias("h")).select("guest", "h.*").distinct()


def _subtree_sizes(rows: DataFrame, depth: int) -> dict[int, DataFrame]:
    """By position: (guest, pos, id, is_end, size), the nodes of the subtree with its top; an end has no children."""
    sizes: dict[int, DataFrame] = {}
    for pos in range(depth, 0, -1):
        level = rows.where(F.col("pos") == pos).select(*NODE).distinct()
        if pos == depth:
            sizes[pos] = level.withColumn("size", F.lit(1).cast("bigint"))
            continue
        below = (
            rows.where(F.col("pos") == pos + 1)
            .join(sizes[pos + 1], NODE)
            .groupBy("guest", F.col("parent").alias("id"))
            .agg(F.sum("size").alias("_below"))
        )
        inner = F.when(F.col("is_end"), F.lit(0)).otherwise(F.coalesce("_below", F.lit(0)))
        sized = level.join(below, ["guest", "id"], "left").select(*NODE, (inner + 1).cast("bigint").alias("size"))
        sizes[pos] = stored(sized)
    return sizes


def tree_order(rows: DataFrame) -> DataFrame:
    """(guest, preorder, parent_preorder, pos, id, is_end, size) of every node of the nested document.

    ``rows`` are ``tree_rows``. A node that several parents share stands under each of
    them, children in the order of their ids, an inner vertex before an end of the same
    id. The guest is number 0; ``size`` counts the node and all below it, so they are
    the numbers from ``preorder`` up to ``preorder + size - 1``.
    """
    rows = stored(rows)
    depth = rows.agg(F.max("pos")).first()[0] or 0
    sizes = _subtree_sizes(rows, depth)
    number = F.lit(None).cast("bigint")
    levels, above = [], None
    for pos in range(1, depth + 1):
        born = rows.where(F.col("pos") == pos).join(sizes[pos], NODE)
        placed = sums_before(born, ["id", "is_end"], ["guest", "parent"], "size")
        if above is None:
            tops = placed.groupBy("guest").agg((F.sum("size") + 1).cast("bigint").alias("size"))
            above = tops.select(
                "guest", F.lit(0).cast("bigint").alias("preorder"), number.alias("parent_preorder"), F.lit(0).alias("pos"),
                F.col("guest").alias("id"), F.lit(False).alias("is_end"), "size",
            )
            levels.append(above)
        parents = above.where(~F.col("is_end")).select("guest", F.col("id").alias("parent"), F.col("preorder").alias("parent_preorder"))
        own = placed.join(parents, ["guest", "parent"])
        above = stored(
            own.select(
                "guest", (F.col("parent_preorder") + 1 + F.col("before")).cast("bigint").alias("preorder"), "parent_preorder",
                "pos", "id", "is_end", "size",
            )
        )
        levels.append(above)
    if not levels:
        return rows.select("guest", number.alias("preorder"), number.alias("parent_preorder"), "pos", "id", "is_end", number.alias("size"))
    return union_all(levels)


def in_document_order(nodes: DataFrame) -> DataFrame:
    """Rows of ``tree_order`` range-partitioned and sorted, so that the files, read in their order, are the documents."""
    return nodes.repartitionByRange("guest", "preorder").sortWithinPartitions("guest", "preorder")
