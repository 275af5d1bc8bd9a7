"""Writers (K1-K8). Every result is written by all tasks, as rows, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from collabnet.operators.graph import Graph


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, replacing what is there (K1)."""
    df.write.mode("overwrite").parquet(path)


def write_graph(graph: Graph, path: str) -> None:
    """The vertex and edge tables of a graph, and the titles behind the edges (K7)."""
    write_table(graph.vertices, f"{path}/vertices")
    write_table(graph.edges, f"{path}/edges")
    if graph.titles is not None:
        write_table(graph.titles, f"{path}/titles")


def gathered(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows dealt by their group before a write by directories: a small group is one file, a large one is split by size.

    The sizes are those of the shuffle, so groups need not be known beforehand.
    """
    return df.hint("rebalance", *groups) if groups else df


def write_paths(paths: DataFrame, path: str) -> None:
    """Paths with one directory per ``key``, in one write (K2, K3)."""
    gathered(paths, ["key"]).write.mode("overwrite").partitionBy("key").parquet(path)


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """JSON lines, CSV with header, or text, one record a row (K4, K5, K8)."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "json":
        writer.json(path)
    else:
        writer.text(path)


def write_groups(df: DataFrame, path: str, groups: list[str]) -> None:
    """JSON lines, in one write, with one directory per group value if there are groups."""
    writer = gathered(df, groups).write.mode("overwrite")
    (writer.partitionBy(*groups) if groups else writer).json(path)


def import_csv(df: DataFrame, path: str) -> None:
    """CSV directory with header for a graph-store import (K6)."""
    df.write.mode("overwrite").csv(path, header=True)
