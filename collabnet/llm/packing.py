"""Best-fit packing of tokenised documents into sequences of one length.

A plan needs only how many pieces there are of each length, at most ``capacity``
numbers however large the corpus is. Pieces above a third of the capacity are matched
in pairs, the largest with the largest that fits beside it; the smaller ones, in
falling order, fill the tightest gap that takes them. The plan is a list of runs:
pieces of one length, by their rank within it, fill consecutive sequences. Ranks are
counted in salted groups, so a length that many pieces share is dealt to many tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collabnet.llm import words
from collabnet.session import stored

CAPACITY = 2048
END = 0
BATCH_BYTES = 8 << 20
MIN_BUCKETS = 64


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids) of every document's ids followed by ``end``.

    ``ids`` is binary, little-endian unsigned 32-bit. Only documents longer than
    ``capacity`` are cut; their last piece may be shorter. A null or empty text is one
    piece of length 1, rows with a null or repeated id are documents of their own, and
    other columns are ignored.
    """
    schema = T.StructType(
        [T.StructField(id, docs.schema[id].dataType)]
        + [T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids", T.BinaryType))]
    )
    last = end.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, content in zip(batch.column(0), batch.column(1), strict=True):
                ids = words.packed_ids(path, content.as_py()) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc.as_py(), k, at // 4, len(part) // 4, part))
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield _batch(rows, batch.schema.field(0).type)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, batch.schema.field(0).type)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(id, text).mapInArrow(cut, schema)


class Run(NamedTuple):
    """Pieces of ``length`` with rank ``first`` <= rank < ``stop``: ``each`` of them a sequence, from ``sequence`` on, after ``used`` tokens."""

    length: int
    first: int
    stop: int
    sequence: int
    each: int
    used: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces go, given the number of pieces of each length (1 to ``capacity``)."""
    left = dict(counts)
    done = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens: (first sequence, number of sequences)
    opened = 0

    def put(length: int, n: int, sequence: int, each: int, used: int) -> None:
        runs.append(Run(length, done[length], done[length] + n, sequence, each, used))
        done[length] += n
        left[length] -= n

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        for b in (x for x in large if x <= min(a, capacity - a)):
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                if a == b:
                    put(a, 2 * n, opened, 2, 0)
                else:
                    put(a, n, opened, 1, 0)
                    put(b, n, opened, 1, a)
                gaps[capacity - a - b].append((opened, n))
                opened += n
            if not left[a]:
                break
        if n := left[a]:
            put(a, n, opened, 1, 0)
            gaps[capacity - a].append((opened, n))
            opened += n

    def fill(length: int, gap: int, first: int, n: int) -> None:
        """Put pieces into ``n`` sequences with ``gap`` free tokens, as many as there are."""
        each = gap // length
        whole = min(n, left[length] // each)
        if whole:
            put(length, whole * each, first, each, capacity - gap)
            gaps[gap - each * length].append((first, whole))
        if whole < n and left[length]:
            rest = left[length]
            put(length, rest, first + whole, rest, capacity - gap)
            gaps[gap - rest * length].append((first + whole, 1))
            whole += 1
        if whole < n:
            gaps[gap].append((first + whole, n - whole))

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= length):
            if not left[length]:
                break
            for first, n in gaps.pop(gap):
                if left[length]:
                    fill(length, gap, first, n)
                else:
                    gaps[gap].append((first, n))
        if left[length]:
            n = -(-left[length] // (capacity // length))
            fill(length, capacity, opened, n)
            opened += n
    return runs


def place(parts: DataFrame, capacity: int = CAPACITY, id: str = "doc_id") -> DataFrame:
    """``parts`` (id, piece, length and any others) with ``sequence_id`` and ``offset``, dense from 0.

    Equal rows are pieces of their own. An empty table gives no rows.
    """
    spark = parts.sparkSession
    parts = stored(parts)
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # at most capacity rows
    runs = spark.createDataFrame(
        [tuple(r) for r in plan(counts, capacity)],
        "run_length bigint, first bigint, stop bigint, sequence bigint, each bigint, used bigint",
    )
    buckets = max(MIN_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = parts.select(F.struct(*parts.columns).alias("part"), F.pmod(F.xxhash64(id, "piece"), F.lit(buckets)).alias("bucket"))
    salted = salted.withColumn("length", F.col("part.length"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "bucket").orderBy(F.col(f"part.{id}"), F.col("part.piece"))
    ranked = (
        salted.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place"))
    )
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop"))
    at = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(runs), fits).select(  # the plan's size depends on the capacity alone
        "part.*",
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("used") + at % F.col("each") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence.

    The plan is made on a number for each piece and its length; ids are stored once and
    meet their place at the end.
    """
    parts = stored(pieces(docs, path, capacity, END, id, text).withColumn("row_key", F.monotonically_increasing_id()))
    placed = place(parts.select("row_key", id, "piece", "length"), capacity, id)
    return parts.join(placed.select("row_key", "sequence_id", "offset"), "row_key").drop("row_key")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, each at most ``capacity`` long."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(inside, F.lit(b""), lambda ids, x: F.concat(ids, x["ids"])).alias("ids"),
    )
