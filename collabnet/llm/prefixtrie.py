"""Prefix trie of conversations, from the common prefixes of sorted neighbours.

A conversation is a path of turn digests, all of one width, so that the order of paths
as bytes puts conversations with a common prefix side by side. Equal paths are one
entry. The sorted entries are dealt to tasks and cut into blocks; in a block, the
lengths of the prefixes that neighbours share are edges, and a union-find takes them in
descending depth: where components meet, a node branches, and above it they climb as
one until the next edge. A component that holds neither end of its block is complete
and its nodes are final. What contains the first or the last entry may go on in the
neighbouring block; these forests are contracted to the two paths at the ends, with
what hangs off them summed up per depth, and are the entries of the next round, until
one block is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collabnet.operators.index import dense_index
from collabnet.session import left_join, stored, union_all

WIDTH = 16  # bytes of a turn's digest
BLOCK = 20_000  # entries
BLOCK_BYTES = 64 << 20
LEAST = 8  # entries of a block, however long, so that every round has fewer
SMALL = 500  # entries that are one block from the start


def turn_digests(turns: DataFrame, id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, pos, digest, size): the turns of every conversation, numbered from 0, without their texts.

    Turns are in ascending order, a null first, equal ones by digest. A null role or
    text counts as empty; ``size`` is the text's length in UTF-8 bytes. Rows without an
    id belong to no conversation and are left out. Numbers come from one range sort,
    so that a conversation with very many turns is dealt to many tasks.
    """
    said, content = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said, content), 256)
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("id"),
        F.col(order).alias("at"),
        F.unhex(F.substring(whole, 1, 2 * WIDTH)).alias("digest"),
        F.octet_length(content).cast("bigint").alias("size"),
    )
    return dense_index(rows, ["at", "digest"], ["id"], "pos").select("id", "pos", "digest", "size")


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path, sizes) of every id: its digests one after the other, empty without a turn.

    A conversation is one row, of 16 bytes and a size per turn; texts never meet.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", F.hex("digest").alias("digest"), "size")))
    found = turns.groupBy("id").agg(listed.alias("turns")).select(
        "id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.size").alias("sizes")
    )
    none = ids.select("id").distinct().join(found, "id", "left_anti")
    return found.unionByName(none.select("id", F.unhex(F.lit("")).alias("path"), F.array().cast("array<bigint>").alias("sizes")))


_SUMS = ("n", "children", "leaves", "saved")
_LONGS = T.ArrayType(T.LongType())
ENTRY = T.StructType(
    [T.StructField("path", T.BinaryType()), T.StructField("sizes", _LONGS)]
    + [T.StructField(f"{c}_by", _LONGS) for c in ("low", *_SUMS)]
    + [T.StructField("ends_by", T.ArrayType(T.BinaryType()))]
)
NODE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("depth", "conv_id", "parent_conv_id", *(f"n_{c}" for c in _SUMS))]
    + [T.StructField(c, T.BinaryType()) for c in ("end", "key", "above")]
)


def entries(found: DataFrame) -> DataFrame:
    """The distinct paths of (id, path, sizes); lists are by depth, from the root down."""
    by_path = found.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.first("sizes").alias("sizes"))
    depths = F.size("sizes") + 1
    zeros = F.array_repeat(F.lit(0).cast("bigint"), depths)
    above = F.array_repeat(F.lit(None).cast("binary"), depths - 1)
    return by_path.select(
        "path", "sizes", F.array_repeat("low", depths).alias("low_by"), F.array_repeat("n", depths).alias("n_by"),
        zeros.alias("children_by"), zeros.alias("leaves_by"), zeros.alias("saved_by"),
        F.concat(above, F.array(end_name(F.col("path")))).alias("ends_by"),
    )


def end_name(path):
    """Short name of a whole path."""
    return F.unhex(F.md5(path))


def common_depth(a: bytes, b: bytes) -> int:
    """Number of turns at the start that two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """Digest of every prefix, from the root's on."""
    state = hashlib.blake2b(digest_size=WIDTH)
    keys = [state.digest()]
    for at in range(0, len(path), WIDTH):
        state.update(path[at : at + WIDTH])
        keys.append(state.copy().digest())
    return keys


class _Component:
    """Entries ``first`` to ``last`` of a block; its top is their common node at ``depth``.

    ``rows`` holds by depth what entries bring, ``waiting`` the made nodes that wait
    for their parent, the top, to be named.
    """

    __slots__ = ("first", "last", "depth", "low", "sums", "ends", "waiting")

    def __init__(self, at: int, entry: dict):
        self.first = self.last = at
        self.depth = len(entry["sizes"])
        self.low = list(entry["low_by"])
        self.sums = [list(entry[f"{c}_by"]) for c in _SUMS]
        self.ends = list(entry["ends_by"])
        self.waiting: list[dict] = []

    def join(self, other: _Component) -> None:
        """Take in the component after this one; both have their top at one depth."""
        for d, low in enumerate(other.low):
            self.low[d] = min((x for x in (self.low[d], low) if x is not None), default=None)
            self.ends[d] = self.ends[d] or other.ends[d]
        for mine, theirs in zip(self.sums, other.sums, strict=True):
            for d, x in enumerate(theirs):
                mine[d] += x
        self.last = other.last
        if len(self.waiting) < len(other.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting.extend(other.waiting)


def forest(block: list[dict], final: bool, keyed: bool) -> tuple[list[dict], list[dict]]:
    """The complete nodes of a block of sorted entries, and the entries that it is contracted to.

    With ``final`` every node is complete. ``keyed`` says that nodes of earlier rounds
    may wait for these as parents, so they carry their prefix's key.
    """
    n = len(block)
    keys = [prefix_keys(e["path"]) if keyed or (not final and i in (0, n - 1)) else None for i, e in enumerate(block)]
    parts = [_Component(i, e) for i, e in enumerate(block)]
    root = list(range(n))
    made: list[dict] = []
    spines: tuple[dict, dict] = ({}, {})  # by depth, along the first and the last entry

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def close(c: _Component) -> dict:
        """Make the node at the top of ``c``."""
        d = c.depth
        count, children, leaves, saved = (s[d] for s in c.sums)
        size = block[c.first]["sizes"][d - 1] if d else 0
        node = {
            "depth": d, "conv_id": c.low[d], "parent_conv_id": None, "n_n": count, "n_children": children,
            "n_leaves": leaves if children else 1, "n_saved": saved + (count - 1) * size,
            "end": c.ends[d], "key": keys[c.first][d] if keyed else None, "above": None,
        }
        for child in c.waiting:
            child["parent_conv_id"] = node["conv_id"]
        made.append(node)
        return node

    def climb(c: _Component, to: int) -> None:
        """Move the top of ``c`` up to depth ``to``, leaving its nodes below."""
        while c.depth > to:
            d = c.depth
            is_open = not final and (c.first == 0 or c.last == n - 1)
            if is_open:
                side = 0 if c.first == 0 else 1
                spines[side][d] = (c.low[d], *(s[d] for s in c.sums), c.ends[d])
                for child in c.waiting:
                    child["above"] = keys[0 if side == 0 else n - 1][d]
                c.waiting = []
            else:
                node = close(c)
                c.sums[1][d - 1] += 1
                c.sums[2][d - 1] += node["n_leaves"]
                c.sums[3][d - 1] += node["n_saved"]
                c.waiting = [node]
            for list_ in (c.low, c.ends, *c.sums):
                list_.pop()
            c.depth = d - 1

    shared = [0] + [common_depth(a["path"], b["path"]) for a, b in zip(block, block[1:], strict=False)]
    for i in sorted(range(1, n), key=lambda i: -shared[i]):
        left, right = parts[find(i - 1)], parts[find(i)]
        climb(left, shared[i])
        climb(right, shared[i])
        left.join(right)
        root[right.first] = left.first
        parts[left.first] = left
    whole = parts[find(0)]
    climb(whole, 0)
    if final:
        close(whole)
        return made, []
    spines[0][0] = (whole.low[0], *(s[0] for s in whole.sums), whole.ends[0])
    for child in whole.waiting:
        child["above"] = keys[0][0]
    contracted = []
    for side, entry in ((0, block[0]), (1, block[-1]))[: min(n, 2)]:
        nothing = (None, 0, 0, 0, 0, None)
        depths = [spines[side].get(d, nothing) for d in range(len(entry["sizes"]) + 1)]
        columns = list(zip(*depths, strict=True))
        contracted.append({"path": entry["path"], "sizes": entry["sizes"], "low_by": columns[0], "ends_by": columns[5]} | {f"{c}_by": columns[1 + i] for i, c in enumerate(_SUMS)})
    return made, contracted


def _round(sorted_entries: DataFrame, final: bool, keyed: bool) -> DataFrame:
    """Nodes and contracted entries of all blocks, as one table; rows of the one have no columns of the other."""
    schema = T.StructType([*NODE.fields, *ENTRY.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        held = 0

        def done() -> Iterator[pa.RecordBatch]:
            made, contracted = forest(block, final, keyed)
            rows = [*made, *contracted]
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in part], f.type) for f in arrow], schema=arrow)

        arrow = pa.schema(
            [pa.field(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary()) for f in NODE.fields]
            + [pa.field("path", pa.binary())]
            + [pa.field(f.name, pa.list_(pa.binary() if f.name == "ends_by" else pa.int64())) for f in ENTRY.fields[1:]]
        )
        for batch in batches:
            for entry in batch.to_pylist():
                block.append(entry)
                held += 16 * len(entry["path"]) + 1000
                if not final and (len(block) == BLOCK or held >= BLOCK_BYTES and len(block) >= LEAST):
                    yield from done()
                    block, held = [], 0
        if block:
            yield from done()

    return sorted_entries.mapInArrow(run, schema)


def trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie of (id, path, sizes), a row each.

    (depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, end):
    ``conv_id`` is the smallest id that starts with the node's turns, ``n_leaves`` and
    ``saved_tokens`` are over its subtree, ``end`` is ``end_name`` of the path if a
    conversation ends here, else null. Without a conversation there is no node.
    """
    spark = found.sparkSession
    todo, rounds, keyed = stored(entries(found)), [], False
    while True:
        n = todo.count()
        final = n <= (BLOCK if rounds else SMALL)
        parts = -(-n // BLOCK) if rounds else max(-(-n // BLOCK), int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = todo.coalesce(1) if final else todo.repartitionByRange(parts, "path")
        made = stored(_round(dealt.sortWithinPartitions("path"), final, keyed))
        rounds.append(made.where("depth is not null").select(*NODE.fieldNames()))
        if final:
            break
        todo, keyed = made.where("depth is null").select(*ENTRY.fieldNames()), True
    nodes = union_all(rounds)
    parents = nodes.where("key is not null").select(F.col("key").alias("above"), F.col("conv_id").alias("found"))
    named = left_join(nodes.drop("key"), parents, "above")
    return named.select(
        "depth", "conv_id", F.coalesce("parent_conv_id", "found").alias("parent_conv_id"), F.col("n_n").alias("n_convs"),
        "n_children", "n_leaves", F.col("n_saved").alias("saved_tokens"), "end",
    )


def listed_ids(members: DataFrame) -> DataFrame:
    """(end, ids_sha256): of the ids in (id, end), the lower-case SHA-256 of the ascending, comma-joined decimals.

    Ids are joined to texts in a range sort, however many an end has, and then hashed
    one text after the other.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, ids, rows = None, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.binary(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["end", "first", "ids"])

        for got in batches:
            for name, id in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if ids and (name != end or len(ids) == BLOCK):
                    rows.append((end, ids[0], ",".join(map(str, ids))))
                    ids = []
                end = name
                ids.append(id)
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
        if ids:
            rows.append((end, ids[0], ",".join(map(str, ids))))
        if rows:
            yield batch(rows)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, None
        for got in batches:
            ends, sums = [], []
            for name, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if state is not None and name == end:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    ends.append(end)
                    sums.append(state.hexdigest())
                end, state = name, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(sums, pa.string())], names=["end", "ids_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], names=["end", "ids_sha256"])

    ranged = members.select("end", "id").repartitionByRange("end", "id").sortWithinPartitions("end", "id")
    joined = ranged.mapInArrow(join, "end binary, first bigint, ids string")
    together = joined.repartition("end").sortWithinPartitions("end", "first").select("end", "ids")
    return together.mapInArrow(digest, "end binary, ids_sha256 string")
