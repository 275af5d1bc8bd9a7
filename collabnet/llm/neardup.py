"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact confirmation.

Texts with the same shingle set are one class, so copies cost one row each. Classes
that agree in a band of their signatures are candidates. A pair's signatures are
compared batch by batch; it is given up once the posterior probability that it is
similar enough falls below ``miss``. What survives is confirmed on the full sets.

A bucket is not expanded into its pairs. First its members are compared with its best
connected member: they stream past it in cells of bounded size, and its signature and
set are sent once to each cell. The members that a bucket still holds in different
components are then compared block by block, in place, each pair in the first bucket
it shares; what survives there is confirmed in falling order of agreement, and not at
all once the block has linked the two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from collabnet.operators.components import connected_components
from collabnet.session import stored

WORDS = 5
PERCENT = 80
HASHES = 128
BANDS = 32
BATCH = 32
MISS = 1e-9
CELL = 4096  # members compared with one centre in one place
BLOCK = 512  # members of a bucket compared with each other in one place
ROWS = 16  # of a block at a time
_CHUNK = 4096
_REMEMBERED = 300_000

_random = np.random.RandomState(7)
_MULTIPLY = _random.randint(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.randint(0, 2**63, HASHES, dtype=np.uint64)
_PLACES = _random.randint(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word)
        if len(self) < _REMEMBERED and len(word) <= 64:
            self[word] = made
        return made


def shingle_hashes(words: list[bytes], k: int, hashes: dict[bytes, int] | None = None) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``k`` words; fewer words are one run, none give none."""
    hashes = _WordHashes() if hashes is None else hashes
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    runs = np.zeros(n, np.uint64)
    for i in range(k):
        runs += each[i : i + n] * _PLACES[i]
    runs ^= runs >> np.uint64(29)
    runs *= _PLACES[-1]
    runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def class_name(shingles: np.ndarray) -> bytes | None:
    """Digest of a shingle set; an empty one has none."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        mixed = shingles[at : at + _CHUNK, None] * _MULTIPLY + _ADD
        np.minimum(low, (mixed >> np.uint64(32)).min(axis=0), out=low)
    return low.astype("<u4")


def signatures(docs: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """(id, version, n_shingles, class, sig); class names the shingle set, null for an empty one."""
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType)]).add("version", T.LongType())
    schema = schema.add("n_shingles", T.LongType()).add("class", T.BinaryType()).add("sig", T.BinaryType())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, classes, sigs = [], [], []
            for content in batch.column(2):
                found = shingle_hashes(words_of(content.as_py()), k, hashes)
                sizes.append(len(found))
                classes.append(class_name(found))
                sigs.append(signature(found).tobytes() if len(found) else None)
            made = [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=schema.fieldNames())

    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("version"), text).mapInArrow(sign, schema)


def band_keys(classes: DataFrame) -> DataFrame:
    """(class, band, key): one row per band; the key is the hash of the band's number and its values."""
    width = 4 * HASHES // BANDS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    banded = classes.select("class", "sig", band)
    values = F.substring("sig", F.col("band") * width + 1, F.lit(width))
    return banded.select("class", "band", F.xxhash64("band", values).alias("key"))


@lru_cache(maxsize=16)
def least_matches(percent: int, miss: float) -> list[int]:
    """By number of compared hashes: the fewest matches with which a pair is not given up.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1),
    and its chance of being at least t is that of at most m successes in n + 1 trials.
    """
    t, table = percent / 100, []
    for n in range(HASHES + 1):
        chance, m = 0.0, -1
        while m < n and chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        table.append(m)
    return table


def _signed(sig: bytes) -> np.ndarray:
    return np.frombuffer(sig, "<u4")


def agreeing(left: np.ndarray, right: np.ndarray, table: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) whose signatures do not rule them out, and their matches."""
    first = (left[:, None, :BATCH] == right[None, :, :BATCH]).sum(axis=2)
    x, y = np.nonzero(first >= table[BATCH])
    matches = first[x, y]
    for n in range(2 * BATCH, HASHES + 1, BATCH):
        seen = slice(n - BATCH, n)
        matches = matches + (left[x, seen] == right[y, seen]).sum(axis=1)
        alive = matches >= table[n]
        x, y, matches = x[alive], y[alive], matches[alive]
    return x, y, matches


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Are two sorted sets similar enough."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Of the pairs (centre, class), those (src, dst) that are similar enough.

    The members of a centre are dealt to cells; in each, the centre's row comes first
    and the members pass one by one.
    """
    table = least_matches(percent, miss)
    cells = pairs.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("class"), F.col("cells")).cast("int").alias("cell")
    members = pairs.join(cells, "centre").join(sets, "class").select("centre", cell, "class", "sig", "hashes")
    centres = cells.join(sets.withColumnRenamed("class", "centre"), "centre").select(
        "centre", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(None).cast("binary").alias("class"), "sig", "hashes"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sig, own = None, None, None
        for batch in batches:
            names, members, signs, hashes = (batch.column(i) for i in (0, 2, 3, 4))
            linked = []
            for i in range(batch.num_rows):
                if not members[i].is_valid:
                    at, sig, own = names[i].as_py(), _signed(signs[i].as_py()), np.frombuffer(hashes[i].as_py(), np.uint64)
                elif len(agreeing(sig[None], _signed(signs[i].as_py())[None], table)[0]):
                    if similar(own, np.frombuffer(hashes[i].as_py(), np.uint64), percent):
                        linked.append((at, members[i].as_py()))
            yield _pairs(linked)

    dealt = members.unionByName(centres).repartition("centre", "cell").sortWithinPartitions("centre", "cell", "class")
    return dealt.mapInArrow(compare, "src binary, dst binary")


def _pairs(linked: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([x[i] for x in linked], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["src", "dst"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[dict]]]:
    """Rows of one value of the first column after the other, as they come sorted."""
    name, held = None, []
    for batch in batches:
        column = batch.schema.names[0]
        for at in range(0, batch.num_rows, 256):
            for row in batch.slice(at, 256).to_pylist():
                if held and row[column] != name:
                    yield name, held
                    held = []
                name = row[column]
                held.append(row)
    if held:
        yield name, held


def _found(root: dict[bytes, bytes], x: bytes) -> bytes:
    while root.setdefault(x, x) != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def open_links(apart: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (src, dst) between the components that buckets (key, band, class, root) hold apart.

    A bucket is cut into blocks of ``BLOCK`` members, and a unit is a pair of blocks.
    """
    table = least_matches(percent, miss)
    blocks = apart.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("own")
    placed = apart.join(blocks, "key").select("key", "band", "class", "root", "blocks", own)
    units = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("own", other).alias("low"), F.greatest("own", other).alias("high")),
    )
    each = placed.select("key", "band", "class", "root", "own", F.explode(units).alias("unit"))
    unit = F.xxhash64("key", "unit.low", "unit.high").alias("unit")
    crosses = (F.col("unit.low") != F.col("unit.high")).alias("crosses")
    rows = each.select(unit, crosses, "band", "own", "class", "root").join(sets.select("class", "sig"), "class")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a unit that some other is not ruled out for."""
        for _, rows in _grouped(batches):
            x, y, _ = _open_pairs(rows, table)
            kept = [rows[i] for i in np.unique(np.concatenate([x, y]))]
            if kept:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            x, y, matches = _open_pairs(rows, table)
            sets_ = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            root: dict[bytes, bytes] = {}
            linked = []
            for at in np.argsort(-matches, kind="stable"):
                i, j = x[at], y[at]
                a, b = _found(root, rows[i]["root"]), _found(root, rows[j]["root"])
                if a != b and similar(sets_[i], sets_[j], percent):
                    root[a] = b
                    linked.append((rows[i]["class"], rows[j]["class"]))
            if linked:
                yield _pairs(linked)

    columns = ["unit", "crosses", "band", "own", "class", "root", "sig"]
    kinds = "unit bigint, crosses boolean, band int, own int, class binary, root binary, sig binary"
    types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 3)
    arrow = pa.schema(list(zip(columns, types, strict=True)))
    dealt = rows.select(*columns).repartition("unit").sortWithinPartitions("unit")
    found = stored(dealt.mapInArrow(near, kinds)).join(sets.select("class", "hashes"), "class").select(*columns, "hashes")
    return found.repartition("unit").sortWithinPartitions("unit").mapInArrow(confirm, "src binary, dst binary")


def _open_pairs(rows: list[dict], table: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a unit's members, by place, that lie in different components, share no earlier band and are not ruled out; their matches."""
    sigs = np.frombuffer(b"".join(r["sig"] for r in rows), "<u4").reshape(-1, HASHES)
    root = np.unique([r["root"] for r in rows], return_inverse=True)[1]
    own = np.array([r["own"] for r in rows])
    found = []
    for at in range(0, len(rows), ROWS):
        x, y, matches = agreeing(sigs[at : at + ROWS], sigs, table)
        x = x + at
        kept = (x < y) & (root[x] != root[y])
        if rows[0]["crosses"]:
            kept &= own[x] != own[y]
        x, y, matches = x[kept], y[kept], matches[kept]
        shared = (sigs[x] == sigs[y]).reshape(-1, BANDS, HASHES // BANDS).all(axis=2)
        first = shared.argmax(axis=1) == rows[0]["band"]
        found.append((x[first], y[first], matches[first]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def links(signed: DataFrame, docs: DataFrame, k: int, percent: int, miss: float, id: str, text: str) -> DataFrame:
    """(class, root): the classes that share a bucket with another, by component."""
    classes = signed.groupBy("class").agg(F.first("sig").alias("sig"), F.min("id").alias("id"))
    banded = band_keys(classes)
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = stored(banded.join(shared, "key"))
    crowd = members.groupBy("class").agg(F.sum("n").alias("crowd"))
    sets = stored(_sets(docs, classes.join(crowd, "class"), k, id, text))

    def rooted(edges: DataFrame) -> DataFrame:
        found = connected_components(edges, sets.select(F.col("class").alias("id")))
        return stored(found.select(F.col("id").alias("class"), F.col("component").alias("root")))

    known = members.select("key", "band", "class").join(sets.select("class", "crowd"), "class")
    centres = known.groupBy("key").agg(F.max(F.struct("crowd", "class"))["class"].alias("centre"))
    star = known.join(centres, "key").where(F.col("class") != F.col("centre")).select("centre", "class").distinct()
    edges = stored(star_links(star, sets, percent, miss))
    apart = _apart(known.select("key", "band", "class"), rooted(edges))
    return rooted(edges.unionByName(open_links(apart, sets, percent, miss)))


def _sets(docs: DataFrame, classes: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """(class, sig, crowd, hashes): the shingle set of each class, from the row with its smallest id.

    Rows that share an id are told apart by their class.
    """
    wanted = stored(classes.select("class", "sig", "crowd", "id"))
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(wanted.select("id").distinct(), "id", "left_semi")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [shingle_hashes(words_of(x.as_py()), k, words) for x in batch.column(0).slice(start, 256)]
                columns = [pa.array([class_name(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "hashes"])

    hashed = rows.select("text").mapInArrow(shingle, "class binary, hashes binary")
    return wanted.drop("id").join(hashed, "class").dropDuplicates(["class"])


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with their component."""
    labelled = members.join(found, "class")
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return stored(labelled.join(open_keys.select("key"), "key", "left_semi"))


def _judged(docs: DataFrame, k: int, percent: int, miss: float, id: str, text: str) -> DataFrame:
    """(id, version, n_shingles, component_id, kept); version is the hash of the text."""
    signed = stored(signatures(docs, k, id, text))
    linkable = F.col("class").isNotNull() & F.col("id").isNotNull()
    rooted = links(signed.where(linkable), docs, k, percent, miss, id, text)
    classes = signed.where(linkable).groupBy("class").agg(F.min("id").alias("low"))
    classes = classes.join(rooted, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("class", "component_id")
    rows = signed.select("id", "version", "n_shingles", "class")
    bare = rows.where(~linkable).withColumn("component_id", F.col("id"))
    result = rows.where(linkable).join(named, "class", "left").unionByName(bare)
    return result.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def components(
    docs: DataFrame, k: int = WORDS, percent: int = PERCENT, miss: float = MISS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked when 100 * shared shingles >= ``percent`` * shingles of both;
    ``component_id`` is the smallest id reachable, ``kept`` marks the row that has it.
    A text without words, or null, has no shingles and is linked with nothing; neither
    is a row without an id, which has no component and is kept. Rows with one id are
    judged each by its own text, equal rows get equal results, other columns are
    ignored, an empty table gives no rows.
    """
    judged = _judged(docs, k, percent, miss, id, text)
    return judged.select(F.col("id").alias(id), "n_shingles", "component_id", "kept")


def deduplicate(
    docs: DataFrame, k: int = WORDS, percent: int = PERCENT, miss: float = MISS, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``components`` keeps; of rows equal in id and text, one."""
    kept = _judged(docs, k, percent, miss, id, text).where("kept and id is not null").select("id", "version").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("id"), F.xxhash64(text).alias("version"))
    named = rows.where(F.col("id").isNotNull()).join(kept, ["id", "version"], "left_semi").dropDuplicates(["id", "version"])
    return named.unionByName(rows.where(F.col("id").isNull())).select("row.*")
