"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is what stands between two line feeds. It is hashed to a wide vector: eight
64-bit words from a cryptographic hash of the whole paragraph, added modulo 2^64, and 256
counters modulo 2^32 into which its runs of bytes are counted with a hashed place and
sign. A document's fingerprint is the sum of its paragraphs' vectors. So the order of
paragraphs does not matter, and a paragraph is inserted or deleted by one addition or
subtraction, without the rest of the text. The words make equality hard to feign; the
inner product of two counter vectors estimates how many runs the documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 8
LANES = 256
RUN = 16  # bytes
CHUNK = 1 << 20  # runs counted at a time
BATCH_BYTES = 4 << 20
ACCURACY = 10_000  # of the id quantiles, at least

_PAD = b"\xff" * (RUN - 1)  # a byte that no UTF-8 text holds
_FIRST, _SECOND, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HALF, _KEY = np.uint64(32), np.uint64(64 - 9)  # 8 bits of place and one of sign


class Fingerprint(NamedTuple):
    """Sum of paragraph vectors; ``words`` modulo 2^64, ``lanes`` modulo 2^32."""

    words: np.ndarray
    lanes: np.ndarray

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.words + other.words, self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.words - other.words, self.lanes - other.lanes)

    def same(self, other: Fingerprint) -> bool:
        return bool((self.words == other.words).all() and (self.lanes == other.lanes).all())

    def text(self) -> str:
        """Base64 of the words and of the lanes in the narrowest width that holds all, which the length tells."""
        signed = self.lanes.view("<i4")
        most = int(np.abs(signed.astype(np.int64)).max())
        kind = "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i4"
        return base64.b64encode(self.words.tobytes() + signed.astype(kind).tobytes()).decode()

    @staticmethod
    def parse(text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        kind = f"<i{(len(raw) - 8 * WORDS) // LANES}"
        lanes = np.frombuffer(raw, kind, offset=8 * WORDS).astype("<i4").view("<u4")
        return Fingerprint(np.frombuffer(raw, "<u8", WORDS), lanes)


#: Of no paragraph at all; an empty text has one, empty paragraph.
ZERO = Fingerprint(np.zeros(WORDS, "<u8"), np.zeros(LANES, "<u4"))


def of_paragraphs(text: str) -> Fingerprint:
    """Sum of the vectors of the paragraphs of ``text``."""
    raw = text.encode("utf-8", "replace")
    digests = b"".join(hashlib.blake2b(p, digest_size=8 * WORDS).digest() for p in raw.split(b"\n"))
    words = np.frombuffer(digests, "<u8").reshape(-1, WORDS).sum(axis=0, dtype=np.uint64)
    padded = _PAD + raw.replace(b"\n", b"\n" + _PAD) + b"\n"
    n = len(padded) - RUN + 1  # a run ends at every byte of a paragraph and at its line feed
    counts = np.zeros(2 * LANES, np.int64)
    for at in range(0, n, CHUNK):
        here = (min(CHUNK, n - at),)
        low, high = (np.ndarray(here, "<u8", padded, at + k, (1,)) for k in (0, RUN - 8))
        mixed = low * _FIRST + high * _SECOND
        mixed ^= mixed >> _HALF
        mixed *= _MIX
        inside = np.frombuffer(padded, np.uint8, here[0], at + RUN - 1) != 0xFF
        counts += np.bincount((mixed[inside] >> _KEY).view(np.int64), minlength=2 * LANES)
    return Fingerprint(words, (counts[0::2] - counts[1::2]).astype("<i4").view("<u4"))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Estimated share of runs in common, 2 a.b / (a.a + b.b) cut to 0 .. 1; 1 for equal fingerprints."""
    if a.same(b):
        return 1.0
    x, y = (f.lanes.view("<i4").astype(np.float64) for f in (a, b))
    size = x @ x + y @ y
    return float(min(max(2 * (x @ y) / size, 0.0), 1.0)) if size else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def split_at_edit(text: str) -> tuple[str | None, str]:
    """The paragraphs that the edit leaves whole (None without one), and the rest."""
    start = text.rfind("\n", 0, len(text) - len(text) // 2) + 1
    return (text[: start - 1] if start else None), text[start:]


class _Document:
    """A document with the sums of the paragraphs before its edit and of those that the edit touches."""

    def __init__(self, id, text: str):
        self.id, self.text = id, text
        self.whole, self.touched = split_at_edit(text)
        self.before = ZERO if self.whole is None else of_paragraphs(self.whole)
        self.fingerprint = self.before + of_paragraphs(self.touched)

    def row(self, following: _Document) -> tuple:
        changed = edited(self.text, following.text)
        kept = 0 if self.whole is None else len(self.whole) + 1
        after = self.before + of_paragraphs(changed[kept:])  # the touched paragraphs deleted, the new ones inserted
        return (
            self.id,
            len(self.text),
            hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
            self.fingerprint.text(),
            after.text(),
            likeness(self.fingerprint, after),
            likeness(self.fingerprint, following.fingerprint),
        )


_COLUMNS = (
    ("n_chars", T.LongType, pa.int64()),
    ("edited_sha256", T.StringType, pa.string()),
    ("fingerprint", T.StringType, pa.string()),
    ("edited_fingerprint", T.StringType, pa.string()),
    ("near_edited", T.DoubleType, pa.float64()),
    ("near_next", T.DoubleType, pa.float64()),
)


def _bucket(id: Column, bounds: list[int]) -> Column:
    """Number of bounds above the id, found in two steps of about the square root of their number; a null comes last."""
    step = max(1, int(len(bounds) ** 0.5))
    falling = sorted(bounds, reverse=True)
    blocks = [falling[at : at + step] for at in range(0, len(falling), step)]
    array = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    if not blocks:
        return F.lit(0)
    whole = F.size(F.filter(array([b[-1] for b in blocks]), lambda x: x > id))
    inside = F.size(F.filter(F.get(F.array(*map(array, blocks)), whole), lambda x: x > id))
    found = whole * step + F.when(whole < len(blocks), inside).otherwise(0)
    return F.when(id.isNull(), len(bounds)).otherwise(F.least(found, F.lit(len(bounds)))).cast("int")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next smaller id, after the last the first;
    rows with a null id come last, rows that share an id are in the order of their
    texts' hash. A null text counts as empty, other columns are ignored, a table of
    one row is its own next, an empty one gives no rows.

    Texts are shuffled once, into falling ranges of ids. The first row of a range also
    goes to the range before it, whose last row needs it; these are as many rows as
    there are ranges. Within a range rows pass one by one, each with its next.
    """
    spark = docs.sparkSession
    name = docs.schema[id]
    content = F.coalesce(F.col(text), F.lit(""))
    place = F.struct(F.col(id).isNull().alias("none"), F.bitwise_not(F.col(id).cast("bigint")).alias("at"), F.xxhash64(content).alias("hash"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx(F.col(id).cast("bigint"), [i / parts for i in range(1, parts)], max(ACCURACY, 10 * parts))
    bounds = sorted(set((docs.agg(quantiles).first()[0] if parts > 1 else None) or []))
    rows = docs.select(F.col(id).alias("id"), content.alias("text"), place.alias("place"), _bucket(F.col(id).cast("bigint"), bounds).alias("bucket"))
    heads = rows.groupBy("bucket").agg(F.min("place").alias("place")).sort("bucket").collect()  # a row per range
    sent = [(head.bucket, head.place, heads[i - 1].bucket) for i, head in enumerate(heads)]
    kinds = "bucket int, place struct<none boolean, at bigint, hash bigint>, before int"
    also = F.broadcast(spark.createDataFrame(sent, kinds).selectExpr("bucket", "place.at", "place.hash", "before"))
    rows = rows.select("id", "text", "bucket", "place.none", "place.at", "place.hash")
    same = (rows["bucket"] == also["bucket"]) & rows["at"].eqNullSafe(also["at"]) & (rows["hash"] == also["hash"])
    marked = rows.join(also, same, "left").select(rows["*"], also["before"])
    goes = F.array_compact(
        F.array(
            F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")),
            F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest"))),
        )
    )
    dealt = marked.select("id", "text", "none", "at", "hash", F.explode(goes).alias("go")).select("id", "text", "none", "at", "hash", "go.*")
    ranged = dealt.repartitionById(max(parts, 1), F.col("to")).sortWithinPartitions("guest", "none", "at", "hash")
    schema = T.StructType([T.StructField(id, name.dataType), *[T.StructField(n, kind()) for n, kind, _ in _COLUMNS]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, found, held, kind = None, False, [], 0, None

        def batch() -> pa.RecordBatch:
            types = (kind, *[t for _, _, t in _COLUMNS])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=schema.fieldNames())

        for rows in batches:
            kind = rows.schema.field(0).type
            for doc, content, guest in zip(rows.column(0), rows.column(1), rows.column(2), strict=True):
                if done:
                    continue
                now = _Document(doc.as_py(), content.as_py())
                if last is not None:
                    found.append(last.row(now))
                    held += 2000 + len(now.text)
                    if held >= BATCH_BYTES:
                        yield batch()
                        found, held = [], 0
                last, done = now, guest.as_py()  # the first guest is the next of the range's last row
        if found:
            yield batch()

    return ranged.select("id", "text", "guest").mapInArrow(judge, schema)
