"""Ranked lexical search with hashed max-sketches.

The index holds, for blocks of documents, every document's terms with their numbers of
occurrences, and its sketch: the terms are folded by hash into a few coordinates, each
holding the largest number of occurrences that fell into it. Within a document a term's
impact grows with its occurrences, so these maxima are maxima of impact whatever the
corpus' mean length turns out to be. Every document is folded by three parts of the
hash, and a term can have no more than the least of its three maxima. Looking a query's
terms up in all sketches of a block gives every document a bound that its score cannot
pass. Documents are then scored
exactly in falling order of their bounds until the next bound is below the k-th best
score that the task knows; so what is left out cannot be among the best k.

Terms are compared by 64-bit hashes, scores are whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collabnet.session import stored, union_all

K = 50
BLOCK_DOCS = 1024
BLOCK_TERMS = 20_000  # entries of (document, term) of a row of the index: small rows spare the JVM huge arrays
SEARCHED = 5  # rows of the index searched together
ROOM = 4  # coordinates of a fold for each distinct term of a document, at least
LEAST = 64  # coordinates of a fold
FOLDS = 3  # a term counts at most the least of its maxima
FOLD_BITS = 21  # of the hash for each fold
QUERY_TERMS = 100_000  # of a block of queries
RESCORED = 32  # documents scored exactly at a time
SALTS = 32

MILLI, SCALE, LENGTH_UNIT, LENGTH_SHARE = 1000, 1_000_000_000, 20, 50  # fixed values of the scoring rule

_REMEMBERED = 200_000
_TERM_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM_BYTES else 0x20 for b in range(256))

CODEC = "zstd"  # of occurrences and sketches, which are mostly ones and zeros

INDEX = "ids binary, sizes binary, starts binary, terms binary, tfs binary, widths binary, sketches binary"


class _TermHashes(dict):
    def __missing__(self, term: bytes) -> int:
        made = xxhash.xxh64_intdigest(term)
        if len(self) < _REMEMBERED and len(term) <= 32:
            self[term] = made
        return made


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A to Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split(b" ") if text else []


def counted(text: str | None, hashes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes of a text, sorted, and their occurrences."""
    found = Counter(terms_of(text))
    found.pop(b"", None)
    n = len(found)
    terms = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    tfs = np.fromiter(found.values(), np.int64, n)
    order = np.argsort(terms)
    return terms[order], tfs[order]


def width_of(n_terms: int) -> int:
    """Coordinates of each fold of a document: a power of two with room for its distinct terms."""
    return min(max(LEAST, 1 << max(ROOM * n_terms - 1, 0).bit_length()), 1 << FOLD_BITS)


def coordinates(terms: np.ndarray, width: int, fold: int) -> np.ndarray:
    return ((terms >> np.uint64(fold * FOLD_BITS)) & np.uint64(width - 1)).astype(np.int64)


def sketch(terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Largest number of occurrences by coordinate, fold after fold; 255 stands for 255 and more."""
    out = np.zeros((FOLDS, width_of(len(terms))), np.uint8)
    low = np.minimum(tfs, 255).astype(np.uint8)
    for fold in range(FOLDS):
        np.maximum.at(out[fold], coordinates(terms, out.shape[1], fold), low)
    return out


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, a row per block of documents; rows without an id are left out."""
    names = [part.split()[0] for part in INDEX.split(", ")]

    def flush(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sketches = [sketch(terms, tfs) for _, terms, tfs in held]
        parts = (
            np.array([doc for doc, _, _ in held], "<i8"),
            np.array([tfs.sum() for _, _, tfs in held], "<i8"),
            np.cumsum([0, *[len(terms) for _, terms, _ in held]]).astype("<i8"),
            np.concatenate([terms for _, terms, _ in held]).astype("<u8"),
            pa.compress(np.concatenate([tfs for _, _, tfs in held]).astype("<u4").tobytes(), CODEC, asbytes=True),
            np.array([s.shape[1] for s in sketches], "<i8"),
            pa.compress(np.concatenate([s.ravel() for s in sketches]).tobytes(), CODEC, asbytes=True),
        )
        return pa.RecordBatch.from_arrays([pa.array([p if isinstance(p, bytes) else p.tobytes()], pa.binary()) for p in parts], names=names)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hashes = [], 0, _TermHashes()
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, *counted(content.as_py(), hashes)))
                size += len(held[-1][1])
                if size >= BLOCK_TERMS or len(held) == BLOCK_DOCS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    rows = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(collect, INDEX)


def _arrays(batch: pa.RecordBatch, row: int, *kinds: str) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(i)[row].as_py(), kind) for i, kind in enumerate(kinds)]


def lengths(index: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all terms with repeats."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (sizes,) = _arrays(batch, i, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], names=["n", "total"])

    row = index.select("sizes").mapInArrow(add, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of ``terms`` (sorted hashes, of one block of queries) occurs."""
    sent = index.sparkSession.sparkContext.broadcast(terms)  # bounded by QUERY_TERMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        df = np.zeros(len(asked) + 1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                (here,) = _arrays(batch, i, "<u8")
                at = np.searchsorted(asked, here)
                at[asked[np.minimum(at, len(asked) - 1)] != here] = len(asked)
                df += np.bincount(at, minlength=len(df))
        found = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for row in index.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            out[row.term] = row.df
    sent.unpersist()
    return out


class Queries(NamedTuple):
    """A block of queries: query j asks ``terms[which[starts[j]:starts[j + 1]]]``."""

    ids: np.ndarray
    starts: np.ndarray
    which: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def term_weight(n: int, df: int) -> int:
    return floor(MILLI * log((2 * n + 2) / (2 * df + 1)))


def length_norms(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * sizes * n) // max(total, 1)


def impacts(tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return SCALE * tfs // (MILLI * tfs + LENGTH_UNIT * norms)


def query_blocks(queries: DataFrame, id: str, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, which, terms) of blocks of queries, each of about ``QUERY_TERMS`` terms, read one after the other."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _TermHashes()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = counted(content.as_py(), hashes)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name, np.int64)), pa.array(found)], names=["query", "term"])

    rows = queries.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("query"), F.col(text).alias("text"))
    asked = stored(rows.mapInArrow(split, "query bigint, term bigint").distinct())
    blocks = -(-asked.count() // QUERY_TERMS)
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()
        names, terms = own.column("query").to_numpy(), own.column("term").to_numpy().view(np.uint64)
        order = np.lexsort((terms, names))
        ids, starts = np.unique(names[order], return_index=True)
        distinct, which = np.unique(terms[order], return_inverse=True)
        yield ids, np.append(starts, len(order)), which, distinct


class _Best:
    """The k best of one query so far: higher scores first, of equal ones the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.empty(0, np.int64), np.empty(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def unpacked(batch: pa.RecordBatch, row: int) -> list[np.ndarray]:
    """ids, sizes, starts, terms, tfs, widths and sketches of a row of the index."""
    ids, sizes, starts, terms = _arrays(batch, row, "<i8", "<i8", "<i8", "<u8")
    widths = np.frombuffer(batch.column(5)[row].as_py(), "<i8")
    raw = lambda column, size: pa.decompress(batch.column(column)[row].as_py(), size, CODEC, asbytes=True)
    tfs = np.frombuffer(raw(4, 4 * int(starts[-1])), "<u4")
    return [ids, sizes, starts, terms, tfs, widths, np.frombuffer(raw(6, FOLDS * int(widths.sum())), np.uint8)]


def joined(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Several rows as one."""
    columns = list(zip(*rows, strict=True))
    ends = np.cumsum([0, *[starts[-1] for starts in columns[2]]])
    starts = np.concatenate([[0], *[s[1:] + at for s, at in zip(columns[2], ends, strict=False)]])
    return [starts if i == 2 else np.concatenate(c) for i, c in enumerate(columns)]


class Block:
    """Rows of the index, ready to be searched."""

    def __init__(self, arrays: list[np.ndarray], n: int, total: int):
        self.ids, sizes, self.starts, self.terms, self.tfs, widths, sketches = arrays
        self.norms = length_norms(sizes, n, total)
        occurrences = np.arange(256)
        ends = FOLDS * np.cumsum(widths)
        #: By sketch width: the documents and, for each fold, a row per coordinate with the largest impacts.
        self.maxima = []
        for width in np.unique(widths).tolist():
            docs = np.flatnonzero(widths == width)
            most = np.empty((len(docs), FOLDS * width), np.float32)
            for row, d in zip(most, docs, strict=True):
                by_number = np.where(occurrences == 255, SCALE // MILLI, impacts(occurrences, self.norms[d]))
                row[:] = by_number[sketches[ends[d] - FOLDS * width : ends[d]]]
            self.maxima.append((docs, width, np.ascontiguousarray(most.T).reshape(FOLDS, width, -1)))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document's score passes."""
        out = np.zeros(len(self.ids))
        for docs, width, most in self.maxima:
            least = most[0][coordinates(terms, width, 0)]
            for fold in range(1, FOLDS):
                np.minimum(least, most[fold][coordinates(terms, width, fold)], out=least)
            out[docs] = weights @ least.astype(np.float64)  # impacts are whole and below 2^24
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores."""
        out = np.empty(len(docs), np.int64)
        for i, d in enumerate(docs):
            own = self.terms[self.starts[d] : self.starts[d + 1]]
            at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
            hit = own[at] == terms if len(own) else np.zeros(len(terms), bool)
            tfs = self.tfs[self.starts[d] + at[hit]].astype(np.int64)
            out[i] = weights[hit] @ impacts(tfs, self.norms[d])
        return out

    def search(self, best: _Best, terms: np.ndarray, weights: np.ndarray) -> None:
        bounds = self.bounds(terms, weights)
        docs = np.flatnonzero(bounds >= best.least)
        docs = docs[np.argsort(-bounds[docs], kind="stable")]
        for at in range(0, len(docs), RESCORED):
            some = docs[at : at + RESCORED]
            if bounds[some[0]] < best.least:
                break
            found = self.scores(some, terms, weights)
            best.add(found[found > 0], self.ids[some][found > 0])


def search(
    docs: DataFrame, queries: DataFrame, k: int = K, id: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """(query, rank, id, score): the ``k`` documents with the highest scores above 0 of each query, equal ones by id.

    Null and empty texts have no terms: such a document counts for nothing and such a
    query has no row. Rows without an id are left out, on either side. Queries that
    share an id are one query with all their terms, documents that share an id are
    documents of their own. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    index = stored(build(docs, id, text))
    n, total = lengths(index)
    found = []
    for ids, starts, which, terms in query_blocks(queries, query, query_text):
        if not len(ids):  # no query fell into this block
            continue
        weights = np.array([term_weight(n, df) for df in document_counts(index, terms).tolist()], np.int64)
        found.append(_search_block(spark, index, Queries(ids, starts, which, terms, weights), n, total, k))
    if not found:
        return spark.createDataFrame([], f"{query} bigint, rank int, {id} bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    salted = Window.partitionBy("query", "salt").orderBy(F.col("score").desc(), "id")
    rows = union_all(found).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    rows = rows.withColumn("at", F.row_number().over(salted)).where(F.col("at") <= k)  # each task brings up to k rows a query
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query), "rank", F.col("id").alias(id), "score")


def _search_block(spark: SparkSession, index: DataFrame, block: Queries, n: int, total: int, k: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)  # bounded by QUERY_TERMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        asked = [q.which[a:b] for a, b in zip(q.starts, q.starts[1:], strict=False)]
        asked = [(q.terms[at], q.weights[at]) for at in asked]
        best = [_Best(k) for _ in q.ids]
        for batch in batches:
            for i in range(0, batch.num_rows, SEARCHED):
                rows = [unpacked(batch, j) for j in range(i, min(i + SEARCHED, batch.num_rows))]
                here = Block(joined(rows), n, total)
                for kept, (terms, weights) in zip(best, asked, strict=True):
                    here.search(kept, terms, weights)
        columns = [np.repeat(q.ids, [len(b.ids) for b in best]), np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query", "id", "score"])

    return index.mapInArrow(run, "query bigint, id bigint, score bigint")
