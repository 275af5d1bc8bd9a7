"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower-case letters and digits with single spaces. A benchmark item
is looked for by windows of ``WINDOW`` folded characters at every place, a shorter one
whole; so any copied passage of that length is found. Two strings within e edits
share at least n - q + 1 - q e of their q-grams, and these lie on diagonals (place in
the document minus place in the item) at most e apart; so shared q-grams are counted in
diagonal bands of width 2 (e + 1) that overlap by half. Regions of a band that reach
the bound are verified by alignment inside the band.

The benchmark is cut into blocks of bounded size that are sent to the tasks in turn;
documents are read where they lie, whole, and are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 8
WINDOW = 64  # about 11 words: the shortest passage of a longer item that is found
STEP = 1
EDIT_SHARE = 0.08
SHORTEST = Q  # folded characters; shorter items have no q-gram
BLOCK_CHARS = 1_000_000  # of items, per broadcast
FILTER_BITS = 22

MATCH = "struct<item_row:bigint,item_start:int,doc_start:int,doc_stop:int,edits:int>"
FIELDS = ("item_row", "item_start", "doc_start", "doc_stop", "edits")

_NOT_WORD = re.compile(r"[\W_]+")
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LATIN = bytes(i if chr(i).isalnum() else 32 for i in range(256))
_CELLS = 1 << 12  # of the count by item and diagonal


def fold(text: str | None) -> np.ndarray:
    """Code points of the text's lower-case letters and digits, one space between words."""
    text = (text or "").lower()
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return np.frombuffer(_NOT_WORD.sub(" ", text).strip().encode("utf-32-le", "replace"), np.uint32)
    return np.frombuffer(b" ".join(raw.translate(_LATIN).split()), np.uint8).astype(np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``Q`` = 8 code points."""
    if len(points) < Q:
        return np.empty(0, np.uint64)
    h = points.astype(np.uint64) + np.uint64(1)
    for width, p in zip((1, 2, 4), _P, strict=False):
        h = h[:-width] * p + h[width:]
        h ^= h >> np.uint64(31)
    return h * _P[3]


def budget(n: int) -> int:
    """Edits allowed in a window of ``n``: ``EDIT_SHARE``, or less where the lemma would ask for no q-gram."""
    return min(int(n * EDIT_SHARE), (n - Q) // Q)


@dataclass
class Index:
    """Items of one block and the places of their q-grams, sorted by hash."""

    rows: list[int]
    points: list[np.ndarray]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    sieve: np.ndarray
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray


def index(rows: list[tuple[int, str]]) -> Index:
    folded = [(row, fold(text)) for row, text in rows]
    folded = [(row, x) for row, x in folded if len(x) >= SHORTEST]
    hashes = [grams(x) for _, x in folded]
    every = np.concatenate([np.empty(0, np.uint64), *hashes])
    items = np.repeat(np.arange(len(folded)), [len(h) for h in hashes])
    places = np.concatenate([np.empty(0, np.int64), *[np.arange(len(h)) for h in hashes]])
    order = np.argsort(every, kind="stable")
    sieve = np.zeros(1 << FILTER_BITS, bool)
    sieve[every >> np.uint64(64 - FILTER_BITS)] = True
    sizes = np.array([min(WINDOW, len(x)) for _, x in folded], np.int64)
    budgets = np.array([budget(n) for n in sizes.tolist()], np.int64)
    rest = [r for r, _ in folded], [x for _, x in folded]
    return Index(*rest, every[order], items[order], places[order], sieve, sizes, budgets, sizes - Q + 1 - Q * budgets)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(edits, start, stop) of the part of ``text`` nearest to ``pattern`` on the diagonals ``low`` to ``high``.

    Cell d of a row is the diagonal low + d; a part may start and stop anywhere in the band.
    """
    width, far = high - low + 1, len(pattern) + 1
    diagonals = low + np.arange(width)
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    start = diagonals.copy()
    steps = np.arange(width)
    for i in range(len(pattern)):
        at = diagonals + i
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == pattern[i])
        best = np.where(inside, cost + ~same, far)
        source = steps.copy()
        skipped = np.append(cost[1:], far) + 1  # a pattern character that the text lacks
        take = skipped < best
        best, source = np.where(take, skipped, best), np.where(take, steps + 1, source)
        best = np.where((at + 1 >= 0) & (at + 1 <= len(text)), best, far)
        begun = start[np.minimum(source, width - 1)]
        run = np.minimum.accumulate(best - steps)  # text characters that the pattern lacks
        left = np.maximum.accumulate(np.where(best - steps == run, steps, 0))
        cost, start = np.minimum(run + steps, far), begun[left]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), int(diagonals[end] + len(pattern))


def least_edits(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edits between ``pattern`` and the part of ``text`` nearest to it, a column of the table per machine operation.

    Myers (1999): the differences down a column are two bit vectors.
    """
    rows: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        rows[c] = rows.get(c, 0) | 1 << i
    last, every = 1 << (len(pattern) - 1), (1 << len(pattern)) - 1
    up, down, score = every, 0, len(pattern)
    best = score
    for c in text.tolist():
        same = rows.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(diagonal | up)), diagonal & up
        score += bool(more & last) - bool(less & last)
        best = min(best, score)
        more, less = more << 1, less << 1
        up, down = every & (less | ~(diagonal | more)), more & diagonal & every
    return best


def verbatim(pattern: np.ndarray, text: np.ndarray, low: int, high: int) -> int | None:
    """The lowest diagonal on which ``pattern`` stands in ``text`` as it is."""
    first, last = max(low, 0), min(high, len(text) - len(pattern))
    if first > last:
        return None
    stands = (np.lib.stride_tricks.sliding_window_view(text, len(pattern))[first : last + 1] == pattern).all(axis=1)
    return first + int(stands.argmax()) if stands.any() else None


def matches(text: str | None, known: Index) -> list[tuple[int, int, int, int, int]]:
    """For each item with a window in the text: item, its place, the text's part, edits; places are in folded text."""
    points = fold(text)
    found = grams(points)
    at = np.flatnonzero(known.sieve[found >> np.uint64(64 - FILTER_BITS)])
    if not len(at):
        return []
    low = np.searchsorted(known.hashes, found[at], "left")
    n = np.searchsorted(known.hashes, found[at], "right") - low
    if not n.any():
        return []
    entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, place, spot = known.items[entry], known.places[entry], np.repeat(at, n)
    band = (spot - place) // (known.budgets[item] + 1)
    # a band holds the hits that begin in it or in the next; too few in both, with whatever falls into the same cells, are left out
    cell = (item * 61 + band) % _CELLS
    count = np.bincount(cell, minlength=_CELLS)
    least = known.bounds[item]
    enough = count[cell] + np.maximum(count[cell - 1], count[(cell + 1) % _CELLS]) >= least
    if not enough.any():
        return []
    item, place, band = item[enough], place[enough], band[enough]
    # a hit lies in two bands, the one it begins and the one before
    key = np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + (1 << 39)
    hit = np.concatenate([np.arange(len(item))] * 2)
    order = np.lexsort((place[hit], key))
    key, hit = key[order], hit[order]
    once = np.append(True, (key[1:] != key[:-1]) | (place[hit[1:]] != place[hit[:-1]]))
    key, hit = key[once], hit[once]
    # a window's q-grams of a band are as many places of the item, none further from the first than the window is long
    last = np.arange(len(key)) + known.bounds[item[hit]] - 1
    here = np.flatnonzero(last < len(key))
    last = last[here]
    near = (key[last] == key[here]) & (place[hit[last]] - place[hit[here]] <= known.sizes[item[hit[here]]] - Q)
    full = np.unique(key[here[near]])
    edges, stops = np.searchsorted(key, full, "left"), np.searchsorted(key, full, "right")
    result, done = [], set()
    for edge, stop in zip(edges, stops, strict=True):
        hits = hit[edge:stop]
        i = int(item[hits[0]])
        if i in done:
            continue
        lowest = int((key[edge] % (1 << 40) - (1 << 39)) * (known.budgets[i] + 1))
        limits = int(known.sizes[i]), int(known.budgets[i]), int(known.bounds[i])
        made = _verify(points, known.points[i], place[hits], lowest, *limits)
        if made:
            done.add(i)
            result.append((known.rows[i], *made))
    return result


def _verify(
    points: np.ndarray, pattern: np.ndarray, places: np.ndarray, lowest: int, size: int, edits: int, bound: int
) -> tuple[int, int, int, int] | None:
    """The first window of an item that a band's q-grams and then the alignment confirm."""
    starts = np.arange(0, len(pattern) - size + 1, STEP)
    first = np.searchsorted(places, starts, "left")
    stop = np.searchsorted(places, starts + size - Q, "right")
    for at in starts[stop - first >= bound].tolist():
        span = 2 * (edits + 1) - 1
        begin = max(0, at + lowest - edits)
        part = points[begin : at + size + lowest + span + edits]
        if not len(part):
            continue
        shift = at + lowest - begin
        window, low, high = pattern[at : at + size], shift - edits, shift + span + edits
        copy = verbatim(window, part, low, high)
        if copy is not None:
            return at, begin + copy, begin + copy + size, 0
        if least_edits(window, part) > edits:  # nor then within the band
            continue
        cost, a, b = align(window, part, low, high)
        if cost <= edits:
            return at, begin + max(a, 0), begin + b, cost
    return None


def _blocks(benchmark: DataFrame, text: str) -> Iterator[Index]:
    """Indexes over the numbered items, each of about ``BLOCK_CHARS`` characters."""
    total = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for block in range(n):
        yield index([tuple(r) for r in benchmark.where(F.pmod("item_row", F.lit(n)) == block).select("item_row", text).collect()])


def matcher(spark, known: Index) -> Column:
    """Function of a text column: its matches with the items of one block."""
    sent = spark.sparkContext.broadcast(known)  # bounded by BLOCK_CHARS

    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(FIELDS, m, strict=True)) for m in matches(t, sent.value)] for t in batch])

    return F.pandas_udf(search, f"array<{MATCH}>")


def _numbered(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Items with a text and a number made of both, so that equal rows are one."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("item_id"), F.col(text).alias("item_text"))
    return rows.distinct().withColumn("item_row", F.xxhash64("item_id", "item_text"))


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, item_start, doc_start, doc_stop, edits): documents that hold a window of an item.

    One row per document and item, its first confirmed window; places count folded
    characters. Null and empty texts, items under ``SHORTEST`` folded characters and
    empty tables give nothing; rows that share an id, or have none, are judged each by
    itself; equal items are one; other columns are ignored.
    """
    spark = docs.sparkSession
    items = _numbered(benchmark, item, item_text)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    found = rows.where(F.lit(False)).select("_id", F.lit(None).cast(MATCH).alias("m"))
    for known in _blocks(items, "item_text"):
        found = found.unionByName(rows.select("_id", F.explode(matcher(spark, known)("_text")).alias("m")))
    named = found.select("_id", "m.*").join(items.select("item_row", "item_id"), "item_row")
    return named.select(F.col("_id").alias(id), F.col("item_id").alias(item), "item_start", "doc_start", "doc_stop", "edits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns, unshuffled."""
    clean = docs
    for known in _blocks(_numbered(benchmark, item, item_text), "item_text"):
        clean = clean.where(F.size(matcher(docs.sparkSession, known)(F.col(text))) == 0)
    return clean
