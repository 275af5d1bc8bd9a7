"""Language identification with a string kernel.

Two texts are compared by the runs of one to three characters that occur in both
(presence, not number), over the geometric mean of how many each has. Landmarks taken
from every language map a text to its kernel values with them (Nyström); one ridge
regression per language on that map gives its score. Texts are scored in batches:
presence matrix x landmarks, then x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANDMARKS = 24  # texts of each language
EXAMPLES = 300  # texts of each language that the regression is fitted on, at most
RUNS = 3
BITS = 15  # runs are hashed to so many bits
RIDGE = 1e-3
SHARPNESS = 6.0
BATCH = 64
UNKNOWN = "und"

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.uint64(64 - BITS)
_PLAIN = np.array([i if chr(i).isalpha() else 32 for i in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def runs(text: str) -> np.ndarray:
    """Hashes of the runs of characters of a lower-cased text; ASCII marks and digits are spaces."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = points < 128
    points = np.where(low, _PLAIN[np.where(low, points, 0)], points).astype(np.uint64)
    parts, h = [], points
    for n in range(RUNS):
        if n:
            h = h[:-1] * _P[0] + points[n:]
        parts.append((h + np.uint64(n)) * _P[1] >> _SHIFT)
        if len(h) < 2:
            break
    return np.concatenate(parts)


def presence(texts: list[str]) -> np.ndarray:
    """One row per text: which runs it has."""
    rows = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, text in enumerate(texts):
        rows[i, runs(text)] = 1
    return rows


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence, one row each
    coefficients: np.ndarray  # landmark x language

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks) @ self.coefficients


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))
    return rows @ landmarks.T / sizes


def fit(rows: np.ndarray, languages: list[str]) -> Model:
    """Landmarks are the first texts of each language; all texts are examples."""
    names = sorted(set(languages))
    tags = np.array([names.index(x) for x in languages])
    first = np.concatenate([np.flatnonzero(tags == i)[:LANDMARKS] for i in range(len(names))])
    landmarks = rows[first]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    mapped = kernel(rows, landmarks) @ root
    targets = np.where(tags[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(tags)[tags][:, None]  # languages count alike, however many examples they have
    gram = mapped.T @ (mapped * weight) + RIDGE * np.eye(len(landmarks))
    return Model(names, landmarks, (root @ np.linalg.solve(gram, mapped.T @ (targets * weight))).astype(np.float32))


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; the score is the softmax of the regressions."""
    names, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
    for at in range(0, len(known), BATCH):
        some = known[at : at + BATCH]
        raw = SHARPNESS * model.scores(presence([texts[i] for i in some]))
        odds = np.exp(raw - raw.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        for i, b in zip(some, best, strict=True):
            names[i] = model.languages[b]
        sure[some] = odds.max(axis=1) / odds.sum(axis=1)
    return names, sure


def predictor(model: Model | None) -> Column:
    """Function of a text column: struct of lang_pred and score."""

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, sure = predict(batch.tolist(), model)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": sure})

    return F.pandas_udf(judge, "lang_pred string, score double")


def held_out(id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on at most ``EXAMPLES`` texts of each language, by hash of the id, none of them held out.

    Rows with a null id, text or language, or a text without a letter, teach nothing;
    None if no other is left.
    """
    usable = docs.where(F.col(id).isNotNull() & F.col(lang).isNotNull() & F.rlike(text, F.lit(r"\p{L}")) & ~held_out(F.col(id)))
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id).alias("order"))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # thin out first, so that the ranking of a frequent language meets few rows
    thin = F.pmod("order", F.lit(1_000_003)) < 1_000_003 * (F.lit(1.5 * EXAMPLES) / F.col("n") + 10 / F.col("n"))
    near = usable.select("lang", "order").join(F.broadcast(counts), "lang").where(thin)  # a row per language
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
    chosen = ranked.where(F.col("place") <= EXAMPLES).select("lang", "order", "place").distinct()

    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.packbits(presence([x])[0] > 0).tobytes() for x in batch])

    bounded = F.broadcast(chosen)  # EXAMPLES rows per language
    found = usable.join(bounded, ["lang", "order"]).select("lang", "place", F.pandas_udf(pack, "binary")("text").alias("bits")).collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r.lang, r.place, r.bits))
    rows = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in found]).astype(np.float32)
    return fit(rows, [r.lang for r in found])


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row of ``docs`` as ``row`` with lang_pred and score (0 to 1).

    A null text or one without a letter is ``und`` with score 0, as is every text if
    there was nothing to learn from. Equal rows are judged alike, other columns pass
    inside ``row``, an empty table gives no rows.
    """
    judged = docs.select(F.struct(*docs.columns).alias("row"), predictor(train(docs, id, text, lang))(F.col(text)).alias("p"))
    return judged.select("row", "p.lang_pred", "p.score")
