"""Quality classifier learned from trusted positives and unlabelled text.

The non-negative unbiased risk of Kiryo et al. (2017): with class prior p, the risk of
calling unlabelled text bad, less p times that of calling positives bad, estimates the
risk on the bad texts alone; as it cannot be negative, a step that would push it below
zero goes the other way. The model is a small network on counts of characters, pairs
of character classes, words and lines of the whole text. It is fitted on a bounded
sample, chosen by a hash of the id, and applied to every row where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000  # rows of either kind that the model is fitted on, at most
ACCEPTED = 0.7  # score from which a text is taken as good
HIDDEN = 24
STEPS = 1200
BATCH = 512
RATE = 0.01
DECAY = 1e-4
MODELS = 3  # fitted from different starts; scores are their mean
LIMITS = (0.02, 0.98)  # of an estimated prior

_KINDS = 14


def _classes() -> np.ndarray:
    """Class of each byte: letters, digits, white space, marks of several kinds, bytes beyond ASCII."""
    kind = np.full(256, _KINDS - 1, np.uint8)
    groups = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",;:", "!?", "#$%&*@^~=+_", "|", "<>{}[]()/\\", "'\"-`")
    for i, group in enumerate(groups):
        kind[list(group.encode())] = i
    return kind


_CLASS = _classes()
N_FEATURES = 2 * _KINDS + _KINDS * _KINDS + 10


def features(text: str | None) -> np.ndarray:
    """Shares, numbers and sizes that describe a text; all are 0 for an empty one.

    A few odd marks in a short text are a small share of it, but a number like in any other.
    """
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(N_FEATURES, np.float32)
    if not raw:
        return out
    kind = _CLASS[np.frombuffer(raw, np.uint8)]
    counts = np.bincount(kind, minlength=_KINDS)
    out[:_KINDS] = counts / len(raw)
    pairs = kind[:-1].astype(np.int64) * _KINDS + kind[1:]
    out[_KINDS : _KINDS + _KINDS * _KINDS] = np.bincount(pairs, minlength=_KINDS * _KINDS) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    long_lines = [x for x in lines if len(x) >= 20]
    n = max(1, len(words))
    out[_KINDS + _KINDS * _KINDS : -10] = np.log1p(counts)
    out[-10:] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        len(raw) / n / 10,
        len(set(words)) / n,
        max(map(len, words), default=0) / 100,
        len(set(long_lines)) / max(1, len(long_lines)),
        np.log1p(len(raw) / len(lines)),
        len(set(words)) / n**0.7 / 4,
        sum(map(eq, words, words[1:])) / n,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.layers(self.standard(x))[1]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def layers(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.maximum(z @ w1 + b1, 0)
        return hidden, hidden @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


@dataclass
class Ensemble:
    models: list[Model]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.mean([m.score(x) for m in self.models], axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 3) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss."""
    rng = np.random.RandomState(seed)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    n = unlabelled.shape[1]
    weights = [rng.randn(n, HIDDEN) / np.sqrt(n), np.zeros(HIDDEN), rng.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    weights = [w.astype(np.float32) for w in weights]
    model = Model(mean, scale, weights)
    p_all, u_all = model.standard(positive), model.standard(unlabelled)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        p = p_all[rng.randint(len(p_all), size=min(BATCH, len(p_all)))]
        u = u_all[rng.randint(len(u_all), size=min(BATCH, len(u_all)))]
        (hp, fp), (hu, fu) = model.layers(p), model.layers(u)
        bad = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()  # risk on the bad texts
        d_bad_u, d_bad_p = _sigmoid(fu) / len(fu), -prior * _sigmoid(fp) / len(fp)
        if bad >= 0:
            d_p, d_u = -prior * _sigmoid(-fp) / len(fp) + d_bad_p, d_bad_u
        else:
            d_p, d_u = -d_bad_p, -d_bad_u
        x, h, d = np.vstack([p, u]), np.vstack([hp, hu]), np.concatenate([d_p, d_u])
        back = np.outer(d, weights[2]) * (h > 0)
        grads = [x.T @ back + DECAY * weights[0], back.sum(axis=0), h.T @ d + DECAY * weights[2], np.array([d.sum()])]
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def scorer(model: Ensemble | None) -> Column:
    """Function of a text column: the score of whole texts, 0.5 if nothing could be learned."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            if model is None:
                yield pd.Series(np.full(len(batch), 0.5))
            else:
                x = np.stack([features(t) for t in batch]) if len(batch) else np.zeros((0, N_FEATURES))
                yield pd.Series(model.score(x).astype(np.float64))

    return F.pandas_udf(score, "double")


def _featured(rows: DataFrame, text: str) -> np.ndarray:
    """Features of a bounded number of rows."""

    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t).tolist() for t in batch])

    found = rows.select(F.pandas_udf(measure, "array<float>")(text).alias("x")).collect()
    return np.array([r.x for r in found], np.float64).reshape(-1, N_FEATURES)


def held_out(id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds == fold


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Ensemble | None:
    """Fit on rows that are not held out: texts labelled 1, and texts whatever their label.

    The prior is the share of 1 among the labelled rows. At most ``sample`` rows of
    either kind are taken, those with the smallest hash of the id. None if there is no
    row of a kind. Null labels, ids and texts teach nothing.
    """
    usable = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    usable = usable.where(~held_out(F.col("id"))).withColumn("order", F.xxhash64("id"))
    marked = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("id"))
    marked = marked.agg(F.max(label).alias("label")).where(~held_out(F.col("id")))
    share = marked.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    total = usable.count()
    if not share or not total:
        return None
    prior = min(max(share, LIMITS[0]), LIMITS[1])
    trusted = marked.where(F.col("label") == 1).select("id", F.xxhash64("id").alias("order"))
    chosen = trusted.orderBy("order", "id").limit(sample)
    positive = usable.drop("order").join(F.broadcast(chosen.select("id")), "id")  # at most ``sample`` ids
    # the limit is met by a share of the rows a little above it, so texts beyond it are not sorted
    near = F.pmod(F.col("order"), F.lit(1_000_003)) < 1_000_003 * min(1.0, 1.3 * sample / total + 1e-3)
    unlabelled = usable.where(near).orderBy("order", "id").limit(sample)
    x_p, x_u = _featured(positive, "text"), _featured(unlabelled, "text")
    return Ensemble([fit(x_p, x_u, prior, seed) for seed in range(MODELS)]) if len(x_p) and len(x_u) else None


def score_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Every row of ``docs`` as ``row`` with its ``score`` in 0 to 1.

    Null texts are scored as empty ones, repeated rows get equal scores, other columns
    pass through inside ``row``; without anything to learn from every score is 0.5.
    """
    model = train(docs, labels, sample, id, text, label)
    return docs.select(F.struct(*docs.columns).alias("row"), scorer(model)(F.col(text)).alias("score"))


def good_only(docs: DataFrame, labels: DataFrame, accepted: float = ACCEPTED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``accepted``; all if nothing could be learned."""
    model = train(docs, labels, SAMPLE, id, text)
    return docs if model is None else docs.where(scorer(model)(F.col(text)) >= accepted)
