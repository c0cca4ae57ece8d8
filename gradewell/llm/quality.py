"""Quality scores by Bradley-Terry ranking of labelled documents.

Every text becomes a short vector of rates (symbols, capitals, repeated words, repeated five-word
windows and so on). Preference pairs set a document labelled good before one labelled bad; logistic
loss on the difference of their features gives the weights, so a document's strength is a weighted
sum of its features. The threshold is the quantile of the labelled sample's strengths that misplaces
the fewest of its labels (of several, the one in the widest gap, so a few wrong labels don't move
it into the clean documents); the score is the logistic function of the strength above the threshold.

Fitting takes at most ``max_labelled`` labelled rows, those with the smallest hash of their id, and
``partners`` pairs for each. Scoring is a narrow pass over whole texts.

A null text is scored as the empty one. Labels that are null, or of ids that no document has, are
left out; repeated labels count each. With labels of one kind only, or none, all scores are 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE, bytes_of, give_back, runs, text_or_empty
from .wordscan import Words

SYMBOLS = b"!#$%&*|.,;:?<>{}()[]/\\@=+-_~^'\"`"


def features(texts: list[bytes]) -> np.ndarray:
    """One row of feature values per text, each between 0 and about 1."""
    found = Words(texts)
    n = len(texts)
    size = np.maximum(1, np.diff(found.at) - 1)
    words = np.diff(found.begin)
    per_word = np.maximum(1, words)

    def per_text(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[found.at[1:] - 1] - total[found.at[:-1]]

    def repeats(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Share of a text's entries that repeat an earlier one."""
        order = np.lexsort((hashes, doc))
        d, h = doc[order], hashes[order]
        again = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        return np.bincount(d[1:][again], minlength=n) / np.maximum(1, np.bincount(doc, minlength=n))

    data = found.data
    upper = per_text((data >= 65) & (data <= 90))
    lower = per_text((data >= 97) & (data <= 122))
    at, windows = found.windows(5)
    next_same = (found.hash[1:] == found.hash[:-1]) & (found.doc[1:] == found.doc[:-1])
    rates = [
        upper / np.maximum(1, upper + lower),
        per_text((data >= 48) & (data <= 57)) / size,
        per_text(data == 10) / size,
        *(per_text(data == s) / size for s in SYMBOLS),
        np.bincount(found.doc[1:][next_same], minlength=n) / per_word,
        repeats(found.doc, found.hash),
        repeats(found.doc[at], windows),
    ]
    length = np.bincount(found.doc, weights=found.stop - found.first, minlength=n) / per_word
    shape = [np.minimum(length, 30) / 30, np.log1p(words) / 20, words == 0]
    return np.column_stack([np.sqrt(np.column_stack(rates)), *shape]).astype(np.float64)


@dataclass
class Ranking:
    """strength = values @ weights; its logistic above ``threshold`` is the score."""

    weights: np.ndarray
    threshold: float

    def score(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.weights - self.threshold, -30, 30)))


def fit(values: np.ndarray, good: np.ndarray, partners: int = 16, ridge: float = 1e-5, steps: int = 50) -> Ranking:
    """Bradley-Terry weights by Newton steps on the pairs' logistic loss."""
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(best) or not len(worst):
        return Ranking(np.zeros(values.shape[1]), 0.0)
    draw = np.random.default_rng(0)
    winners = np.concatenate([np.repeat(best, partners), draw.choice(best, len(worst) * partners)])
    losers = np.concatenate([draw.choice(worst, len(best) * partners), np.repeat(worst, partners)])
    w = np.zeros(values.shape[1])
    for _ in range(steps):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for a in range(0, len(winners), 50_000):
            d = values[winners[a : a + 50_000]] - values[losers[a : a + 50_000]]
            lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = gradient - d.T @ lost / len(winners)
            hessian = hessian + (d * (lost * (1 - lost))[:, None]).T @ d / len(winners)
        move = np.linalg.solve(hessian, gradient)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    strength = values @ w
    order = np.argsort(strength, kind="stable")
    strength, ranked = strength[order], good[order]
    misplaced = np.cumsum(ranked)[:-1] + np.cumsum(~ranked[::-1])[::-1][1:]
    cuts = np.flatnonzero(misplaced == misplaced.min())
    k = cuts[np.argmax(strength[cuts + 1] - strength[cuts])]
    return Ranking(w, float(strength[k] + strength[k + 1]) / 2)


def held_out(id_col: str) -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, partners: int = 16,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Ranking:
    """Fit on a bounded sample of labelled documents that aren't held out."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    sample = (
        usable.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good"))
        .orderBy(F.xxhash64("id"), "id", "good").limit(max_labelled)
    )
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def measure(batches):
        give_back()
        for batch in batches:
            texts = bytes_of(batch)
            for a, b in runs([len(t) for t in texts], SLICE):
                values = features(texts[a:b])
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column("good"), pa.array(values.tolist())], names=["good", "v"])

    rows = texts.join(F.broadcast(sample), "id").select("good", "text").mapInArrow(measure, "good boolean, v array<double>").toArrow()
    width = features([b""]).shape[1]
    values = np.array(rows["v"].to_pylist(), dtype=np.float64).reshape(-1, width)
    return fit(values, np.array(rows["good"].to_pylist(), dtype=bool), partners)


def scores(spark: SparkSession, docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )

    def rate(batches):
        give_back()
        for batch in batches:
            score = score_texts(bytes_of(batch), ranking)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names
            )

    return rows.mapInArrow(rate, schema)


def score_texts(texts: list[bytes], ranking: Ranking) -> np.ndarray:
    parts = [ranking.score(features(texts[a:b])) for a, b in runs([len(t) for t in texts], SLICE)]
    return np.concatenate([np.zeros(0), *parts])


def accepted(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The documents that score 0.5 or more, with all their columns; a narrow pass."""

    def keep(batches):
        give_back()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(bytes_of(batch, text_col), ranking) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
