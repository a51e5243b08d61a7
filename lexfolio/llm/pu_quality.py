"""Quality classifier by positive-unlabelled learning.

Trusted positives are the learning documents labelled 1; the other learning documents are
unlabelled web text. A linear model on text statistics minimises the non-negative unbiased
risk  pi R+(1) + max(0, Ru(0) - pi R+(0))  with logistic loss; the class prior pi is
estimated from the learning labels. Every gradient is one aggregation over all learning
rows, whose features are computed once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexfolio.llm.common import batches_of, id_remainder
from lexfolio.session import materialize

FEATURES = (
    "log_words", "mean_word", "upper_share", "digit_share", "punctuation_share", "odd_share", "space_share", "distinct_words",
    "repeat_next", "top_word", "squeezed", "bare_words", "full_stops", "comma_share", "lines_per_word", "single_letter", "inner_capital",
    "end_mark_words", "symbol_end_words", "long_words", "line_words", "sentence_words",
)
_WORD_END = re.compile(r"[.,;:!?]+$")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
_COUNTED = [bytes(c) for c in (range(65, 91), range(48, 58))]


def features_of(text: str | None) -> list[float]:
    """Statistics of a whole text; all zero for a null or blank text."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    ascii_bytes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    kind = np.bincount(ascii_bytes, minlength=128)
    upper = sum(map(str.isupper, text)) if not text.isascii() else int(kind[65:91].sum())
    digits = int(kind[48:58].sum())
    usual = int(kind[[33, 39, 44, 45, 46, 58, 59, 63]].sum()) - (0 if text.isascii() else int(text.encode("ascii", "replace").count(b"?") - text.count("?")))
    odd = int(kind[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]].sum())
    spaces = int(kind[[9, 10, 13, 32]].sum())
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    raw = text.encode()
    sentences = len(_SENTENCE.findall(text))
    letters_end = sum(1 for w in words if w[-1].isalnum())
    mark_end = sum(1 for w in words if w[-1] in ".,;:!?")
    return [
        np.log1p(n), size / n, upper / size, digits / size, usual / size, odd / size, spaces / size, len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(counts.values()) / n, len(zlib.compress(raw, 1)) / (len(raw) + 32), letters_end / n,
        text.count(".") / n, text.count(",") / n, text.count("\n") / n, sum(len(w) == 1 for w in words) / n, sum(w[:1].isupper() for w in words) / n,
        mark_end / n, 1 - (letters_end + mark_end) / n, sum(len(w) > 12 for w in words) / n, np.log1p(n / (1 + text.count("\n"))), np.log1p(n / (1 + sentences)),
    ]


def add_features(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``features`` (array of floats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                values = np.array([features_of(t) for t in batch.column("text").to_pylist()], np.float32)
                column = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel(), pa.float32())
                )
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), column], [*names, "features"])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(run, f"{schema}features array<float>")


@dataclass
class QualityModel:
    """Standardising mean and scale, quadratic-free linear weights, bias, class prior."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised, clipped features, their squares and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate((z, z * z / 6, np.ones((len(z), 1))), axis=1)


def _gradients(rows: DataFrame, model: QualityModel) -> np.ndarray:
    """Sums over all rows: positives [n, loss as 0, gradient as 1, gradient as 0], unlabelled [n, loss as 0, gradient as 0]."""
    mean, scale, w = model.mean, model.scale, model.weights
    d = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * d + 2 + d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = expand(batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64), mean, scale)
            positive = np.array(batch.column("positive").to_pylist(), np.bool_)
            s = x @ w
            p = 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            loss0 = np.logaddexp(0, s)
            total[0] += positive.sum()
            total[1] += loss0[positive].sum()
            total[2 : 2 + d] += (p - 1)[positive] @ x[positive]
            total[2 + d : 2 + 2 * d] += p[positive] @ x[positive]
            total[2 + 2 * d] += len(s)
            total[3 + 2 * d] += loss0.sum()
            total[4 + 2 * d :] += p @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    out = np.zeros(2 + 2 * d + 2 + d)
    for r in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one number a coefficient
        out[r["i"]] = r["v"]
    return out


def fit(rows: DataFrame, prior: float, steps: int = 40, rate: float = 1.0, decay: float = 1e-4) -> QualityModel:
    """Non-negative PU risk over ``rows`` (features, positive); full-batch steps with Adam scaling.

    Where the negative part of the risk is below zero it counts as zero and has no gradient.
    The weights are the mean of the second half of the steps, which evens out the kink.
    """
    n = len(FEATURES)
    cells = F.posexplode("features")
    stats = {r["pos"]: r for r in rows.select(cells).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}
    mean = np.array([stats[i]["m"] if i in stats else 0.0 for i in range(n)])
    scale = np.array([max(stats[i]["s"] or 0.0, 1e-6) if i in stats else 1.0 for i in range(n)])
    d = 2 * n + 1
    model = QualityModel(mean, scale, np.zeros(d), prior)
    model.weights[-1] = np.log(prior / (1 - prior))
    first, second, mean_weights = np.zeros(d), np.zeros(d), np.zeros(d)
    for step in range(1, steps + 1):
        t = _gradients(rows, model)
        np_, l0p, g1p, g0p = max(t[0], 1), t[1], t[2 : 2 + d], t[2 + d : 2 + 2 * d]
        nu, l0u, g0u = max(t[2 + 2 * d], 1), t[3 + 2 * d], t[4 + 2 * d :]
        negative = l0u / nu - prior * l0p / np_
        g = prior * g1p / np_ + ((g0u / nu - prior * g0p / np_) if negative >= 0 else 0)
        g = g + decay * model.weights
        first, second = 0.9 * first + 0.1 * g, 0.95 * second + 0.05 * g * g
        pace = rate * 0.25 * min(1.0, 2 * (1 - (step - 1) / steps))
        model.weights = model.weights - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-8)
        if step > steps // 2:
            mean_weights += model.weights / (steps - steps // 2)
    model.weights = mean_weights
    return model


def score_features(rows: DataFrame, model: QualityModel) -> DataFrame:
    """Adds score in place of ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = [c for c in batch.schema.names if c != "features"]
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            score = 1 / (1 + np.exp(-np.clip(expand(x, m.mean, m.scale) @ m.weights, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    schema = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c != "features")
    return rows.mapInArrow(run, f"{schema}score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    ``labels`` (doc_id, quality) is read for learning rows only. A document with labels of
    both kinds is no trusted positive. Null and empty texts get a score as well. Without
    positives or learning rows every score is the prior (0.5 where there are no labels).
    """
    learn = F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False))
    marks = labels.filter(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("q")
    )
    rows = docs.select(F.col("doc_id").cast("long"), (~learn).alias("held_out"), "text")
    featured = materialize(add_features(rows).join(marks.select("doc_id", (F.col("q") == 1).alias("positive"), F.lit(True).alias("marked")), "doc_id", "left"), "quality")
    learned = featured.filter(~F.col("held_out")).select("features", F.coalesce("positive", F.lit(False)).alias("positive"), "marked")
    good, known = learned.agg(F.count_if("positive"), F.count_if("marked")).first()
    prior = min(0.98, max(0.02, good / known)) if known else 0.5
    model = fit(learned.drop("marked"), prior) if good else QualityModel(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES) + 1), prior)
    if not good:
        model.weights[-1] = np.log(prior / (1 - prior))
    return score_features(featured.select("doc_id", "held_out", "features"), model).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
