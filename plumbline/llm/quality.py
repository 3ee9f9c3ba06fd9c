"""A quality classifier from positive and unlabelled texts.

Trusted positives P and unlabelled texts U are all it learns from. With the share ``prior`` of positives in U,
the risk on negatives is what U costs as negatives less what positives would cost there; it cannot be below
zero, so where the estimate is, the step goes the other way until it is not (non-negative unbiased risk).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import column_field, narrowed, stored

_GROUPS = [
    (range(97, 123)), (range(65, 91)), (range(48, 58)), (32,), (10,), b"#*$%&|<>", b"!?", b".,;:", b"'\"()[]{}-_/\\+=@^~`", range(128, 256), range(0, 9),
]
_GROUP_OF = np.zeros((256, len(_GROUPS)))
for _k, _group in enumerate(_GROUPS):
    _GROUP_OF[list(_group), _k] = 1
N_FEATURES = len(_GROUPS) + 10


def features(text: str | None) -> np.ndarray:
    """Shape of a whole text, in numbers that do not depend on its language's words; zeros for an empty or null text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = counts.sum()
    share = counts[counts > 0] / n
    words = text.split()
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    out[: len(_GROUPS)] = np.sqrt(counts @ _GROUP_OF / n)
    rest = out[len(_GROUPS) :]
    rest[0] = -(share * np.log2(share)).sum()
    rest[1] = np.log1p(len(words))
    if words:
        triples = list(zip(words, words[1:], words[2:]))
        rest[2] = np.log1p(n / len(words))
        rest[3] = len(set(words)) / len(words)
        rest[4] = len(set(triples)) / len(triples) if triples else 1.0
        rest[5] = Counter(words).most_common(1)[0][1] / len(words)
        rest[6] = sum(w.isupper() for w in words) / len(words)
        rest[7] = sum(w[-1].isalnum() for w in words) / len(words)
    if lines:
        rest[8] = len(set(lines)) / len(lines)
        rest[9] = np.log1p(n / len(lines))
    return out


@dataclass
class Model:
    """A network with one hidden layer over scaled features; its output is the score of a positive."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.weights, self.scaled(x))[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(weights, x):
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, rounds: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative risk with logistic loss by full-batch Adam.

    Without positives or without unlabelled texts the scores are ``prior`` throughout.
    """
    rows = np.vstack([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, N_FEATURES))
    mean, scale = rows.mean(0), rows.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.3, (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(())]
    model = Model(mean, scale, weights, prior)
    if not len(positive) or not len(unlabelled):
        share = min(max(prior, 1e-6), 1 - 1e-6)
        model.weights = [weights[0] * 0, weights[1], weights[2] * 0, np.array(np.log(share / (1 - share)))]
        return model
    p, u = model.scaled(positive), model.scaled(unlabelled)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        h_p, z_p = _forward(weights, p)
        h_u, z_u = _forward(weights, u)
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        softplus = lambda z: np.logaddexp(0, z)
        negative_risk = softplus(z_u).mean() - prior * softplus(z_p).mean()
        # Slopes of the two parts of the risk by the outputs on P and U.
        on_p, on_u = prior * (s_p - 1) / len(p), s_u / len(u)
        if negative_risk >= 0:
            on_p = on_p - prior * s_p / len(p)
        else:
            on_p, on_u = prior * s_p / len(p), -on_u
        slopes = [np.zeros_like(w) for w in weights]
        for x, h, g in ((p, h_p, on_p), (u, h_u, on_u)):
            back = np.outer(g, weights[2]) * (1 - h**2)
            for k, part in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum())):
                slopes[k] = slopes[k] + part
        for k, slope in enumerate(slopes):
            slope = slope + decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.weights = weights
    return model


def _drawn(docs: DataFrame, most: int, total: int):
    """A test that holds for about ``most`` of ``total`` rows, by a hash of the id and the text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) < F.lit(int(min(1.0, most / max(1, total)) * 1_000_003))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 10_000, unlabelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from about ``positives`` rows labelled 1 and ``unlabelled`` rows of all documents, whole texts.

    Labels enter only as trusted positives and in the class prior, estimated as the share of ones among all
    labelled rows given. An id with contradicting labels counts as half a positive in the prior and is no
    positive; null labels and ids count for nothing. Both samples are bounded by the parameters, at any
    corpus size, and their features are what the driver sees.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    given = narrowed(labels, doc_id=id_col, label=label_col).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    given = given.groupBy("doc_id").agg(F.avg("label").alias("label"))
    count, share, sure = given.agg(F.count("*"), F.avg("label"), F.count_if(F.col("label") == 1)).first()
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(min(1.0, positives / max(1, sure)) * 1_000_003))
    trusted = given.filter((F.col("label") == 1) & chosen).select("doc_id")
    sample = stored(_featured(rows.filter(_drawn(rows, unlabelled, rows.count())), 0).unionAll(_featured(rows.join(F.broadcast(trusted), "doc_id"), 1)), "quality-sample")
    table = sample.toPandas()
    matrix = np.array(table["x"].tolist(), float).reshape(-1, N_FEATURES)
    mark = table["positive"].to_numpy() == 1
    # In a stored order, so that the same rows give the same model.
    sort = lambda part: part[np.lexsort(part.T)] if len(part) else part
    return train(sort(matrix[mark]), sort(matrix[~mark]), float(share) if count else 0.5)


def _featured(rows: DataFrame, positive: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), pa.array([positive] * len(found), pa.int32())], names=["x", "positive"])

    return rows.select("text").mapInArrow(run, "x array<double>, positive int")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; the score is made from the text alone, null and empty texts alike."""
    source = narrowed(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([column_field(source, "doc_id"), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return source.mapInArrow(run, schema)
