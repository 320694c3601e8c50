"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a short vector of ratios (upper case, symbols, marks, digits, repeated and distinct words, ...)
whose square roots' arc sines and logarithms are close to normal within a class.  The fit needs only the count, the sum
and the sum of outer products of each class, which Spark adds up over all labelled rows; means, shrunken covariances and
their Cholesky factors follow on the driver from these few numbers.  A score is the logistic function of the
difference of the two log densities, from one triangular product per class with the inverse factors kept in the model.

Defined cases: a null or empty text has the vector of an empty text; a label row that is null, or of a document that is
not there, is ignored; repeated label rows count as often as they stand; with labels of one class only
every score is that class, with none it is 0.5.  Columns other than the id, the text
and the label are never read by the score, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

NAMES = ("words", "word_length", "upper", "symbols", "marks", "stops", "digits", "adjacent", "repeated", "lines", "beyond_ascii")
_UPPER, _LOWER = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_CLASSES = np.stack([_UPPER, _LOWER] + [np.isin(np.arange(256), list(s)).astype(float) for s in (b"#*$%&|<>@^~=_", b"!?", b".,;:", b"0123456789")] + [(np.arange(256) >= 192).astype(float)], axis=1)


def statistics(text: str | None) -> list[float]:
    """The vector of one whole text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    upper, lower, symbols, marks, stops, digits, wide = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    words = text.split()
    n = len(words)
    # a few counts are added below the line: a handful of words says little
    ratio = lambda part, whole, more=20: float(np.arcsin(np.sqrt(min(1.0, part / (whole + more)))))
    return [
        float(np.log1p(n)), float(np.log1p((sum(map(len, words)) + 100) / (n + 20))), ratio(upper, upper + lower), ratio(symbols, len(raw)), ratio(marks, n), ratio(stops, 2 * n),
        ratio(digits, len(raw)), ratio(sum(map(eq, words, words[1:])), n), ratio(n - len(set(words)), n, 100), ratio(raw.count(b"\n"), n, 40), ratio(wide, len(raw), 100),
    ]


def statistics_of(text: Column) -> Column:
    """The vector of a text column."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(statistics)
    return vectors(text)


@dataclass(frozen=True)
class Discriminant:
    """Two normal classes; `inverse[c]` is the inverse of the Cholesky factor of class c's covariance."""
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    constant: float
    only: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, per row of x."""
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.centre) / self.scale
        distance = [np.square((z - self.means[c]) @ self.inverse[c].T).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(0.5 * (distance[0] - distance[1]) + self.constant, -700, 700)))


def moments(rows: DataFrame, vector: str, label: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class: added up in the tasks, a few numbers come back."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = [F.col(vector)[i] for i in range(d)]
    sums = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(d)], *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs])
    found = {}
    for r in sums.filter(F.col(label).isin(0, 1)).collect():
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        found[int(r[label])] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), products)
    return found


def solve(found: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float, ridge: float) -> Discriminant:
    """Means, covariances shrunk towards the pooled one and towards a multiple of the identity, and inverse factors."""
    d = len(NAMES)
    if len(found) < 2:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), 0.0, float(next(iter(found))) if found else 0.5)
    total = sum(found[c][0] for c in (0, 1))
    centre = (found[0][1] + found[1][1]) / total
    spread = (found[0][2] + found[1][2]) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-12))
    means, covariances = [], []
    for c in (0, 1):
        n, s, p = found[c]
        means.append((s / n - centre) / scale)
        covariances.append((p / n - np.outer(s / n, s / n)) / np.outer(scale, scale))
    pooled = sum(found[c][0] / total * covariances[c] for c in (0, 1))
    inverse, logs = [], []
    for c in (0, 1):
        mixed = (1 - shrinkage) * covariances[c] + shrinkage * pooled
        mixed = (1 - ridge) * mixed + ridge * np.trace(mixed) / d * np.eye(d) + 1e-9 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        inverse.append(np.linalg.inv(factor))
        logs.append(np.log(np.diag(factor)).sum())
    constant = logs[0] - logs[1] + np.log(found[1][0] / found[0][0])
    return Discriminant(centre, scale, np.array(means), np.array(inverse), float(constant))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", shrinkage: float = 0.3, ridge: float = 0.01) -> Discriminant:
    """Fit on every labelled document.  Texts become vectors where they are read; only ids and vectors meet the labels."""
    vectors = docs.select(F.col(doc_id).alias("id"), statistics_of(F.col(text)).alias("vector"))
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("id").isNotNull())
    return solve(moments(vectors.join(marks, "id"), "vector", "label"), shrinkage, ridge)


def score(model: Discriminant, text: Column) -> Column:
    """Score between 0 and 1 of a text column."""
    @F.pandas_udf(T.DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            vectors = np.array(batch.map(statistics).tolist(), dtype=float).reshape(-1, len(NAMES))
            yield pd.Series(model.score(vectors))
    return scored(text)


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents whose labels are kept for measuring."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
