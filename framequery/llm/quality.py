"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics, counted in one pass
over its whole text in Arrow batches.  Class means and covariances come
from one distributed aggregation over *all* labelled training rows; only the
moments, whose number depends on the statistics alone, reach the driver.  Each
covariance is shrunk towards the pooled one, its Cholesky factor is computed
once, and a score is the logistic of the difference of the two Mahalanobis
log-densities plus the log prior odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from framequery.llm.common import id_bucket, labelled, settle, table

STATISTICS = ("words", "word_len", "symbols", "upper", "digits", "bangs", "lone_marks", "repetition", "lines")
#: Marks that a word may consist of; those that count as symbols.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
SYMBOLS = MARKS.translate(str.maketrans("", "", ".,;:!?'\"-"))
#: The kind of each UTF-8 byte: 1 symbol, 2 capital, 3 digit, 4 exclamation mark, 5 line end.
KIND = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "\n"), 1):
    KIND[list(_chars.encode())] = _kind


@dataclass(frozen=True)
class Discriminant:
    """For each class: prior, mean, inverse Cholesky factor, log-determinant."""

    log_prior: tuple[float, float]
    means: tuple[np.ndarray, np.ndarray] | None
    whiten: tuple[np.ndarray, np.ndarray] | None
    log_det: tuple[float, float]


def counts(text: str | None) -> list[int]:
    """Raw counts of a whole text: words, characters, symbols, capitals, digits,
    exclamation marks, words of marks alone, distinct words, lines."""
    text = text or ""
    words = Counter(text.split())
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(KIND[raw], minlength=6)
    capitals = kinds[2] + np.count_nonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E))
    lone = sum(k for w, k in words.items() if not w.isalnum() and not w.strip(MARKS))
    return [words.total(), len(text), kinds[1], capitals, kinds[3], kinds[4], lone, len(words), kinds[5]]


def statistics(found: np.ndarray) -> np.ndarray:
    """Rows of counts -> rows of STATISTICS, transformed towards normality and
    smoothed so that short texts have moderate values."""
    words, chars, symbols, upper, digits, bangs, lone, distinct, lines = found.astype(float).reshape(-1, 9).T
    rate = lambda count, base, prior: np.log((count + 0.5) / (base + prior))
    return np.column_stack(
        [
            np.log1p(words),
            np.log((chars + 6) / (words + 1)),
            rate(symbols, chars, 50),
            rate(upper, chars, 50),
            rate(digits, chars, 50),
            rate(bangs, chars, 50),
            rate(lone, words, 20),
            np.log1p(words) - np.log1p(distinct),
            rate(lines, words, 20),
        ]
    )


def of_batch(texts: pa.Array) -> np.ndarray:
    return statistics(np.array([counts(t.as_py()) for t in texts], np.int64))


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of its text."""
    kept = docs.select("doc_id", "text")
    schema = StructType([kept.schema["doc_id"], *[StructField(c, DoubleType()) for c in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, of_batch(batch.column(1)).T)], schema.names)

    return kept.mapInArrow(run, schema)


def fit(rows: DataFrame, label: str, shrinkage: float = 0.1) -> Discriminant:
    """Fit on rows holding STATISTICS and a 0/1 ``label``.

    With no rows of a class there are no densities, and every score is the
    smoothed prior.
    """
    x = STATISTICS
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [F.sum(c) for c in x] + [F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]
    found = {r[0]: r for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*"), *sums).collect()}
    counts = [float(found[k][1]) if k in found else 0.0 for k in (0, 1)]
    log_prior = tuple(float(np.log((c + 1.0) / (sum(counts) + 2.0))) for c in counts)
    if min(counts) < 2:
        return Discriminant(log_prior, None, None, (0.0, 0.0))
    means, covs = [], []
    for k in (0, 1):
        mean = np.array(found[k][2 : 2 + len(x)]) / counts[k]
        second = np.zeros((len(x), len(x)))
        for (i, j), total in zip(pairs, found[k][2 + len(x) :], strict=True):
            second[i, j] = second[j, i] = total / counts[k]
        means.append(mean)
        covs.append(second - np.outer(mean, mean))
    pooled = sum(c * s for c, s in zip(counts, covs, strict=True)) / sum(counts)
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled)) + 1e-3 * np.eye(len(x))
    factors = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * target) for s in covs]
    whiten = tuple(np.linalg.inv(f) for f in factors)
    return Discriminant(log_prior, tuple(means), whiten, tuple(float(2 * np.log(np.diag(f)).sum()) for f in factors))


def log_odds(model: Discriminant, x: np.ndarray) -> np.ndarray:
    """Log odds of label 1 for the rows of ``x``, columns as STATISTICS."""
    odds = np.full(len(x), model.log_prior[1] - model.log_prior[0])
    if model.means is not None:
        for sign, mean, w, log_det in zip((-1, 1), model.means, model.whiten, model.log_det, strict=True):
            odds += sign * -0.5 * (np.square((x - mean) @ w.T).sum(1) + log_det)
    return np.clip(odds, -30, 30)


def probability(model: Discriminant, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-log_odds(model, x)))


def score(model: Discriminant) -> Callable[[Column], Column]:
    """Probability of label 1, from an array of the STATISTICS."""

    @F.pandas_udf("double")
    def of(stats: pd.Series) -> pd.Series:
        return pd.Series(probability(model, np.array(stats.tolist()).reshape(-1, len(STATISTICS))))

    return of


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows whose crc32(doc_id) mod 5 is not 0."""
    seen = features.where(id_bucket("doc_id", 5) != 0)
    return seen.join(labelled(labels, "quality"), "doc_id").select("quality", *STATISTICS)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null and empty texts are scored as empty ones; a null doc_id is kept (null
    held_out, never trained on); repeated rows are scored alike; an empty table
    gives an empty result; other columns are ignored.
    """
    features = settle(document_statistics(docs), "quality")
    model = fit(training_rows(features, labels), "quality")
    held_out = (id_bucket("doc_id", 5) == 0).alias("held_out")
    scored = features.select("doc_id", held_out, score(model)(F.array(*STATISTICS)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` scored at ``threshold`` or more, columns unchanged.

    Rows without doc_id or text are judged as any other.  The statistics are
    computed a second time beside the text rather than joined to it: a second
    narrow pass is cheaper than shuffling every text.
    """
    model = fit(training_rows(document_statistics(docs), labels), "quality")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probability(model, of_batch(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
