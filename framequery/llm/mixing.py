"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives every document posteriors over
the domains (its possible sources).  Nonnegative rates for the documents are
then fitted by projected gradient steps on the least-squares distance between
the domains' expected token totals and their targets, to which a small penalty on
the distance of the rates from 1 is added, so that posteriors that tell little
leave the rates near 1.  Each step is one aggregation over a narrow settled table;
only the domains' totals and products reach the driver.  A rate depends on a
document's posteriors and one number for each domain, so it is computed beside the
text, which is never shuffled.

Everything is a DataFrame or SQL function; the logistic regression and its
features are Spark's own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import hash_sample, settle, table

SAMPLE_ROWS = 4000
FEATURES = 4096
MAX_DOMAINS = 64
#: The weight of the rates' distance from 1 beside that of the shares from their targets.
PENALTY = 1e-3


@dataclass(frozen=True)
class Membership:
    """The domains and their classifier (none: one domain for all)."""

    domains: list[str]
    regression: LogisticRegressionModel | None


@dataclass(frozen=True)
class Fit:
    """What a document's rate loses for each unit of a domain's posterior; the
    largest difference between a domain's share of the expected tokens and its
    target, with the fitted rates and at rate 1; whether the optimum was reached;
    the steps taken."""

    pull: tuple[float, ...] = ()
    gap: float = 0.0
    gap_before: float = 0.0
    converged: bool = True
    steps: int = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n\t\r]+"), "")


def features(rows: DataFrame) -> DataFrame:
    """Adds ``features``, hashed word shares, for the words ``w``."""
    counted = HashingTF(numFeatures=FEATURES, inputCol="w", outputCol="counts").transform(rows)
    return Normalizer(p=2.0, inputCol="counts", outputCol="features").transform(counted)


def train(docs: DataFrame, labels: DataFrame, domain: str, rows: int = SAMPLE_ROWS) -> Membership:
    """The classifier of labelled documents of known ``domain``, fitted on at most
    ``rows`` of them, chosen by the hash of their id.

    Without two domains there is no classifier.  More than MAX_DOMAINS domains
    in the sample are an error: the fit sums their products in pairs.
    """
    ids = hash_sample(labels.where("doc_id is not null").select("doc_id").distinct(), rows)
    known = docs.where(F.col(domain).isNotNull()).select("doc_id", words_of(F.col("text")).alias("w"), F.col(domain).cast("string").alias("domain"))
    sample = settle(known.join(F.broadcast(ids), "doc_id"), "sample")
    domains = sorted(r["domain"] for r in sample.select("domain").distinct().limit(MAX_DOMAINS + 1).collect())
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains; merge small ones first")
    if len(domains) < 2:
        return Membership(domains or ["all"], None)
    index = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    made = features(sample.select(index.cast("double").alias("label"), "w")).select("label", "features").coalesce(4)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=30, standardization=False)
    return Membership(domains, regression.fit(made))


def with_posteriors(docs: DataFrame, member: Membership) -> DataFrame:
    """(row, tokens, p): the whole row, the words of its text, its posteriors."""
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), words_of(F.col("text")).alias("w"))
    if member.regression is None:
        return cut.select("row", F.size("w").cast("long").alias("tokens"), F.array(F.lit(1.0)).alias("p"))
    scored = member.regression.transform(features(cut))
    return scored.select("row", F.size("w").cast("long").alias("tokens"), vector_to_array("probability").alias("p"))


def fit_rates(rows: DataFrame, targets: np.ndarray, penalty: float = PENALTY, tolerance: float = 1e-8, max_steps: int = 100) -> Fit:
    """Rates >= 0 for (tokens, p) by which each domain's expected tokens, the sum of
    rate * tokens * p, meet ``targets`` times all tokens.

    Minimises the squared differences of the shares plus ``penalty`` times the mean
    squared distance of the rates from 1, both weighted by tokens.  From residuals e
    of the shares the projected gradient step, in the metric of the tokens and of
    the length that the penalty gives, sets every rate to max(0, 1 - p e / penalty):
    it forgets the rates before it, so no state is kept.  The optimum is where
    these rates have the residuals e themselves.  The next e is a quasi-Newton one:
    the products of posteriors, summed once, give the first curvature, the steps
    correct it, and a step is shortened until the dual distance falls; as that is
    strictly convex, the steps end at the optimum.  A fit that would end further
    from its targets than rate 1 is not taken.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    n = F.col("tokens").cast("double")
    found = rows.agg(F.sum(n), *[F.sum(n * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
    budget = float(found[0] or 0)
    if budget == 0:
        return Fit()
    aim, curve = np.asarray(targets, float), np.eye(k)
    for (i, j), v in zip(pairs, found[1:], strict=True):
        curve[i, j] += float(v) / budget / penalty
        curve[j, i] = curve[i, j]
    inverse = np.linalg.inv(curve)

    def at(e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual distance, its slope, and the shares' differences."""
        state = rows.select(n.alias("n"), "p", rate_of(Fit(tuple(e / penalty))).alias("r"))
        sums = [F.sum(F.col("n") * F.col("p")[i] * F.col("r")) for i in range(k)]
        totals = np.array(state.agg(F.sum(F.col("n") * F.col("r") * F.col("r")), *sums).first(), float) / budget
        off = totals[1:] - aim
        return float(e @ e / 2 + e @ aim + penalty / 2 * totals[0]), e - off, off

    e = np.zeros(k)
    value, slope, off = at(e)
    before, steps = float(np.abs(off).max()), 0
    while np.abs(slope).max() > tolerance and steps < max_steps:
        step, length = -inverse @ slope, 1.0
        while True:
            steps += 1
            tried = at(e + length * step)
            if tried[0] <= value + 1e-4 * length * float(slope @ step) + 1e-15 or length < 1e-6:
                break
            length /= 2
        moved, bent = length * step, tried[1] - slope
        e, (value, slope, off) = e + moved, tried
        if (along := float(moved @ bent)) > 0:
            turn = np.eye(k) - np.outer(moved, bent) / along
            inverse = turn @ inverse @ turn.T + np.outer(moved, moved) / along
    gap = float(np.abs(off).max())
    if gap > before:
        return Fit((), before, before, False, steps)
    return Fit(tuple(float(v) for v in e / penalty), gap, before, bool(np.abs(slope).max() <= tolerance), steps)


def rate_of(fit: Fit) -> Column:
    """The rate of a row with posteriors ``p``."""
    if not fit.pull:
        return F.lit(1.0)
    lost = F.zip_with("p", F.array(*[F.lit(v) for v in fit.pull]), lambda p, v: p * v)  # an array: every step runs the same code
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(lost, F.lit(0.0), lambda total, v: total + v))


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, domain: str) -> tuple[Membership, DataFrame, Fit]:
    """The classifier, a settled (row, tokens, p) of every row, and the fit."""
    member = train(docs, labels, domain)
    rows = settle(with_posteriors(docs, member), "posteriors")
    share = np.array([1.0 if targets is None else float(targets.get(d, 0)) for d in member.domains])
    if share.sum() <= 0:
        share = np.ones(len(member.domains))
    return member, rows, fit_rates(rows.select("tokens", "p"), share / share.sum())


def _likeliest(member: Membership) -> Column:
    return F.array(*[F.lit(d) for d in member.domains])[(F.array_position("p", F.array_max("p")) - 1).cast("int")]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "source") -> DataFrame:
    """doc_id, tokens, domain (the likeliest), posterior (its), rate, gap,
    gap_before, converged.

    ``targets`` gives the domains' shares (none: equal shares); domains it does
    not name get zero.  ``gap`` is the largest difference between a domain's
    share of the expected tokens and its target, ``gap_before`` that at rate 1,
    ``converged`` whether the optimum was reached; all rows have the same.  One row for each row;
    texts null or empty have no tokens; an empty table gives an empty result;
    unlabelled or null domains are predicted; other columns are ignored.
    """
    member, rows, fit = fitted(docs.select("doc_id", "text", *[c for c in [domain] if c not in ("doc_id", "text")]), labels, targets, domain)
    known = [F.col("row.doc_id").alias("doc_id"), "tokens", _likeliest(member).alias("domain"), F.array_max("p").alias("posterior"), rate_of(fit).alias("rate")]
    return rows.select(*known, F.lit(fit.gap).alias("gap"), F.lit(fit.gap_before).alias("gap_before"), F.lit(fit.converged).alias("converged"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = "source") -> DataFrame:
    """``docs`` with ``mix_domain``, ``mix_tokens`` and ``mix_rate``, the expected
    number of times that the document is to be drawn; every row is kept.

    Columns of these three names that ``docs`` has already are replaced.
    """
    member, rows, fit = fitted(docs, labels, targets, domain)
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_rate")]
    added = [_likeliest(member).alias("mix_domain"), F.col("tokens").alias("mix_tokens"), rate_of(fit).alias("mix_rate")]
    return rows.select(*kept, *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares of all sources."""
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
