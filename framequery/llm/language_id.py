"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed character n-grams decide first the
language family, then, one versus one, the language within it.  The machines
are Spark's own, trained on a bounded sample of each language; every whole text
is scored in Arrow batches by one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from framequery.llm.common import hash_sample, id_bucket, settle, table

DIMENSIONS = 1024
BLOCK = 1 << 20
MAX_LANGUAGES = 256
#: Families of languages; a language not named is its own family.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb yi fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "indo_iranian": "hi ur bn pa mr ne fa ku".split(),
}
Machines = dict[tuple[str, str], tuple[np.ndarray, float]]


def family(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def profile(text: str) -> np.ndarray:
    """Root shares of hashed character 1-, 2- and 3-grams of the lower-case text."""
    found = np.zeros(DIMENSIONS, np.int64)
    low = text.lower()
    for at in range(0, len(low), BLOCK):
        c = np.frombuffer(low[at : at + BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = min(len(c), BLOCK)
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(40503)
        three = (two[:-1] ^ (one[2:] >> np.uint32(13))) * np.uint32(69069) if len(c) > 2 else two[:0]
        for h in (one, two, three):
            found += np.bincount((h[:own] >> np.uint32(22)) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return np.sqrt(found / max(1, found.sum()))


def profiles(rows: DataFrame, label: str) -> DataFrame:
    """(label, x): the profile of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([profile(t.as_py() or "").tolist() for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], [label, "x"])

    return rows.select(label, "text").mapInArrow(run, f"{label} string, x array<double>")


def machines(rows: DataFrame, classes: dict[str, list[str]]) -> Machines:
    """One machine for each two classes, a class being a list of langs."""
    out = {}
    for a, b in combinations(sorted(classes), 2):
        own = rows.where(F.col("lang").isin(*classes[a], *classes[b]))
        both = own.select(F.col("lang").isin(*classes[b]).cast("double").alias("label"), array_to_vector("x").alias("features"))
        model = LinearSVC(regParam=1e-4, maxIter=25, standardization=False).fit(both)
        out[a, b] = (model.coefficients.toArray(), float(model.intercept))
    return out


def train(docs: DataFrame, per_language: int = 600) -> tuple[dict[str, list[str]], Machines, dict[str, Machines]]:
    """Families with their languages, machines between families, and machines
    within each.  Rows whose crc32(doc_id) mod 4 is 2 are held out.  At most
    ``per_language`` texts of each language are used, the first by the hash of
    their id; more than MAX_LANGUAGES languages are an error."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(id_bucket("doc_id", 4) != 2)
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return {}, {}, {}
    ids = reduce(DataFrame.unionByName, [hash_sample(known.where(F.col("lang") == v).select("doc_id"), per_language) for v in langs])
    rows = settle(profiles(known.join(F.broadcast(ids.distinct()), "doc_id"), "lang"), "profiles")
    groups: dict[str, list[str]] = {}
    for v in langs:
        groups.setdefault(family(v), []).append(v)
    within = {f: machines(rows, {v: [v] for v in members}) for f, members in groups.items()}
    return groups, machines(rows, groups), within


def vote(x: np.ndarray, classes: list[str], between: Machines) -> tuple[str, float]:
    """The class with most wins, ties by the sum of its probabilities, and its
    mean probability."""
    wins, total = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0)
    for (a, b), (w, bias) in between.items():
        p = 1 / (1 + np.exp(-2 * np.clip(x @ w + bias, -15, 15)))
        wins[b if p >= 0.5 else a] += 1
        total[a] += 1 - p
        total[b] += p
    best = max(sorted(classes), key=lambda c: (wins[c], total[c]))
    return best, float(total[best] / (len(classes) - 1)) if len(classes) > 1 else 1.0


def identify(docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, family for every row of ``docs``.

    lang_pred is 'und' with score 0 if the text is null or has no letter, or
    nothing could be learned.  A null doc_id is kept (null held_out, never
    learned from); null langs are not learned from; repeated rows get equal
    predictions; an empty table gives an empty result.
    """
    groups, between, within = train(train_docs)
    kept = docs.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("family", StringType())]
    schema = StructType([kept.schema["doc_id"], StructField("held_out", BooleanType()), *added])

    def predict(text: str | None) -> tuple[str, float, str | None]:
        if not text or not groups or not any(map(str.isalpha, text)):
            return "und", 0.0, None
        x = profile(text)
        fam, p = vote(x, list(groups), between)
        lang, q = vote(x, groups[fam], within[fam])
        return lang, p * q, fam

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(2)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema.names)

    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs)
