"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: case, accents, homoglyphs, digits and signs that stand
for letters.  Terms count at word boundaries and outside exception phrases.
The lexicon is a fixed seed list and the terms that labelled documents show to
be toxic; the weighted hits, alone and by text length, go through a logistic
curve fitted on the same labelled sample.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from framequery.llm.common import hash_sample, id_bucket, labelled, settle, table

SAMPLE_ROWS = 6000
#: Shares of toxic texts among those with a term, of which two folds of the training rows choose one.
PURITIES = (0.5, 0.65, 0.8)
SEED_WEIGHT = 1.5
#: Seed terms, and phrases in which a term does not count.
TERMS = "idiot idiots moron morons imbecile scum scumbag loser losers trash garbage stupid pathetic disgusting worthless clown dumbass retard bastard asshole bitch fuck fucking shit bullshit whore slut pig vermin freak jerk cretin dimwit idiote connard salaud ordure imbécile crétin abruti débile pourriture idiota imbécil estúpido estúpida basura escoria payaso inútil gilipollas cabrón idioten trottel arschloch abschaum dummkopf schwachkopf versager drecksau"  # noqa: E501
EXCEPTIONS = "trash can|trash cans|trash bin|trash bag|trash day|garbage collection|garbage collector|garbage collected|garbage truck|garbage can|pond scum|soap scum|clown fish|class clown|idiot proof|idiot savant|loser bracket|sore loser|guinea pig|pig iron|pig farm|control freak|jerk chicken"  # noqa: E501
#: Letters of other scripts, digits and signs that pass for Latin letters.
LOOKALIKES = dict(zip("авсеһіјкмнорԛѕтухαβεικνορτυχγⅼ013457", "abcehijkmhopqstyxabeikvoptuxyioieast", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}


def _table() -> dict[int, str]:
    folded = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:  # accented Latin letters
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if "a" <= base <= "z":
            folded[code] = base
    for code in range(0xFF21, 0xFF5B):  # full-width letters
        base = unicodedata.normalize("NFKC", chr(code)).lower()
        folded[code] = base
    folded |= {ord(k): v for k, v in LOOKALIKES.items()} | dict.fromkeys([*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD], "")
    folded |= {ord(c): " " for c in "-_\t\n\r\f\v"} | {ord("l"): "i"}
    return folded | {k: "i" for k, v in folded.items() if v == "l"}


TABLE = _table()
ASCII_TABLE = bytes(ord(TABLE[c]) if c in TABLE else c for c in range(128)) + bytes(range(128, 256))
SIGN = re.compile(r"[@$!|](?=\w)")


def fold(text: str) -> str:
    """The text in which look-alikes are one; l and 1 both become i."""
    low = text.lower()
    if SIGN.search(low):
        low = SIGN.sub(lambda m: SIGNS[m[0]], low)
    if low.isascii():
        return low.encode().translate(ASCII_TABLE).decode()
    return low.translate(TABLE)


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    """Terms with their weights; exception phrases with weight None."""
    out = ahocorasick.Automaton()
    for term, weight in weights.items():
        word = term.rstrip()
        _, known, begins = out.get(word, (0, 0.0, False))
        out.add_word(word, (len(word), max(weight, known), begins or term == word))
    for phrase in EXCEPTIONS.split("|"):
        folded = fold(phrase)
        out.add_word(folded, (len(folded), None, False))
    out.make_automaton()
    return out


def weighted_hits(text: str, matcher: ahocorasick.Automaton) -> tuple[float, int, int]:
    """The sum of the weights of the terms found, their number, the words."""
    folded = fold(text)
    hits, spared, n = [], [], len(folded)
    for end, (length, weight, begins) in matcher.iter(folded):
        start = end - length + 1
        if (start and folded[start - 1].isalnum()) or (not begins and end + 1 < n and folded[end + 1].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    if spared:
        covered = np.zeros(n + 1, bool)
        for start, end, _ in spared:
            covered[start : end + 1] = True
        hits = [h for h in hits if not covered[h[0]]]
    return sum(h[2] for h in hits), len(hits), folded.count(" ") + 1


def measures(weight: float, words: int) -> list[float]:
    """What the curve takes: the weight, and the weight by length."""
    return [np.log1p(weight), np.log1p(100 * weight / (words + 20)), 1.0]


def emitted(text: str | None) -> dict[str, int]:
    """The word beginnings of 3 letters and more in a text and its whole words
    (with a space behind), each with a bit for the words around its first place."""
    words = re.findall(r"[^\W\d_]+", fold(text or ""))
    out: dict[str, int] = {}
    for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
        if w + " " not in out and len(w) > 2:
            bit = 1 << zlib.crc32(f"{before} {after}".encode()) % 62
            out[w + " "] = bit
            for n in range(3, len(w)):
                out.setdefault(w[:n], bit)
    return out


#: For each term of the sample and each fold: texts, toxic texts, contexts as bits.
Counts = dict[str, tuple[tuple[int, int, int], tuple[int, int, int]]]


def term_counts(sample: DataFrame) -> Counts:
    """The terms that are in 6 or more texts and toxic in the least share of
    PURITIES of them, overall or outside one of the two folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [emitted(t.as_py()) for t in batch.column(0)]
            times = [len(f) for f in found]
            toxic, fold = (np.repeat(np.array(batch.column(k).to_pylist(), np.int64), times) for k in (1, 2))
            term, bits = [t for f in found for t in f], [b for f in found for b in f.values()]
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(bits, pa.int64()), pa.array(toxic), pa.array(fold)], ["term", "bits", "toxic", "fold"])

    terms = sample.select("text", F.col("toxic").cast("long"), F.col("fold").cast("long")).mapInArrow(run, "term string, bits long, toxic long, fold long")
    own = lambda k, c: F.when(F.col("fold") == k, c)
    sums = [f(F.coalesce(own(k, F.col(c)), F.lit(0)) if c else F.coalesce(own(k, F.lit(1)), F.lit(0))).alias(f"{n}{k}") for k in (0, 1) for n, f, c in (("n", F.sum, None), ("k", F.sum, "toxic"), ("b", F.bit_or, "bits"))]
    known = terms.groupBy("term").agg(*sums)
    enough = [f"({n} >= 6 and {k} >= {min(PURITIES)} * ({n}))" for n, k in (("n0 + n1", "(k0 + k1)"), ("n0", "k0"), ("n1", "k1"))]
    return {r["term"]: ((r["n0"], r["k0"], r["b0"]), (r["n1"], r["k1"], r["b1"])) for r in known.where(" or ".join(enough)).collect()}


def learned_terms(counts: Counts, folds: tuple[int, ...], purity: float, base: float) -> dict[str, float]:
    """Word beginnings and whole words that are toxic in the ``folds``: in 6 or
    more texts, the share ``purity`` of them labelled so (clean words may begin
    alike by chance; the weights and the length tell such texts apart), and in
    about as many contexts as a word used freely has (words of copied passages
    have few).  ``base`` is the share of toxic texts.

    Of nested beginnings with the same texts the longest is taken, and nothing
    that begins with a term already taken.
    """
    odds = np.log((base + 1e-3) / (1 - base + 1e-3))
    known: dict[str, tuple[int, int]] = {}
    for term, per in counts.items():
        n, k = (sum(per[f][c] for f in folds) for c in (0, 1))
        bits = reduce(int.__or__, (per[f][2] for f in folds))
        if n >= 6 and k >= purity * n and bits.bit_count() >= min(0.5 * n, 20):
            known[term] = (k, n)
    share = lambda t: known[t][0] / known[t][1]
    order, taken, out = sorted(known), [], {}
    for term in sorted(known, key=lambda t: (-known[t][0], len(t), t)):
        if term.startswith(tuple(taken)):
            continue
        taken.append(term)
        within = [t for t in order[bisect_left(order, term) :  bisect_left(order, term + "\U0010ffff")] if t != term]
        while longer := [t for t in within if t.startswith(term) and t != term and known[t][0] >= 0.95 * known[term][0] and share(t) >= share(term)]:
            term = min(longer, key=lambda t: (len(t), t))
        k, n = known[term]
        out[term] = float(np.clip(np.log((k + 0.5) / (n - k + 0.5)) - odds, 0.5, 6))
    return out


def lexicon(learned: dict[str, float]) -> dict[str, float]:
    """Weights of terms; one that ends in a space is a whole word, any other the
    beginning of one."""
    return {fold(t) + " ": SEED_WEIGHT for t in TERMS.split()} | learned


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton steps with a light ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = 1e-2 * np.diag([1.0, 1.0, 0.01])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def with_hits(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, weight, hits, words of every row."""
    kept = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(weights)
        for batch in batches:
            found = [weighted_hits(t.as_py() or "", matcher) for t in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "weight", "hits", "words"])

    names = ", ".join(f"{n} {t}" for n, t in kept.select("doc_id").dtypes)
    return kept.mapInArrow(run, f"{names}, weight double, hits long, words long")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and curve from at most ``rows`` labelled rows, chosen by the hash
    of their id among those whose crc32(doc_id) mod 3 is not 1.

    The share of toxic texts that a term needs is the one of PURITIES under which
    terms and curve of one fold of these rows give the other the best likelihood.
    Copies of a text count once, with the larger label.
    """
    seen = hash_sample(labelled(labels, "toxic").where(id_bucket("doc_id", 3) != 1), rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    sample = settle(texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2))), "sample")
    counts, base = term_counts(sample), float(sample.agg(F.avg("toxic")).first()[0] or 0.0)
    kept = sample.select("doc_id", "toxic", "fold")

    def measured(folds: tuple[int, ...], purity: float) -> tuple[dict[str, float], np.ndarray, np.ndarray, np.ndarray]:
        weights = lexicon(learned_terms(counts, folds, purity, base))
        got = with_hits(sample, weights).join(kept, "doc_id").select("weight", "words", "toxic", "fold").collect()
        x = np.array([measures(r["weight"], r["words"]) for r in got]).reshape(-1, 3)
        return weights, x, np.array([r["toxic"] for r in got], float), np.array([r["fold"] for r in got], int)

    worth = dict.fromkeys(PURITIES, 0.0)
    for purity in PURITIES:
        for own in (0, 1):
            _, x, y, part = measured((own,), purity)
            if len(y) and y[part == own].any() and not y[part == own].all():
                p = 1 / (1 + np.exp(-np.clip(x[part != own] @ curve(x[part == own], y[part == own]), -30, 30)))
                worth[purity] += float(np.log(np.clip(np.where(y[part != own] == 1, p, 1 - p), 1e-6, 1)).sum())
    weights, x, y, _ = measured((0, 1), max(PURITIES, key=lambda v: worth[v]))
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: a plain curve
        return weights, np.array([1.0, 1.0, -3.0])
    return weights, curve(x, y)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, hits for every row of ``docs``.

    Null and empty texts have no hits and get the curve's lowest value; a null
    doc_id is kept (null held_out); repeated rows are scored alike; an empty
    table gives an empty result; other columns are ignored.
    """
    weights, beta = fit(docs, labels)
    kept = docs.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "text")
    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("hits", IntegerType())]
    schema = StructType([kept.schema["doc_id"], StructField("held_out", BooleanType()), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(weights)
        for batch in batches:
            found = [weighted_hits(t.as_py() or "", matcher) for t in batch.column(2)]
            x = np.array([measures(f[0], f[2]) for f in found]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            out = [pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([f[1] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], schema.names)

    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
