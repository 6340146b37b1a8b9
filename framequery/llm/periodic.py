"""Periodic runs of words, found on a harmonic grid.

For each period p the grid holds the places 0, p, 2p, ... of a text.  A run of
period p that is four periods long covers four neighbouring grid places with the
same word; where these are equal, the longest common extension (LCE) of jp and
(j+1)p is queried forwards in the text and backwards in the reversed text, and
both together give the whole run.  There are n/p grid places, so n log n a text.
An LCE is a range minimum over the common prefixes of neighbours in a suffix
array.

Texts are searched where they lie, many in one block with a separator of its own
behind each, so that no extension leaves its text; nothing is shuffled.  Memory is
that of one block: BLOCK words or the longest text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import crc32_sql, table, whole_text

#: Words in a block of texts, and grid places that are looked at together.
BLOCK = 1 << 16
PLACES = 1 << 18
LEAST_WORDS = 6
LEAST_TURNS = 4
WORD = r"[^\x20\x09-\x0D]+"


class Extensions:
    """Longest common extensions of two places of ``codes``, whole numbers."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int32)
        ranks, width = [rank], 1
        order = np.argsort(rank, kind="stable")
        while n and rank.max() < n - 1:  # double the compared length until all suffixes differ
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:] + 1
            key = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            ranks.append(rank)
            width *= 2
        self.rank = rank
        self.least = self._minima(self._common(order, ranks))

    @staticmethod
    def _common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """The common prefix of each suffix in the array with the one before it."""
        n = len(order)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(n - 1, 0), np.int32)
        for level in range(len(ranks) - 1, -1, -1):
            at = ranks[level]
            same = (a < n) & (b < n)
            same[same] = at[a[same]] == at[b[same]]
            step = same.astype(np.int64) << level
            a, b, common = a + step, b + step, common + step.astype(np.int32)
        return np.concatenate([[0], common]).astype(np.int32) if n else common

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        """At level k the least of 2**k neighbours from each place on."""
        levels = [common]
        while 2 << (len(levels) - 1) <= len(common):
            half, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(np.minimum(last[:-half], last[half:]))
        return levels

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a != b, how far they can be read alike."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out


def grid(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, period) where four neighbouring grid places of a text hold one
    word; at all others an extension cannot make a run.

    ``codes`` holds the texts from ``starts`` on; PLACES are looked at together.
    """
    limits = sizes // LEAST_TURNS
    text = np.repeat(np.arange(len(sizes)), limits)
    period = np.arange(limits.sum()) - np.repeat(np.cumsum(limits) - limits, limits) + 1
    count = (sizes[text] - 1) // period + 2 - LEAST_TURNS
    ends, found = np.cumsum(count), []
    at = 0
    while at < len(period):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES)))
        some, n = slice(at, upto), count[at:upto]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p = np.repeat(period[some], n)
        place = np.repeat(starts[text[some]], n) + step * p
        owner = np.repeat(text[some], n)
        for k in range(1, LEAST_TURNS):
            same = np.flatnonzero(codes[place] == codes[place + k * p])
            place, p, owner = place[same], p[same], owner[same]
        found.append((owner, place, p))
        at = upto
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[f[i] for f in found]]) for i in range(3))


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text of word codes its runs, as sorted rows (start, length, period).

    A run is a maximal stretch of smallest period q and of max(6, 4 q) words.
    """
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner, place, period = grid(np.concatenate([np.zeros(0, np.int64), *texts]), np.cumsum(sizes) - sizes, sizes)
    if not len(owner):
        return out
    used, owner = np.unique(owner, return_inverse=True)
    apart = max(int(texts[i].max()) for i in used) + 1
    codes = np.concatenate([np.append(texts[i], apart + k) for k, i in enumerate(used)])
    starts = np.cumsum(sizes[used] + 1) - sizes[used] - 1
    place = place - (np.cumsum(sizes) - sizes)[used][owner] + starts[owner]
    n = len(codes)
    ahead = Extensions(codes).of(place, place + period)
    turned = Extensions(codes[::-1])
    back = np.zeros(len(place), np.int64)
    inner = place > 0
    back[inner] = turned.of(n - place[inner], n - place[inner] - period[inner])
    start, length = place - back, back + period + ahead
    kept = length >= np.maximum(LEAST_WORDS, LEAST_TURNS * period)
    rows = np.column_stack([owner, start, length, period])[kept]
    if not len(rows):
        return out
    # a stretch has all multiples of its smallest period too, and its rows many seeds
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.concatenate([[True], (np.diff(rows[:, :3], axis=0) != 0).any(1)])
    rows = rows[first]
    rows[:, 1] -= starts[rows[:, 0]]
    for k in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == k, 1:]
        out[used[k]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start and period,
    collapsed, the text's words joined by one space without what repeats in runs.

    One row for each row, repeated ids included.  Words are ``WORD``; a text that is
    null, empty or blank has no runs and an empty ``collapsed``; an empty table
    gives an empty result; other columns are ignored.
    """
    kept = docs.select("doc_id", whole_text().alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def block(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        codes = [np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts]
        found, left = runs_of(codes), []
        for words, runs in zip(texts, found, strict=True):
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
            left.append(b" ".join(words).decode())
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()] for runs in found]
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "runs": rows, "collapsed": left})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                words = text.encode().split()  # bytes split at exactly the blanks of WORD
                if texts and held + len(words) > BLOCK:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(None if pd.isna(doc_id) else int(doc_id) if kind == "bigint" else doc_id)
                texts.append(words)
                held += len(words)
            yield block(ids, texts)

    return kept.mapInPandas(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of the greatest length / period; ties: least start, then period."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(ahead(r, best), r).otherwise(best))


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with loops set into the texts of one in ten ids: h is the
    crc32 of the id; if h % 10 = 0, with g = h div 10 and n words, each word i >= a
    becomes word a + (i - a) % p, where a = g % n, p = 1 + (n - a) div (3 + g % 8).
    Texts without words, and rows without id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    words = docs.select("doc_id", "text", F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("w"), F.floor(h / 10).alias("g"))
    words = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    looped = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("w")[at(i)]), " ")
    return words.select("doc_id", F.when(F.col("n") > 0, looped).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    top = found.withColumn("top", longest(F.col("runs")))
    best = [F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    digests = [F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, *digests)


#: The same from all pairs of equal words, without a grid.
ORACLE = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM s),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
words AS (SELECT doc_id, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word
    FROM (SELECT doc_id, w, a, p, unnest(range(n)) AS i FROM p)),
sizes AS (SELECT doc_id, n FROM p),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
    JOIN sizes ON sizes.doc_id = x.doc_id WHERE (y.i - x.i) * 4 <= n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS rn FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT words.doc_id, i FROM words JOIN runs ON words.doc_id = runs.doc_id AND i >= start + period AND i < start + length),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS collapsed FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i
    WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed ON listed.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN best ON best.doc_id = d.doc_id AND rn = 1"""
