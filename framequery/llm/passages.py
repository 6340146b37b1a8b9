"""Substring dedup by collinear chaining of shared k-mer seeds.

Every whole text gives k-mer seeds of words (the minimisers of its sliding
windows).  Each is first joined with the first document that has it alone, so matches grow
with n documents, not n^2.  Runs of ``min_words`` words with too few uncrowded seeds are
hashed whole and joined with the first document that has them, which shares all of their
words.  The matches of a document and a source are chained in order with gap costs
through a Fenwick tree, and each chain is aligned word by word, which finds passages that
differ in single words.

Then a seed that at most HOLDERS + 1 documents have is joined among all of them, an
occurrence of a crowded one with the HOLDERS last documents before its own; pairs are
aligned only where more may come of it than the passages found (``beyond``).  At last a crowded seed that lies in no passage is compared with all of its
holders that share a second seed at some distance with it (``left_open``), and a run of one
seed with those that share more than the run (``open_runs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.llm.common import broadcast_if_small, one_text_per_id, settle, table

K = 5
WINDOW = 10
GAP_COST = 0.1
HOLDERS = 8
#: Occurrences of a seed that are ordered in one group; more go by parts.
ORDERED = 4096
#: Bytes of text whose words a task of Python lays out at a time, and the least distance
#: of two texts there, which no window, look beside or run of one seed spans.
LAID = 500_000
APART = K + WINDOW
#: Words at either side of a seed that are told by four bits each; what may go on further.
BESIDE = 8
UNTOLD = 1_000_000_000
#: Documents that share two crowded seeds and are all paired; more only where ``may_pass``.
FEW = 16
#: Bits for the words between two seeds, and rows of those that a task of Python holds.
BAG = 256
HELD = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Its product with MIX is 1 modulo 2^64.
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text; A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Laid(NamedTuple):
    """Word hashes of several texts in one array, at least APART places between any two."""

    doc: np.ndarray  #: number of each text in its batch
    begin: np.ndarray  #: the place of its first word
    length: np.ndarray
    one: np.ndarray

    def every(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a run of ``length`` words begins, and how many each text has."""
        n = np.maximum(self.length - length + 1, 0)
        return np.arange(n.sum()) + np.repeat(self.begin - np.cumsum(n) + n, n), n

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1


def hashes_of(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin ``at`` in the bytes, eight bytes a turn."""
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    told = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out, left, rows = length.astype(np.uint64) * MIX, length, np.arange(len(at))
    while len(rows):
        h = out[rows] ^ (eight[at] & told[np.minimum(left, 8)])
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
        out[rows] = h ^ (h >> np.uint64(33))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


def laid_out(texts: pa.Array, held: int = LAID) -> Iterator[Laid]:
    """The words of the texts as ``words_of`` tells them, some ``held`` bytes of text at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    end = 0
    while end < len(texts):
        start, end = end, max(int(np.searchsorted(size, (size[end - 1] if end else 0) + held, "right")), end + 1)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(start, end - start).cast(pa.string()), "")))
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        there = ends[1:] > ends[:-1]  # a text may end with spaces
        at, n, owner = ends[:-1][there], np.diff(ends)[there], owner[there]
        length = np.bincount(owner, minlength=end - start)
        one = np.zeros(int(length.sum()) + APART * (len(length) + 1), np.uint64)
        if len(at):
            one[np.arange(len(at)) + (owner + 1) * APART] = hashes_of(np.frombuffer(words.buffers()[2], np.uint8), at, n)
        yield Laid(np.arange(start, end), np.cumsum(length + APART) - length, length, one)


def seeds(laid: Laid, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the minimisers of the texts,
    how far each lies behind the first of a run of itself, and whether it is of such a run at all; a shared run of k + window - 1 words always
    shares one."""
    there, n = laid.every(k)
    h = np.full(len(laid.one), np.iinfo(np.uint64).max)
    own = np.zeros(len(there), np.uint64)
    for j in range(k):
        own = own * MIX + laid.one[there + j]
    own = (own ^ (own >> np.uint64(31))) * MIX
    h[there] = own ^ (own >> np.uint64(29))
    least, width = np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        a, b = least[:-step], least[step:]
        least, width = np.where(h[a] <= h[b], a, b), width + step
    starts = np.minimum(np.maximum(n - window + 1, 1), n)
    at = least[np.arange(starts.sum()) + np.repeat(laid.begin - np.cumsum(starts) + starts, starts)]
    at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
    h, since, runs = numbered_in_runs(h[at], at)
    return h.view(np.int64), at, since, runs


def beside(one: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """The BESIDE words before each place (upper half) and after its k words, nearest
    first in the lowest bits, as numbers of four bits: 1 to 15, 0 outside of the text."""
    told = np.zeros(len(one) + 2 * BESIDE + k, np.uint64)
    told[BESIDE : BESIDE + len(one)] = np.where(one > 0, one % np.uint64(15) + np.uint64(1), 0)
    out = np.zeros(len(at), np.uint64)
    for j in range(BESIDE):
        out |= told[at + (BESIDE + k + j)] << np.uint64(4 * j)
        out |= told[at + (BESIDE - 1 - j)] << np.uint64(4 * j + 32)
    return out.view(np.int64)


def going_on(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most how many words two seeds' texts go on alike before and after them, from
    ``beside``; UNTOLD where that may go on past what is told, or past words that
    differ (as in ``extend``)."""
    out, one, other = [], a.view(np.uint64), b.view(np.uint64)
    for half in (32, 0):
        n, score = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        alike, told, past = np.ones(len(a), bool), np.ones(len(a), bool), np.zeros(len(a), bool)
        for j in range(BESIDE):
            mine, theirs = ((x >> np.uint64(half + 4 * j)) & np.uint64(15) for x in (one, other))
            told &= (mine > 0) & (theirs > 0)
            score += np.where(told, np.where(mine == theirs, 1, -1), 0).astype(np.int32)
            alike &= told & (mine == theirs)
            n += alike
            past |= score > n
        out.append(np.where(past | told & ((score >= n) | (n >= BESIDE - 1)), UNTOLD, n))
    return out[0], out[1]


def numbered_in_runs(h: np.ndarray, at: np.ndarray, gap: int = K + WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In a run of one repeated seed ("no no no ...") the n-th is told from the
    others, so that such runs match in order too; the places since the first, and
    true for all.  Places ascend, and those of two texts lie further apart than ``gap``."""
    order = np.argsort(h, kind="stable")
    own, place = h[order], at[order]
    starts = np.ones(len(h), bool)
    starts[1:] = (own[1:] != own[:-1]) | (place[1:] - place[:-1] > gap)
    index = np.arange(len(h))
    number = index - np.maximum.accumulate(np.where(starts, index, 0))
    out, since, runs = h.copy(), np.zeros(len(h), np.int32), np.zeros(len(h), bool)
    out[order] = own ^ (number.astype(np.uint64) * MIX)
    since[order] = place - place[index - number]
    runs[order] = (number > 0) | (np.append(number[1:], 0) > 0)
    return out, since, runs


def long_seeds(one: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``length`` words that begin at the places
    ``at``, from differences of one running sum."""
    at = at[at + length <= len(one)].astype(np.int64)
    powers = np.cumprod(np.full(len(one), MIX))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * powers)])
    back = np.cumprod(np.full(len(one), UNMIX))
    h = (total[at + length] - total[at]) * back[at]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64), at.astype(np.int32)


def bare_windows(laid: Laid, places: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the runs of ``whole`` words without two seeds, other than
    those at ``places``, so far apart that a chain of both counts."""
    at = seeds(laid)[1]
    told = np.zeros(len(laid.one), bool)
    told[places] = True
    telling = at[~told[at]]
    before = np.zeros(len(laid.one) + 1, np.int64)
    before[telling + 1] = 1
    before = np.cumsum(before)
    starts = laid.every(whole)[0]
    lo, hi = before[starts], before[starts + whole - K + 1] - 1
    bare = lo >= hi
    bare[~bare] = telling[hi[~bare]] - telling[lo[~bare]] < whole // 3 - K
    return long_seeds(laid.one, starts[bare], whole)


def firsts(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for the first of each hash in its text; texts ascend."""
    order = np.argsort(h, kind="stable")
    out = np.ones(len(h), bool)
    out[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    return out


def crowded_matches(docs: DataFrame, seeded: DataFrame, whole: int) -> DataFrame:
    """(doc_id, source, at, s_at, long): for each run of ``bare_windows`` the first
    document that has it, as a long match.  Of a text that repeats itself at once the
    n-th equal run is told from the others, so it is met where the text goes on as long.
    Between any two seeds of a text lie less than WINDOW places, so one that is left out
    alone leaves no such run."""
    places = seeded.where("bare").groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    if whole > 3 * WINDOW + whole // 3:
        places = places.where(F.size("places") > 1)
    held = docs.select("doc_id", "text").join(broadcast_if_small(settle(places, "places")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for laid in laid_out(batch.column(1)):
                part = lists.slice(laid.doc[0], len(laid.doc))
                spots = pc.list_flatten(part).to_numpy() + laid.begin[pc.list_parent_indices(part).to_numpy()]
                h, place = bare_windows(laid, spots, whole)
                h = numbered_in_runs(h.view(np.uint64), place, whole)[0].view(np.int64)
                doc = laid.owner(place)
                once = firsts(h, doc)
                h, place, doc = h[once], place[once], doc[once]
                cols = ids[laid.doc[doc]], h, (place - laid.begin[doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "h", "at"])

    windows = settle(held.mapInArrow(run, "doc_id long, h long, at int"), "windows")
    first = windows.groupBy("h").agg(F.min(F.struct(F.col("doc_id").alias("source"), F.col("at").alias("s_at"))).alias("f"), F.count("*").alias("docs"))
    first = broadcast_if_small(settle(first.where("docs > 1").select("h", "f.source", "f.s_at"), "first"))
    met = windows.join(first, "h").where("doc_id <> source")
    return met.select("doc_id", "source", "at", "s_at", F.lit(True).alias("long"))


def seed_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, first, again, bare, since, near): the seeds; ``first`` of that hash in
    the document, ``again`` where it goes on a run of itself, ``since`` so many places,
    ``bare`` in all of a run, ``near`` what lies ``beside``."""
    names = ["doc_id", "h", "at", "first", "again", "bare", "since", "near"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for laid in laid_out(batch.column(1)):
                h, at, since, runs = seeds(laid)
                doc = laid.owner(at)
                row = (ids[laid.doc[doc]], h, (at - laid.begin[doc]).astype(np.int32), firsts(h, doc), since > 0, runs, since, beside(laid.one, at))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names)

    kinds = "doc_id long, h long, at int, first boolean, again boolean, bare boolean, since int, near long"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def met_in_group(cols: list[np.ndarray], crowd: int) -> list[np.ndarray]:
    """Columns of ``meetings`` from whole groups of rows in order of h, doc and place."""
    doc, h, at, first, again, bare, since, near = cols
    new = np.append(True, h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    docs = np.bincount(group, first).astype(np.int32)[group]
    heads = np.flatnonzero(first)
    rank = np.cumsum(first) - 1  # of the row's document among all heads
    least = rank[np.flatnonzero(new)][group]  # that of its group's first document
    bare = (docs > crowd) | (np.bincount(group, bare)[group] > 0)
    keep = np.flatnonzero((docs > 1) | bare)
    rows, sources = [keep], [np.full(len(keep), -1)]
    for t in range(crowd - 1):
        later = np.flatnonzero((docs <= crowd) & (rank - least > t))
        rows.append(later)
        sources.append(heads[least[later] + t])
    row, source = np.concatenate(rows), np.concatenate(sources)
    lead = np.zeros(len(row), bool)
    lead[len(rows[0]) : len(rows[0]) + len(rows[1])] = True
    left, right = going_on(near[row], near[source])
    own = [doc[row], h[row], at[row], first[row], again[row], bare[row], docs[row]]
    return [*own, np.where(source < 0, -1, at[source]), np.where(source < 0, 0, doc[source]), since[row], lead, left, right]


def meetings(seeded: DataFrame) -> DataFrame:
    """(doc_id, h, at, first, again, bare, docs, s_at, source, since, lead, left, right)
    of two kinds.  With s_at -1: each occurrence of a seed of several documents, or that
    is of a run anywhere, with the number of documents that have it (past HOLDERS + 1 not
    counted in full); ``bare`` if it is crowded or of a run anywhere, so may not meet all
    others.  Other rows: each occurrence of a seed of HOLDERS + 1 documents at most with
    each document before its own that has it, ``lead`` the first of them, ``left`` and
    ``right`` how far both texts may go on alike.

    Rows come in order of their seed; only what may belong to an unfinished seed of
    few documents is held from one batch to the next."""
    crowd = HOLDERS + 1
    kinds = {"doc_id": "long", "h": "long", "at": "int", "first": "boolean", "again": "boolean", "bare": "boolean", "docs": "int", "s_at": "int", "source": "long"}
    kinds |= {"since": "int", "lead": "boolean", "left": "int", "right": "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            as_numpy = {"long": np.int64, "int": np.int32, "boolean": bool}
            return pa.RecordBatch.from_arrays([pa.array(c.astype(as_numpy[k])) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

        held: list[np.ndarray] | None = None
        hot = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if hot is not None and len(cols[1]):
                end = int(np.searchsorted(cols[1], hot, "right"))
                if end:
                    none = np.zeros(end)
                    yield out([c[:end] for c in cols[:5]] + [np.ones(end, bool), np.full(end, crowd + 1), np.full(end, -1), none, cols[6][:end], none, none, none])
                    cols = [c[end:] for c in cols]
            if not len(cols[1]):
                held = cols
                continue
            last = int(np.searchsorted(cols[1], cols[1][-1]))
            if cols[3][last:].sum() > crowd:
                hot, last = cols[1][-1], len(cols[1])
            if last:
                yield out(met_in_group([c[:last] for c in cols], crowd))
            held = [c[last:] for c in cols]
        if held is not None and len(held[1]):
            yield out(met_in_group(held, crowd))

    for name, kind in (("since", "int"), ("near", "long")):
        seeded = seeded if name in seeded.columns else seeded.withColumn(name, F.lit(0).cast(kind))
    ordered = seeded.repartition("h").sortWithinPartitions("h", "doc_id", "at")
    return ordered.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def beyond(near: DataFrame, crowd: DataFrame, long: DataFrame, spans: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """(doc_id, source, at, s_at, long): all matches of the pairs whose passages may reach
    out of the passages found before.

    ``long`` are matches of whole runs, which have been aligned.  A pair is left out where all of its matches, with the words by which its last and
    first uncrowded ones may go on alike, lie in one passage of the document and in one
    of the source: of that stretch nothing new can come.  So copies of one passage are
    aligned with one document each, not with each other."""
    plain = ["doc_id", "source", "at", "s_at"]
    met = crowd.select("doc_id", "at", F.inline("holders")).where("doc_id <> source").select(*plain)
    none = F.lit(0)
    ends = near.groupBy("doc_id", "source").agg(
        F.count("*").alias("n"),
        F.min("at").alias("x"),
        F.max("at").alias("y"),
        F.min_by(F.greatest(F.col("at") - F.col("left"), none), "at").alias("lo"),
        F.max_by(F.col("at") + K + F.col("right"), "at").alias("hi"),
        F.min_by(F.greatest(F.col("s_at") - F.col("left"), none), "s_at").alias("s_lo"),
        F.max_by(F.col("s_at") + K + F.col("right"), "s_at").alias("s_hi"),
    )
    more = met.groupBy("doc_id", "source").agg(
        F.count("*").alias("c_n"), F.min("at").alias("c_x"), F.max("at").alias("c_y"), F.min("s_at").alias("c_lo"), F.max("s_at").alias("c_hi")
    )
    ends = ends.join(more, ["doc_id", "source"], "full_outer").select(
        "doc_id",
        "source",
        (F.coalesce("n", none) + F.coalesce("c_n", none)).alias("n"),
        (F.greatest("y", "c_y") - F.least("x", "c_x")).alias("apart"),
        F.least("lo", "c_x").alias("lo"),
        F.greatest("hi", F.col("c_y") + K).alias("hi"),
        F.least("s_lo", "c_lo").alias("s_lo"),
        F.greatest("s_hi", F.col("c_hi") + K).alias("s_hi"),
    )
    ends = ends.where((F.col("n") > 1) & (F.col("apart") >= least))
    reach = F.struct("lo", F.when(F.col("hi") == F.col("n"), 2 * UNTOLD).otherwise(F.col("hi")).alias("hi"))
    known = outermost(spans.select("doc_id", "lo", "hi")).join(sizes.select("doc_id", "n"), "doc_id")
    known = broadcast_if_small(settle(known.groupBy("doc_id").agg(F.collect_set(reach).alias("known")), "known"))
    both = ends.join(known, "doc_id", "left").join(known.toDF("source", "s_known"), "source", "left")

    def inside(name: str, lo: str, hi: str) -> Column:
        return F.coalesce(F.exists(name, lambda z: (z["lo"] <= F.col(lo)) & (z["hi"] >= F.col(hi))), F.lit(False))

    out = both.where(~(inside("known", "lo", "hi") & inside("s_known", "s_lo", "s_hi"))).select("doc_id", "source")
    out = broadcast_if_small(settle(out, "beyond"))
    return near.select(*plain).unionByName(met).withColumn("long", F.lit(False)).unionByName(long).join(out, ["doc_id", "source"], "left_semi")


def left_open(docs: DataFrame, seeded: DataFrame, spans: DataFrame, near: int, far: int, min_words: int, identity: float) -> DataFrame:
    """(doc_id, source, at, s_at, long): the crowded seeds that lie in no span,
    with every document that has them and, ``near`` to ``far`` words away in both, a
    second seed that is not of the same run of one seed; such runs by ``open_runs``.

    The first of two seeds goes on no run: documents that share the n-th of a run
    share its first.  Two seeds that more than FEW documents share make a pair only where
    the words in and around them may add up to a passage (``may_pass``), so a line or two
    of which many documents consist but for other words makes none."""
    inside = (F.col("s.doc_id") == F.col("o.doc_id")) & F.col("at").between(F.col("lo"), F.col("hi") - K)
    crowded = seeded.where(F.col("docs") > HOLDERS + 1).select("doc_id", "h", "at", "since")
    outside = settle(crowded.alias("o").join(outermost(spans).select("doc_id", "lo", "hi").alias("s"), inside, "left_anti"), "outside")
    several = seeded.where("docs > 1").select("doc_id", "h", "at", "since")

    def two(ones: DataFrame, others: DataFrame) -> DataFrame:
        apart = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.at") - F.col("a.at")).between(near, far)
        both = ones.where("since = 0").alias("a").join(others.alias("b"), apart).where("b.since = 0 or b.at - b.since <> a.at")
        both = both.select("a.doc_id", F.col("a.h").alias("h1"), F.col("b.h").alias("h2"), F.struct(F.col("a.at").alias("p1"), F.col("b.at").alias("p2")).alias("p"))
        return both.groupBy("doc_id", "h1", "h2").agg(F.min("p").alias("p"))

    touched = broadcast_if_small(settle(outside.select("doc_id").distinct(), "touched"))
    local = several.join(touched, "doc_id", "left_semi")
    mine = two(outside, local).unionByName(two(local, outside)).distinct()
    mine = settle(mine, "mine")
    heads = broadcast_if_small(settle(mine.select(F.col("h1").alias("h")).distinct(), "heads-two"))
    tails = broadcast_if_small(settle(mine.select(F.col("h2").alias("h")).distinct(), "tails-two"))
    theirs = settle(two(several.join(heads, "h", "left_semi"), several.join(tails, "h", "left_semi")), "theirs")
    many = theirs.groupBy("h1", "h2").count().where(F.col("count") > FEW).select("h1", "h2")
    many = broadcast_if_small(settle(many, "many"))
    few = mine.join(many, ["h1", "h2"], "left_anti").alias("m").join(theirs.alias("t"), ["h1", "h2"]).where("m.doc_id <> t.doc_id")
    met = few.select("m.doc_id", "m.p", F.col("t.doc_id").alias("t_doc"), F.col("t.p").alias("t_p"))
    own = mine.join(many, ["h1", "h2"], "left_semi").withColumn("own", F.lit(True))
    own = own.unionByName(theirs.join(many, ["h1", "h2"], "left_semi").withColumn("own", F.lit(False)))
    told = settle(surrounded(docs, own, far, min_words), "surrounded")
    m, t = told.where("own").alias("m"), told.where("not own").alias("t")
    met = met.unionByName(m.join(t, may_pass(min_words, identity)).select("m.doc_id", "m.p", F.col("t.doc_id").alias("t_doc"), F.col("t.p").alias("t_p")))
    turned = F.col("doc_id") > F.col("t_doc")
    later, earlier = F.when(turned, F.col("p")).otherwise(F.col("t_p")), F.when(turned, F.col("t_p")).otherwise(F.col("p"))
    met = met.select(F.greatest("doc_id", "t_doc").alias("doc_id"), F.least("doc_id", "t_doc").alias("source"), later.alias("l"), earlier.alias("e"))
    ends = F.array(*(F.struct(F.col(f"l.p{i}").alias("at"), F.col(f"e.p{i}").alias("s_at")) for i in (1, 2)))
    met = met.select("doc_id", "source", F.inline(ends)).unionByName(open_runs(docs, several, outside, near, far, min_words))
    return met.withColumn("long", F.lit(False))


def outer(min_words: int) -> int:
    """Longs of eight words by which a passage may stick out of its two seeds."""
    return -(-max(min_words - K, 1) // 8)


def surrounded(docs: DataFrame, two: DataFrame, far: int, min_words: int) -> DataFrame:
    """``two`` with what their texts hold: a byte each for the words before the first (l0
    on, nearest first) and after the second seed (r0 on), and a bit of BAG for each word
    between them.  Out of the text a byte is 0 in one's ``own`` rows and 255 in others."""
    width = 8 * outer(min_words)
    names = [f"{side}{i}" for side in "lr" for i in range(width // 8)] + [f"b{i}" for i in range(BAG // 64)]
    rows = two.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2", F.col("p.p1").alias("p1"), F.col("p.p2").alias("p2"), "own")).alias("rows"))
    held = docs.select("doc_id", "text").join(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for laid in laid_out(batch.column(1)):
                part = batch.column(2).slice(laid.doc[0], len(laid.doc))
                flat, text = pc.list_flatten(part), pc.list_parent_indices(part).to_numpy()
                for lo in range(0, len(flat), HELD):
                    doc = text[lo : lo + HELD]
                    h1, h2, p1, p2, own = (c.to_numpy(zero_copy_only=False) for c in flat.slice(lo, HELD).flatten())
                    begin, end = laid.begin[doc][:, None], (laid.begin + laid.length)[doc][:, None]
                    a, b, step = begin + p1[:, None], begin + p2[:, None], np.arange(width)
                    sides = []
                    for at in (a - 1 - step, b + K + step):
                        there = (at >= begin) & (at < end)
                        code = (laid.one[np.where(there, at, 0)] % np.uint64(254) + np.uint64(1)).astype(np.uint8)
                        sides.append(np.where(there, code, np.where(own, 0, 255)[:, None].astype(np.uint8)).view("<i8"))
                    at = a + K + np.arange(max(far - K, 1))
                    row, col = np.nonzero(at < b)
                    bag = np.zeros((len(doc), BAG), bool)
                    bag[row, (laid.one[at[row, col]] >> np.uint64(32)) % np.uint64(BAG)] = True
                    cols = [*sides[0].T, *sides[1].T, *np.packbits(bag, 1).view("<i8").T]
                    first = [ids[laid.doc[doc]], h1, h2, p1, p2, own]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in first + cols], ["doc_id", "h1", "h2", "p1", "p2", "own", *names])

    kinds = "doc_id long, h1 long, h2 long, p1 int, p2 int, own boolean, " + ", ".join(f"{name} long" for name in names)
    found = held.mapInArrow(run, kinds)
    return found.select("doc_id", "h1", "h2", F.struct("p1", "p2").alias("p"), "own", *names)


def may_pass(min_words: int, identity: float) -> Column:
    """True for two rows m and t of ``surrounded`` that a passage may hold: as many words may
    be equal as it needs at least.  Out of the first and the last of its seeds it goes on
    without shifts, so equal words have equal places; between the two, a word whose bit
    the other text lacks is equal to none."""

    def equal(name: str) -> Column:
        x = F.col(f"m.{name}").bitwiseXOR(F.col(f"t.{name}"))
        for by in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    def between(one: str, other: str) -> Column:
        lacks = [F.bit_count(F.col(f"{one}.b{i}").bitwiseAND(F.bitwise_not(f"{other}.b{i}"))) for i in range(BAG // 64)]
        return F.col(f"{one}.p.p2") - F.col(f"{one}.p.p1") - K - reduce(add, lacks)

    out = reduce(add, [equal(f"{side}{i}") for side in "lr" for i in range(outer(min_words))])
    apart = F.greatest(F.col("m.p.p2") - F.col("m.p.p1"), F.col("t.p.p2") - F.col("t.p.p1"))
    needed = F.greatest(F.lit(min_words), apart + K) * identity
    same = (F.col("m.h1") == F.col("t.h1")) & (F.col("m.h2") == F.col("t.h2")) & (F.col("m.doc_id") != F.col("t.doc_id"))
    return same & (F.least(between("m", "t"), between("t", "m")) + out + 2 * K >= needed - 1e-6)


def around(one: np.ndarray, p: int, last: int, far: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what lies at each distance from a run of one seed at the places ``p`` to
    ``last``, two words each, and which of them a passage that is to stick out of the run
    may end with; a run as long as a passage but for a word at either end has one more."""
    lo, hi = p, last + K
    while lo and one[lo - 1] == one[p]:
        lo -= 1
    while hi < len(one) and one[hi] == one[p]:
        hi += 1
    at = np.arange(max(p - far, 0), min(p + 2 * far, len(one) - 1))
    out = max((min_words - (hi - lo) + 1) // 2, 2)
    h = (one[at] * MIX + one[at + 1]) * MIX + (at - p).astype(np.uint64)
    telling = (at >= hi + out - 2) | (at <= lo - out)
    if hi - lo >= min_words - 2:
        return np.append(h, np.uint64(1)), np.append(telling, True)
    return h, telling


def open_runs(docs: DataFrame, several: DataFrame, outside: DataFrame, near: int, far: int, min_words: int) -> DataFrame:
    """(doc_id, source, at, s_at): runs of one seed ("no no no ..."), of which a part lies in
    no span, with those of all other documents where a passage can come of it.

    Two runs that are too short for a passage and have nothing alike around them are
    none.  A passage is longer than the shorter run, and it ends with two equal words: so
    both texts hold two words, at the same distance from the first seed, that lie out of
    the shorter run.  Documents are joined by those."""
    runs = several.where("since > 0").groupBy("doc_id", (F.col("at") - F.col("since")).alias("p"))
    runs = runs.agg(F.min_by("h", "at").alias("h"), F.sort_array(F.collect_list("at")).alias("places")).where(F.element_at("places", -1) - F.col("p") >= near)
    runs = settle(runs.withColumn("places", F.concat(F.array("p"), "places")), "runs")
    opened = broadcast_if_small(settle(outside.select("doc_id", (F.col("at") - F.col("since")).alias("p")).distinct(), "opened"))
    wanted = broadcast_if_small(settle(runs.join(opened, ["doc_id", "p"], "left_semi").select("h").distinct(), "wanted"))
    runs = settle(runs.join(wanted, "h", "left_semi"), "wanted-runs")
    lists = runs.groupBy("doc_id").agg(F.collect_list(F.struct("h", "p", F.element_at("places", -1).alias("last"))).alias("runs"))
    held = docs.select("doc_id", "text").join(broadcast_if_small(settle(lists, "run-lists")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool))]
            for d, t, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                one = word_hashes(words_of(t.as_py()))
                for r in own:
                    h, telling = around(one, r["p"], r["last"], far, min_words)
                    h = (h ^ np.int64(r["h"]).astype(np.uint64)) * MIX
                    parts.append((np.full(len(h), d, np.int64), np.full(len(h), r["p"], np.int32), (h ^ (h >> np.uint64(29))).view(np.int64), telling))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["doc_id", "p", "key", "telling"])

    keyed = settle(held.mapInArrow(run, "doc_id long, p int, key long, telling boolean"), "around")
    mine = keyed.join(opened, ["doc_id", "p"], "left_semi")

    def meet(ones: DataFrame, others: DataFrame) -> DataFrame:
        both = ones.alias("m").join(others.alias("t"), "key").where("m.doc_id <> t.doc_id")
        return both.select("m.doc_id", "m.p", F.col("t.doc_id").alias("t_doc"), F.col("t.p").alias("t_p"))

    met = meet(mine.where("telling"), keyed).unionByName(meet(mine, keyed.where("telling")))
    turned = F.col("doc_id") > F.col("t_doc")
    pick = lambda a, b: F.when(turned, F.col(a)).otherwise(F.col(b))
    met = met.select(pick("doc_id", "t_doc").alias("doc_id"), pick("p", "t_p").alias("p"), pick("t_doc", "doc_id").alias("source"), pick("t_p", "p").alias("s_p"))
    met = settle(met.distinct(), "met-runs")
    own = runs.select("doc_id", "p", F.posexplode("places").alias("i", "at"))
    others = own.toDF("source", "s_p", "i", "s_at")
    return met.join(own, ["doc_id", "p"]).join(others, ["source", "s_p", "i"]).select("doc_id", "source", "at", "s_at")


def points(x: np.ndarray, y: np.ndarray, long: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Matches of k words: the short ones and, every k words, those along the long
    ones, which are joined where they overlap at the same distance of places."""
    if not long.any():
        return x, y
    order = np.lexsort((x[long], (y - x)[long]))
    start, shift = x[long][order], (y - x)[long][order]
    new = np.ones(len(start), bool)
    new[1:] = (shift[1:] != shift[:-1]) | (start[1:] > start[:-1] + length)
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)] + length
    along = [np.append(np.arange(a, b - k, k), b - k) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    moved = np.repeat(shift[new], [len(a) for a in along])
    px = np.concatenate(along)
    both = np.unique(np.stack([np.append(px, x[~long]), np.append(px + moved, y[~long])]), axis=1)
    return both[0], both[1]


def chains(x: np.ndarray, y: np.ndarray, k: int = K) -> list[list[int]]:
    """Chains of matches increasing in ``x`` and ``y``, best first, no match in
    two.  A match adds k; a step costs GAP_COST a word moved in either text.  The
    best predecessor is a prefix maximum over y in a Fenwick tree."""
    if len(x) and (np.diff(x) > 0).all() and (np.diff(y) > 0).all():
        return chains_in_line(x, y, k)
    order = np.lexsort((-y, x))
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max(initial=0))
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = np.zeros(len(x)), np.full(len(x), -1)
    for i in order.tolist():
        at, best = int(ranks[i]) - 1, (-1e18, -1)
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        walked = GAP_COST * float(x[i] + y[i])
        gain = best[0] - walked
        score[i], before[i] = (k + gain, best[1]) if gain > 0 else (k, -1)
        entry, at = (score[i] + walked, i), int(ranks[i])
        while at <= size:
            if entry > tree[at]:
                tree[at] = entry
            at += at & -at
    return taken(score, before.tolist())


def chains_in_line(x: np.ndarray, y: np.ndarray, k: int) -> list[list[int]]:
    """``chains`` of matches that increase in both texts: the best predecessor is
    the match before, as it adds k on the same way."""
    steps = GAP_COST * np.diff(x + y)
    if (steps < k).all():
        return [list(range(len(x)))]
    score, before, last, step = [float(k)], [-1], float(k), steps.tolist()
    for i, cost in enumerate(step):
        gain = last - cost
        last = k + gain if gain > 0 else float(k)
        score.append(last)
        before.append(i if gain > 0 else -1)
    return taken(np.array(score), before)


def taken(score: np.ndarray, before: list[int]) -> list[list[int]]:
    """Chains by their last match's score, each up to a match that one before has."""
    out, used = [], [False] * len(before)
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Words in the longest common subsequence, a row of the table held in the
    bits of one number (a zero bit where the row's length grows)."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        if held := places.get(w):
            met = row & held
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def extend(a: list[bytes], b: list[bytes], i: int, j: int, step: int, drop: int = 5) -> int:
    """Words by which equal places from (i, j) on go on in direction ``step``:
    up to the best score, 1 for equal words and -1 for others, until it has
    fallen by ``drop``."""
    score = best = length = n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - drop:
        score += 1 if a[i] == b[j] else -1
        n += 1
        if score > best:
            best, length = score, n
        i, j = i + step, j + step
    return length


def pieces(a: list[bytes], b: list[bytes], x: list[int], y: list[int], identity: float, k: int = K) -> list[tuple[int, int, int, int, float]]:
    """First and end word in both texts of each aligned piece of a chain, and the
    share of equal words: seeds and their gaps inside, then extension at both
    ends.  A piece under ``identity`` is cut at the gap that costs it most.
    """
    same = [k]
    for t in range(1, len(x)):
        i, j, step = x[t - 1] + k, y[t - 1] + k, x[t] - x[t - 1]
        if step == y[t] - y[t - 1] and (step <= k or a[i : x[t]] == b[j : y[t]]):
            same.append(step)
            continue
        over = max(i - x[t], j - y[t], 0)
        p, q = x[t] + over, y[t] + over
        inside = common_words(a[i:p], b[j:q]) if p - i != q - j else sum(map(bytes.__eq__, a[i:p], b[j:q]))
        same.append(inside + k - over)
    cost = identity * np.maximum(np.diff(x), np.diff(y)) - same[1:]
    total, out, left = np.cumsum(same), [], [(0, len(x) - 1)]
    while left:
        s, e = left.pop()
        back, on = extend(a, b, x[s] - 1, y[s] - 1, -1), extend(a, b, x[e] + k, y[e] + k, 1)
        lo, lo_b, hi, hi_b = x[s] - back, y[s] - back, x[e] + k + on, y[e] + k + on
        equal = int(total[e] - total[s]) + k + sum(map(bytes.__eq__, a[lo : x[s]], b[lo_b : y[s]]))
        equal += sum(map(bytes.__eq__, a[x[e] + k : hi], b[y[e] + k : hi_b]))
        share = equal / max(hi - lo, hi_b - lo_b)
        if share >= identity:
            out.append((lo, hi, lo_b, hi_b, share))
        elif s < e:
            cut = s + int(cost[s:e].argmax())
            left += [(s, cut), (cut + 1, e)]
    return out


def with_holders(found: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """(doc_id, at, long, holders): each occurrence of a seed that several
    documents have, with the first document that has it and the HOLDERS last
    ones before its own, as (source, s_at).

    A seed of more than ``ordered`` occurrences is dealt over parts by doc_id, each
    of which has a hash of its own, so shuffles by itself, and has the same first
    document.  A place and its two flags travel as one number.
    """
    counted = found.groupBy("h").agg(F.min("doc_id").alias("source"), F.count(F.when(F.col("first"), 1)).alias("docs"), F.count("*").alias("held"))
    parts = F.ceil(F.col("held") / ordered).alias("parts")
    repeated = settle(counted.where("docs > 1").select("h", "source", parts), "repeated")
    hot = broadcast_if_small(settle(repeated.where("parts > 1"), "hot"))
    heads = found.join(hot, "h").where("doc_id = source").groupBy("h").agg(F.min("at").alias("s_at"))
    heads = broadcast_if_small(settle(heads, "heads"))
    own_hash = lambda part: F.when(F.col("parts") > 1, F.xxhash64("h", part)).otherwise(F.col("h")).alias("h")
    dealt = repeated.join(heads, "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(own_hash(F.col("part")), "source", "s_at")
    spot = (F.col("at").cast("long") * 4 + F.col("long").cast("int") * 2 + F.col("first").cast("int")).alias("spot")
    placed = found.join(hot.select("h", "parts"), "h", "left")
    placed = placed.select(own_hash(F.pmod(F.xxhash64("doc_id"), F.col("parts"))), "doc_id", spot)

    at = F.shiftright("spot", 2).cast("int")
    order = Window.partitionBy("h").orderBy("doc_id", "spot")
    holder = F.when(F.col("spot") % 2 == 1, F.struct(F.col("doc_id").alias("source"), at.alias("s_at")))
    last = F.collect_list(holder).over(order.rowsBetween(-HOLDERS, -1))
    own = F.first(at).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.struct("source", F.coalesce("s_at", own).alias("s_at"))
    is_long = (F.col("spot").bitwiseAND(2) == 2).alias("long")
    return placed.join(dealt, "h").select("doc_id", at.alias("at"), is_long, F.array_append(last, first).alias("holders"))


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """doc_id, first_word, end_word, words, source_doc_id, identity.

    One row for each passage of ``min_words`` or more words of a document that
    another document repeats, word places counted from 0, ends exclusive.  Every
    passage is judged by itself against one source: shorter pieces never add up
    to one, and no source is given words that it lacks.  A passage inside
    another one of its document is left out; of equal ones that with the smallest
    ``source_doc_id`` stays.  A source has rows of its own, with itself as
    source.  Texts of the same words are one passage each.

    Null and empty texts have no passages; rows without doc_id take no part;
    repeated rows count once (of different texts under one doc_id, the first by
    md5); an empty table gives an empty result; other columns are ignored.
    """
    known = one_text_per_id(docs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words_of(t.as_py()) for t in batch.column(1)]
            keys = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(map(len, own), pa.int32())], ["doc_id", "key", "n"])

    keys = settle(known.mapInArrow(describe, "doc_id long, key binary, n int"), "keys")
    firsts = keys.groupBy("key").agg(F.min("doc_id").alias("source"), F.count("*").alias("copies")).where("copies > 1")
    copies = settle(keys.join(settle(firsts, "firsts"), "key"), "copies")
    whole = copies.where(F.col("n") >= min_words).select("doc_id", F.lit(0).alias("lo"), F.col("n").alias("hi"), "source", F.lit(1.0).alias("identity"))
    again = copies.where("doc_id <> source").select("doc_id").unionByName(keys.where(F.col("n") < min_words).select("doc_id"))
    alone = known.join(broadcast_if_small(settle(again, "again")), "doc_id", "left_anti")

    met = settle(meetings(seed_table(alone)), "met")
    seeded = met.where("s_at < 0")
    crowded = seeded.where(F.col("docs") > HOLDERS + 1).select("doc_id", "h", "at", F.lit(False).alias("long"), "first")
    crowd = settle(with_holders(settle(crowded, "crowded")).select("doc_id", "at", "holders"), "holders")
    near = met.where("s_at >= 0")
    first = crowd.select("doc_id", "at", F.element_at("holders", -1).alias("f")).select("doc_id", "f.source", "at", "f.s_at").where("doc_id <> source")
    heads = near.where("lead").select("doc_id", "source", "at", "s_at").unionByName(first).withColumn("long", F.lit(False))
    long = settle(crowded_matches(alone, seeded, min_words), "long") if min_words >= K else heads.limit(0)
    spans = settle(aligned_spans(alone, heads.unionByName(long), min_words, identity).unionByName(whole), "spans")
    least = max(min_words // 3 - K, 1)
    rest = beyond(near, crowd, long, spans, keys, least)
    spans = settle(spans.unionByName(aligned_spans(alone, rest, min_words, identity)), "more-spans")
    rest = left_open(alone, seeded, spans, least, int(min_words / identity) + 2, min_words, identity)
    spans = spans.unionByName(aligned_spans(alone, rest, min_words, identity))
    spans = spans.groupBy("doc_id", "lo", "hi").agg(F.min(F.struct("source", (-F.col("identity")).alias("other"))).alias("best"))
    return outermost(settle(spans, "all-spans")).select(
        "doc_id",
        F.col("lo").cast("long").alias("first_word"),
        F.col("hi").cast("long").alias("end_word"),
        (F.col("hi") - F.col("lo")).cast("long").alias("words"),
        F.col("best.source").alias("source_doc_id"),
        (-F.col("best.other")).alias("identity"),
    )


def aligned_spans(alone: DataFrame, matches: DataFrame, min_words: int, identity: float) -> DataFrame:
    """(doc_id, lo, hi, source, identity): the passages that the matches of each
    document and source lead to, in both."""
    pairs = matches.groupBy("doc_id", "source").agg(F.collect_set(F.struct("at", "s_at", "long")).alias("m"))
    apart = F.array_max("m.at") - F.array_min("m.at") >= min_words // 3 - K
    pairs = pairs.where(((F.size("m") >= 2) & apart) | F.exists("m", lambda m: m["long"]))
    pairs = settle(pairs.select("doc_id", "source", F.col("m.at").alias("x"), F.col("m.s_at").alias("y"), F.col("m.long").alias("long")), "pairs")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sources = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())).tolist()
            x, y, long = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            x, y = x.astype(np.int64), y.astype(np.int64)
            row, lengths, px, py = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                xs, ys, is_long = x[lo:hi], y[lo:hi], long[lo:hi]
                if is_long.any():
                    xs, ys = points(xs, ys, is_long, min_words)
                else:
                    order = np.lexsort((ys, xs))
                    xs, ys = xs[order], ys[order]
                for chain in chains(xs, ys):
                    if len(chain) > 1 and xs[chain[-1]] + K - xs[chain[0]] >= min_words // 3:
                        row.append(i)
                        lengths.append(len(chain))
                        px.append(xs[chain])
                        py.append(ys[chain])
            offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
            cols = [docs[row], sources[row]] if row else [docs[:0], sources[:0]]
            lists = [pa.ListArray.from_arrays(offsets, np.concatenate(c)) for c in (px, py)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *lists], ["doc_id", "source", "x", "y"])

    linked = settle(pairs.mapInArrow(link, "doc_id long, source long, x array<long>, y array<long>"), "chains")
    needed = settle(linked.select(F.explode(F.array("doc_id", "source")).alias("doc_id")).distinct(), "needed")
    texts = settle(alone.join(broadcast_if_small(needed), "doc_id", "left_semi"), "texts")
    both = linked.join(texts.withColumnRenamed("text", "a"), "doc_id").join(texts.toDF("source", "b"), "source")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            own, other = (None, []), (None, [])
            for d, s, x, y, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = own if own[0] == d else (d, words_of(a))
                other = other if other[0] == s else (s, words_of(b))
                for lo, hi, s_lo, s_hi, same in pieces(own[1], other[1], x, y, identity):
                    if min(hi - lo, s_hi - s_lo) >= min_words:
                        rows += [(d, lo, hi, s, same), (s, s_lo, s_hi, s, 1.0)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "lo", "hi", "source", "identity"])  # noqa: E501

    both = both.select("doc_id", "source", "x", "y", "a", "b")
    return both.mapInArrow(aligned, "doc_id long, lo int, hi int, source long, identity double")


def outermost(spans: DataFrame) -> DataFrame:
    """The distinct spans of each document that lie in no other one."""
    by_start = Window.partitionBy("doc_id").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("hi").over(by_start)).where("reach is null or hi > reach").drop("reach")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
