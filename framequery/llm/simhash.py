"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common variant within
r/2 flips of both.  So every *distinct* fingerprint emits all its variants
within half the radius, the variants are shuffled, and fingerprints that meet
are linked and verified.  Copies collapse before anything is emitted, and no
more fingerprints can meet in one variant than the ball around it has points,
so no group depends on the data's skew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from framequery.llm.common import broadcast_if_small, one_text_per_id, settle, table
from framequery.llm.components import connected_components

BLOCK = 65_536
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int) -> list[bytes]:
    """Word shingles, repeats included; fewer words give the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[s:e] for s, e in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


def fingerprint_bits(text: str | None, size: int, seeds: list[int], distinct: bool = False) -> np.ndarray:
    """64 majority bits for each seed, in order; of ``distinct`` shingles or of all."""
    parts = shingles(text, size)
    parts = list(dict.fromkeys(parts)) if distinct else parts
    out = np.zeros((len(seeds), 64), np.uint8)
    for k, seed in enumerate(seeds):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(parts), BLOCK):
            h = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts[at : at + BLOCK]], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = 2 * ones > len(parts)
    return out.ravel()


def fingerprints(docs: DataFrame, size: int = 3, bits: int = 64, tables: int = 1, seed: int = 42, distinct: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced by ``fps``, an array of ``tables``
    fingerprints of ``bits`` bits each.

    Null texts are read as empty; a text without words has fingerprint zero.
    """
    if bits not in (32, 64) or tables * bits % 64:
        raise ValueError("bits must be 32 or 64 and fill whole 64-bit hashes")
    seeds = [seed + k for k in range(tables * bits // 64)]
    others = [c for c in docs.columns if c != "text"]
    schema = StructType([*docs.select(*others).schema.fields, StructField("fps", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for t in batch.column(len(others)):
                packed = np.packbits(fingerprint_bits(t.as_py(), size, seeds, distinct), bitorder="little")
                fps.append(packed.view("<i8" if bits == 64 else "<u4").astype(np.int64).tolist())
            kept = [batch.column(k) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.list_(pa.int64()))], [*others, "fps"])

    return docs.select(*others, "text").mapInArrow(run, schema)


def masks(bits: int, flips: int) -> list[int]:
    """All words of ``bits`` bits with at most ``flips`` ones, as signed longs."""
    words = [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)]
    return [w - (1 << 64) if w >= 1 << 63 else w for w in words]


def meetings(points: DataFrame, bits: int, radius: int) -> DataFrame:
    """(tab, fp, rep) -> (tab, a, b, rep_a, rep_b): each variant's fingerprint of
    the smallest ``rep`` with every other one there, verified to be within
    ``radius`` bits.

    Every two fingerprints within the radius share a variant, and all that
    share one are linked to its first, so linked fingerprints stay connected
    while the links grow with the fingerprints, not with the pairs.
    """
    ball = F.array(*[F.lit(m).cast("long") for m in masks(bits, (radius + 1) // 2)])
    emitted = points.select("tab", "fp", "rep", F.explode(ball).alias("mask"))
    emitted = emitted.select("tab", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    meet = Window.partitionBy("variant", "tab").orderBy("rep", "fp").rowsBetween(Window.unboundedPreceding, 0)
    first = emitted.withColumn("a", F.first("fp").over(meet)).withColumn("rep_a", F.first("rep").over(meet))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    return first.where("a <> fp").where(close).select("tab", "a", F.col("fp").alias("b"), "rep_a", F.col("rep").alias("rep_b")).distinct()


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Documents link where their 64-bit fingerprints differ in at most ``radius``
    bits; component_id is the smallest doc_id reachable.  Null texts count as
    empty, and all empty texts share fingerprint zero; a null doc_id is kept and
    never is a component_id unless its component has no other; repeated rows
    give repeated results; an empty table gives an empty result.  The radius is
    even: the first of a variant is linked to all others there, which needs each
    to be within the radius of it.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    known = docs.select(F.col("doc_id").cast("long"), "text")
    prints = settle(fingerprints(known, size).select("doc_id", F.col("fps")[0].alias("fp")), "prints")
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    links = meetings(points.withColumn("tab", F.lit(0)), 64, radius)
    roots = connected_components(links.select("a", "b"))
    grouped = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = settle(grouped.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "grouped")
    least = settle(grouped.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    members = settle(grouped.join(least, "root").select("fp", "component_id"), "members")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(members, "fp").select("doc_id", digits, "component_id")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The set of a text's word shingles as hashes in order, each made of the
    hashes of its words; fewer words give one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * MIX + one[j : j + len(h)]
    h = (h ^ (h >> np.uint64(31))) * MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def shingle_sets(docs: DataFrame, size: int, similarity: float, last: np.ndarray) -> DataFrame:
    """(doc_id, text) -> (doc_id, key, n, prefix): a digest of the set of shingle
    hashes, its size, and the first of its hashes in an order that all texts
    share: ``last`` comes last, in its own order, the others go by value.

    The prefix is so long that two sets with the similarity always share one of
    its hashes: they share at least similarity * n of the n, so of any
    n - similarity * n + 1 one is shared.
    """
    by_value = np.argsort(last)
    sorted_last = last[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prefixes, bits = [], [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), size)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                found = np.minimum(np.searchsorted(sorted_last, h), max(len(last) - 1, 0))
                late = sorted_last[found] == h if len(last) else np.zeros(len(h), bool)
                ordered = np.concatenate([h[~late], last[np.sort(by_value[found[late]])]])
                bits.append(parity_bits(h))
                prefixes.append(ordered[: len(h) - math.ceil(similarity * len(h) - 1e-6) + 1].view(np.int64))
            lists = pa.array(prefixes, pa.list_(pa.int64()))
            arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key binary, n int, prefix array<long>, bits binary")


def parity_bits(h: np.ndarray) -> bytes:
    """For each of at least 2 n places whether an odd number of the hashes falls on
    it; a power of two of places, so that halves laid on each other are the bits of
    half as many."""
    places = 1 << max(6, (2 * len(h)).bit_length())
    odd = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Elements that two sets surely do not share: the places where their parity
    bits differ, each of which an element of one of them alone has made."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _near_enough(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose parity bits do not rule the similarity out; a set and
    one of that similarity differ in (1 - s) / (1 + s) of their elements at most."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns[2:])
            near = [least_difference(x, y) <= share * (n + m) + 1e-6 for n, x, m, y in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    bits = sets.select("doc_id", "n", "bits")
    sides = pairs.join(bits.toDF("b", "n_b", "bits_b"), "b").join(bits.toDF("a", "n_a", "bits_a"), "a")
    return settle(sides.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long"), "near")


def frequent_shingles(docs: DataFrame, size: int, share: int = 20, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Hashes of shingles that many of a ``share``-th of the distinct texts hold,
    the rarest first.  They only order the prefixes: any list gives the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), size).view(np.int64))], ["h"])

    some = docs.where(F.crc32("text") % share == 0).select("text").dropDuplicates()
    counted = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count"), "h").limit(most).select("h").toArrow()
    return rows.column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _possible(similarity: float) -> Column:
    """Whether sets of n_a and n_b, whose first shared hash is at i_a and i_b, can
    reach the similarity."""
    rest = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    return rest >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6


def _verified(pairs: DataFrame, known: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets of shingles reach the similarity.
    Each set is computed once; sorted hashes travel, not texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([shingle_hashes(t.as_py(), size).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "s"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                both = np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s) if len(s) else 0
                near.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    texts = known.join(broadcast_if_small(needed), "doc_id", "left_semi").select("doc_id", "text")
    sets = settle(texts.mapInArrow(hashed, "doc_id long, s array<long>"), "hashes")
    sides = pairs.join(sets.toDF("b", "s_b"), "b").join(sets.toDF("a", "s_a"), "a")
    return settle(sides.select("a", "b", "s_a", "s_b").mapInArrow(judged, "a long, b long"), "links")


def near_duplicate_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, block: int = 1024) -> DataFrame:
    """(doc_id, component_id) of documents in a group of two or more.

    Texts link where the Jaccard similarity of their whole sets of ``size``-word
    shingles reaches ``similarity``; no such pair is missed.  Texts with equal
    sets collapse first.  The others emit the prefixes of their sets; texts that
    meet in a hash are candidates unless their sizes and places rule the
    similarity out, or parity bits of the sets do, and are judged by their sets.  First each bucket's smallest
    doc_id is judged with the others, then the pairs of members that are not yet
    in one group, buckets of more than ``block`` groups in blocks.
    Rows without doc_id take no part; of different texts under one doc_id the
    first by md5 counts.
    """
    known = one_text_per_id(docs)
    sets = settle(shingle_sets(known, size, similarity, frequent_shingles(known, size)), "sets")
    firsts = settle(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")).where("held > 1"), "firsts")
    copies = settle(sets.select("key", "doc_id").join(firsts, "key").where("doc_id <> rep").select("doc_id", "rep"), "copies")
    alone = sets.join(broadcast_if_small(copies.select("doc_id")), "doc_id", "left_anti")
    emitted = alone.select("doc_id", "n", F.posexplode("prefix").alias("i", "h"))
    meet = Window.partitionBy("h")
    held = emitted.withColumn("held", F.count("*").over(meet)).where("held > 1")
    buckets = settle(held.withColumn("first", F.min(F.struct("doc_id", "n", "i")).over(meet)), "buckets")

    ends = [F.col(f"first.{c}").alias(f"{d}_a") for c, d in (("doc_id", "id"), ("n", "n"), ("i", "i"))]
    star = buckets.select(*ends, F.col("doc_id").alias("id_b"), F.col("n").alias("n_b"), F.col("i").alias("i_b"))
    star = star.where("id_a <> id_b").where(_possible(similarity)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    judged = settle(star.distinct(), "pairs")
    links = _verified(_near_enough(judged, sets, similarity), known, size, similarity)

    roots = connected_components(links).withColumnRenamed("node", "doc_id")
    placed = buckets.where("held > 2").join(roots, "doc_id", "left").select("h", "doc_id", "n", "i", F.coalesce("root", "doc_id").alias("root"))
    placed = settle(placed, "placed")
    mixed = placed.groupBy("h").agg(F.countDistinct("root").alias("groups")).where("groups > 1")
    placed = settle(placed.join(mixed, "h").withColumn("blocks", F.ceil(F.col("groups") / block)), "mixed")
    groups = placed.select("h", "root", "blocks").distinct()
    one = groups.select("h", F.col("root").alias("root_a"), F.pmod(F.xxhash64("root"), F.col("blocks")).alias("part"))
    other = groups.select("h", F.col("root").alias("root_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"))
    met = one.join(other, ["h", "part"]).where("root_a < root_b").drop("part")
    side = lambda e: placed.select("h", *[F.col(c).alias(f"{c}_{e}") for c in ("doc_id", "n", "i", "root")])
    rest = met.join(side("a"), ["h", "root_a"]).join(side("b"), ["h", "root_b"]).where(_possible(similarity))
    rest = rest.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
    rest = settle(rest.join(judged, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(_near_enough(rest, sets, similarity), known, size, similarity))

    return _groups(links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))


def _groups(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the documents that the links (a, b) join."""
    roots = settle(connected_components(settle(links, "links")), "roots")
    least = settle(roots.groupBy("root").agg(F.min("node").alias("component_id")), "least")
    return settle(roots.join(least, "root").select(F.col("node").alias("doc_id"), "component_id"), "groups")


def drop_near_duplicates(docs: DataFrame, **options: float) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Documents link by their fingerprints, as in ``simhash_components``, and, since two
    texts with an inserted block differ in more bits than a ball spans, also by the
    sets of their shingles, as in ``near_duplicate_components``.  Rows without doc_id pass; of rows that repeat a doc_id one stays; null texts
    count as empty, and empty texts are copies of each other.
    """
    link = lambda groups: groups.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    prints = link(simhash_components(one_text_per_id(docs)))
    groups = _groups(prints.unionByName(link(near_duplicate_components(docs, **options))))
    gone = broadcast_if_small(groups.where("doc_id <> component_id").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti")
    counted = docs.where("doc_id is not null").groupBy("doc_id").count()
    repeated = broadcast_if_small(settle(counted.where("count > 1").select("doc_id"), "repeated"))
    once = kept.join(repeated, "doc_id", "left_anti")
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
