"""Maximum inner product search with score-aware anisotropic quantisation.

Directions of vectors are cut into two-dimensional parts and each part is coded in
four bits; the length is kept beside the code.  The codebooks and the codes minimise
a loss that weighs the error parallel to the vector more than the error across it,
as the parallel part changes the scores of the queries that matter.  A query's lookup
tables are scanned over all codes, and the best codes are scored by exact inner
products.

A code's error is known, and no inner product is off by more than its length times
the query's.  So the k-th best exact score of a block rules out every vector whose
estimate and error stay below it, and all the others are scored exactly too: no true
neighbour is lost, however ill the codebooks fit the vectors.

Queries and vectors meet in blocks, each pair of blocks a task of its own, and only
the k best of each query leave a block.  There is no coarse partition that is
searched in part: on vectors without clusters it would lose neighbours (the README
gives figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.llm.common import hash_sample, settle, table

SAMPLE_ROWS = 4000
CODES = 16
ROWS_A_BLOCK = 8192
QUERIES_A_BLOCK = 8192
#: Queries of a block that are scanned at once.
QUERIES_AT_ONCE = 256


@dataclass(frozen=True)
class Codebooks:
    """(parts, 16, part width) centres; the weight of the parallel error."""

    centres: np.ndarray
    parallel: float


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, their components as given."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("v", lambda x: x != 0)
    known = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))
    return known.where(F.coalesce(fine & nonzero, F.lit(False)))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and the lengths they had; rows are not zero."""
    most = np.abs(x).max(1, keepdims=True)
    length = np.linalg.norm(x / most, axis=1, keepdims=True)
    return x / most / length, (most * length)[:, 0]


def split(x: np.ndarray, width: int = 2) -> np.ndarray:
    """(n, d) -> (n, parts, width), padded with zeros."""
    short = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, width)


def encode(x: np.ndarray, books: Codebooks, sweeps: int = 3) -> np.ndarray:
    """Codes of the rows of ``x`` by coordinate descent on the anisotropic loss
    |e|^2 + (parallel - 1) (e . x / |x|)^2, e being the residual."""
    parts, unit = split(x), split(x / np.linalg.norm(x, axis=1, keepdims=True))
    cross = np.einsum("npw,pcw->npc", parts, books.centres, optimize=True)
    across = np.square(parts).sum(2)[:, :, None] - 2 * cross + np.square(books.centres).sum(2)
    along = np.einsum("npw,npw->np", parts, unit)[:, :, None] - np.einsum("npw,pcw->npc", unit, books.centres, optimize=True)
    codes = across.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for p in range(parts.shape[1]):
            rest = total - along[rows, p, codes[:, p]]
            best = (across[:, p] + (books.parallel - 1) * np.square(rest[:, None] + along[:, p])).argmin(1)
            codes[:, p] = best
            total = rest + along[rows, p, best]
    return codes.astype(np.uint8)


def learn(x: np.ndarray, parallel: float = 4.0, rounds: int = 8, seed: int = 11) -> Codebooks:
    """Codebooks for sampled vectors: plain centres first, then alternately the
    codes and, part by part, the weighted least-squares centres."""
    parts, unit = split(x), split(x / np.linalg.norm(x, axis=1, keepdims=True))
    rng = np.random.default_rng(seed)
    start = rng.choice(len(x), CODES, replace=len(x) < CODES)
    books = Codebooks(parts[start].transpose(1, 0, 2).copy(), 1.0)
    for turn in range(rounds):
        codes = encode(x, books, 0 if turn < rounds // 2 else 2)
        weight = parallel - 1 if turn >= rounds // 2 else 0.0
        centres = books.centres.copy()
        picked = np.take_along_axis(centres[None], codes[:, :, None, None].astype(np.int64), 2)[:, :, 0]
        error = np.einsum("npw,npw->np", parts - picked, unit)
        for p in range(parts.shape[1]):
            rest = error.sum(1) - error[:, p]
            for c in range(CODES):
                own = codes[:, p] == c
                if own.any():
                    u = unit[own, p]
                    a = own.sum() * np.eye(u.shape[1]) + weight * u.T @ u
                    b = parts[own, p].sum(0) + weight * (u * (rest[own] + (parts[own, p] * u).sum(1))[:, None]).sum(0)
                    centres[p, c] = np.linalg.solve(a, b)
        books = Codebooks(centres, parallel if turn >= rounds // 2 - 1 else 1.0)
    return books


def decode(codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """What the codes stand for, padded to whole parts."""
    return books.centres[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)


def with_codes(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``rows`` (vec_id, ids, v) with code, two four-bit codes of the direction a
    byte; length; and off, the distance of the direction from what is coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, length = directions(matrix(batch.column(2)))
                codes = encode(unit, books)
                off = np.linalg.norm(split(unit).reshape(len(unit), -1) - decode(codes, books), axis=1)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = pa.array([row.tobytes() for row in codes[:, ::2] << 4 | codes[:, 1::2]], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(length), pa.array(off)], [*batch.schema.names, "code", "length", "off"])

    kind = dict(rows.dtypes)["v"]
    return rows.select("vec_id", "ids", "v").mapInArrow(run, f"vec_id long, ids array<long>, v {kind}, code binary, length double, off double")


def scan(queries: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """(q, n) estimated inner products, from each query's tables for the pairs
    of four-bit codes that share a byte."""
    tables = np.einsum("qpw,pcw->pcq", split(queries), books.centres).astype(np.float32)
    if len(tables) % 2:
        tables = np.pad(tables, ((0, 1), (0, 0), (0, 0)))
    total, row = np.zeros((len(codes), len(queries)), np.float32), np.empty((len(codes), len(queries)), np.float32)
    for b in range(codes.shape[1]):
        bytewise = (tables[2 * b, :, None] + tables[2 * b + 1, None]).reshape(CODES * CODES, -1)
        total += np.take(bytewise, codes[:, b], axis=0, out=row)
    return np.ascontiguousarray(total.T)


def best_codes(estimate: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``m`` largest estimates of each row; of equal ones
    the first columns."""
    m = min(m, estimate.shape[1])
    least = np.partition(estimate, estimate.shape[1] - m, axis=1)[:, [estimate.shape[1] - m]]
    over = estimate > least
    ties = estimate == least
    room = m - over.sum(1, keepdims=True)
    return np.nonzero(over | (ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= room)))


def leaders(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a row and an id, in what order the best of each row come, ties by
    smaller id, down to the ``k``-th that ``counts``; and whether it is the k-th."""
    order = np.lexsort((ids, -score, rows))
    counted = np.cumsum(counts[order])
    starts = np.searchsorted(rows[order], rows[order])
    before = counted - counts[order] - (counted - counts[order])[starts]
    kept = before < k
    return order[kept], (counts[order] & (before == k - 1))[kept]


def best_of_block(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, off: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, books: Codebooks, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E501
    """Rows of ``queries`` and of ``x`` and the exact scores of all that can be among
    a query's ``k`` best ids other than its own, ties to smaller ids.

    The ``first`` best estimates are scored exactly; what the bound then leaves is
    compared in one product, and again exactly where that comes near the k-th best.
    """
    unit, size = directions(queries)
    once = np.zeros(len(x), bool)
    once[np.unique(ids, return_index=True)[1]] = True  # an id with several vectors counts once
    exact = lambda r, c: np.einsum("nd,nd->n", x[c], queries[r])
    counts = lambda r, c: once[c] & (ids[c] != query_ids[r])
    with np.errstate(over="ignore", invalid="ignore"):
        estimate = scan(unit, codes, books) * length
        # the last term covers the rounding of the scan
        most = estimate + length * (off + 1e-5 * (1 + off))
        rows, columns = best_codes(estimate, first)
        score = exact(rows, columns)
        kept, is_last = leaders(rows, score, ids[columns], counts(rows, columns), k)
        least = np.full(len(queries), -np.inf)
        least[rows[kept[is_last]]] = score[kept[is_last]]
        left = ~(most * size[:, None] < least[:, None])
        left[rows, columns] = False
        some = np.flatnonzero(left.any(0))
        rest = left[:, some] & ~(queries @ x[some].T + 1e-9 * size[:, None] * length[some] < least[:, None])
        more, at = np.nonzero(rest)
        rows, columns = np.concatenate([rows[kept], more]), np.concatenate([columns[kept], some[at]])
        score = np.concatenate([score[kept], exact(more, some[at])])
        kept, _ = leaders(rows, score, ids[columns], counts(rows, columns), k)
    return rows[kept], columns[kept], score[kept]


def candidates(coded: DataFrame, ask: DataFrame, books: Codebooks, k: int, rerank: int) -> DataFrame:
    """(query_id, ids, score): in each block of vectors the k best of each query."""
    blocks = max(1, -(-coded.count() // ROWS_A_BLOCK))
    q_blocks = max(1, -(-ask.count() // QUERIES_A_BLOCK))
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = coded.withColumn("block", place(blocks)).withColumn("q_block", span(q_blocks))
    right = ask.withColumn("q_block", place(q_blocks)).withColumn("block", span(blocks))
    first = -(-rerank // blocks) + 4 * k

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids, lists, scores = [np.empty(0, np.int64)], [], [np.empty(0)]
        if own.num_rows and asked.num_rows:
            own = own.sort_by("vec_id")
            codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(own.num_rows, -1)
            x, q = matrix(own.column("v").combine_chunks()), matrix(asked.column("v").combine_chunks())
            ids, length, off, asking = (t.column(c).to_numpy() for t, c in ((own, "vec_id"), (own, "length"), (own, "off"), (asked, "vec_id")))
            for at in range(0, len(q), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                rows, columns, score = best_of_block(x, ids, codes, length, off, q[part], asking[part], books, k, first)
                query_ids.append(asking[part][rows])
                lists.append(own.column("ids").combine_chunks().take(pa.array(columns)))
                scores.append(score)
        held = pa.chunked_array(lists, pa.list_(pa.int64()))
        return pa.table({"query_id": np.concatenate(query_ids), "ids": held, "score": np.concatenate(scores)})

    found = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block"))
    return found.applyInArrow(best, "query_id long, ids array<long>, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest of ``vectors``.

    Both are (vec_id, embedding).  Equal vectors are coded once; as a query
    needs no more than k + 1 of them, the k + 1 smallest ids stand for all.  A
    query's ``rerank * k`` best codes are scored exactly, and so is every vector
    that the errors of the codes leave in doubt, so none is missed; ties go to the
    smaller vec_id.  A query is compared with the vectors of its own width, each
    width with codebooks of its own, fitted on at most SAMPLE_ROWS of its vectors.
    Rows that are null, zero or hold null or non-finite components take no part;
    a repeated vec_id counts once for each of its different vectors, with the
    better score as a neighbour; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = settle(usable(vectors).withColumn("key", F.xxhash64("v")), "vectors")
    first = Window.partitionBy("key", "v").orderBy("vec_id")
    ranked = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    distinct = ranked.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = settle(distinct.select(F.col("ids")[0].alias("vec_id"), "ids", "v", F.size("v").alias("width")), "distinct")
    ask = settle(usable(queries).distinct().select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("width")), "queries")
    found = []
    for (width,) in ask.select("width").distinct().orderBy("width").collect():
        own = distinct.where(F.col("width") == width).select("vec_id", "ids", "v")
        sample = [r["v"] for r in hash_sample(own, SAMPLE_ROWS, "vec_id").collect()]
        if sample:
            books = learn(directions(np.array(sample, np.float64))[0])
            coded = settle(with_codes(own, books), "codes")
            asked = ask.where(F.col("width") == width).select(F.col("query_id").alias("vec_id"), "v")
            found.append(candidates(coded, asked, books, k, rerank * k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scored = settle(reduce(DataFrame.unionByName, found), "candidates")
    each = scored.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
