"""Line dedup: lines that many documents hold stay in one of them.

Lines are exploded with a hash of their normalised form; the documents a hash
occurs in are counted, and what is above the threshold is dropped everywhere but
in one document.  Only ids, places and hashes are shuffled.  The dropped places
then meet their documents, and the other lines are put together by position.

Everything is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.llm.common import broadcast_if_small, settle, table, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\v\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, CAPITALS.lower())


def hashed(value: Column, *names: str) -> list[Column]:
    """128 bits as two longs: two hashes of different seeds."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def _lines(docs: DataFrame, min_chars: int, *keys: str) -> DataFrame:
    """(keys, pos, h1, h2) of the lines whose key has ``min_chars`` code points."""
    rows = docs.select(*keys, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select(*keys, "pos", line_key(F.col("line")).alias("line"))
    return rows.where(F.char_length("line") >= min_chars).select(*keys, "pos", *hashed(F.col("line"), "h1", "h2"))


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, keeper, n_docs: line keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents, with the largest doc_id that holds each.

    A document is a doc_id, however many rows repeat it; rows without one do not
    count.  A key is sent once a document, and summed before the shuffle.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    repeated = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = broadcast_if_small(settle(repeated, "repeated"))
    each = lambda rows: rows.select("doc_id", F.explode(_distinct_keys(min_chars)).alias("h")).select("doc_id", "h.h1", "h.h2")
    once = each(known.join(repeated, "doc_id", "left_anti"))
    again = each(known.join(repeated, "doc_id", "left_semi")).distinct()
    found = once.unionByName(again).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n_docs") >= min_docs)


def _distinct_keys(min_chars: int) -> Column:
    keys = F.transform(lines_of(F.col("text")), line_key)
    long = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))
    return F.transform(long, lambda k: F.struct(*hashed(k, "h1", "h2")))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that ``common_lines`` finds, but for those in the
    largest doc_id holding each; adds ``n_lines`` (before) and ``n_dropped``.

    One row for each row: a null text is read as an empty one; rows that repeat
    an id count as one document, each loses its own lines; rows without an id are
    never the keeper.  An empty table gives an empty result; columns named
    n_lines or n_dropped are replaced, all others are kept.
    """
    common = broadcast_if_small(settle(common_lines(docs, min_docs, min_chars).select("h1", "h2", "keeper"), "lines"))
    row = ["doc_id", *hashed(whole_text(), "t1", "t2")]
    narrow = docs.select(*row, "text").select("doc_id", "t1", "t2", "text")
    places = _lines(narrow, min_chars, "doc_id", "t1", "t2").join(common, ["h1", "h2"])
    gone = places.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
    gone = broadcast_if_small(settle(gone, "dropped").withColumnsRenamed({"doc_id": "g", "t1": "g1", "t2": "g2"}))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row)
    met = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("g")) & (F.col("t1") == F.col("g1")) & (F.col("t2") == F.col("g2")), "left")
    lines = lines_of(F.col("row.text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda p: lines[p]), "\n"))
    kept = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*kept, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_BLANKS = "||".join(["' '", *(f"chr({n})" for n in range(9, 14))])
ORACLE = f"""WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{CAPITALS}', '{CAPITALS.lower()}') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
