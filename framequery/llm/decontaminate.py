"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units and names are replaced by typed
placeholders.  Windows of template words are hashed and joined with those of
the benchmark, which finds copies as well as questions asked again with other
values.  The words behind the placeholders then have to map consistently, both
ways: one benchmark value stands for one value in the document and no other
benchmark value for the same.  Windows that are mostly placeholders count only
where their values are equal.

Everything is a DataFrame or SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.llm.common import broadcast_if_small, settle, table

NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
#: Units of measure that may follow a number, and number words.
UNITS = "km cm mm kg mg g m l ml s ms h min mph kmh hz khz mhz ghz kb mb gb tb km2 m2 m3 kwh kw w v miles mile meters metres meter metre inches inch feet foot pounds pound ounces ounce grams gram liters litres hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent degrees degree"  # noqa: E501
NUMBER_WORDS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"  # noqa: E501
WORDS_OF_A_WINDOW = 8
#: Items of fewer words are no passage of their own: they occur by chance.
LEAST_WORDS = 5


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text; those that are numbers, units or
    names are marked with the placeholder's character in front."""
    marked = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;] )\p{Lu}(?=\p{Ll})", rf"{NAME}$0")
    marked = F.regexp_replace(marked, r"[0-9]+(?:[.,:][0-9]+)*", rf" {NUMBER}$0 ")
    units = "|".join(sorted(UNITS.split(), key=len, reverse=True))
    marked = F.regexp_replace(marked, rf"(?i)({NUMBER}[0-9.,:]+ +){NAME}?({units})(?![\p{{L}}\p{{N}}])", rf"$1{UNIT}$2")
    words = F.split(F.lower(marked), r"(?:[^\p{L}\p{N}\x01-\x03.,:]|[.,:](?![0-9]))+")
    return F.array_remove(words, "")


def template(token: Column) -> Column:
    """A token as it stands in a template."""
    numeric = token.isin(*NUMBER_WORDS.split())
    return F.when(token < "\x04", F.substring(token, 1, 1)).when(numeric, F.lit(NUMBER)).otherwise(token)


def windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with ``tok``, the marked words of its text, once for each run of
    as many template words as one of ``sizes``: its place ``at`` (from 1), its
    length ``n`` and its hash ``h``.

    One pass for all sizes.  Only the places are exploded; a run is hashed from
    the words' hashes after that, in generated code.  (explode_outer, as Spark
    would compute what plain explode explodes once more in a filter; texts
    without a run give a null h.)
    """
    hashed = rows.withColumn("tok", tokens(F.coalesce("text", F.lit("")))).drop("text")
    hashed = hashed.withColumn("hashes", F.transform("tok", lambda t: F.xxhash64(template(t))))
    last = F.size("hashes") - (sizes[0] - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    cut = hashed.withColumn("at", F.explode_outer(places))
    if len(sizes) == 1:
        cut = cut.withColumn("n", F.lit(sizes[0]))
    else:
        cut = cut.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("at") + F.col("n") - 1 <= F.size("hashes"))
    return cut.withColumn("h", F.xxhash64("n", F.slice("hashes", F.col("at"), F.col("n")))).drop("hashes")


def benchmark_windows(benchmark: DataFrame, size: int = WORDS_OF_A_WINDOW) -> tuple[DataFrame, list[int]]:
    """(item_id, b_at, b_words, n, h, literal, item_windows), and the window sizes
    in use, the smallest first.

    ``literal``: at least half of the window's words are no placeholders.  An
    item shorter than a window is one window as it is; one of fewer than
    LEAST_WORDS words has none.
    """
    known = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    n_tok = F.size(tokens(F.coalesce("text", F.lit(""))))
    known = settle(known.withColumn("own", F.least(n_tok, F.lit(size))).where(F.col("own") >= LEAST_WORDS), "items")
    sizes = sorted(r[0] for r in known.select("own").distinct().collect())
    cut = windows(known, sizes or [size]).where("n = own and h is not null")
    cut = cut.select("item_id", F.col("at").alias("b_at"), F.slice("tok", F.col("at"), F.col("n")).alias("b_words"), "n", "h")
    literal = F.size(F.filter("b_words", lambda t: template(t) >= "\x04")) * 2 >= F.col("n")
    cut = settle(cut.withColumn("literal", literal), "windows")
    total = cut.groupBy("item_id").agg(F.countDistinct("b_at").alias("item_windows"))
    return settle(cut.join(total, "item_id"), "benchmark"), sizes


def matched_windows(docs: DataFrame, bench: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, at, words, item_id, b_at, b_words, item_windows) of all windows
    that documents share with the benchmark.

    The corpus is read once, against the distinct hashes of the benchmark; only
    windows that meet one go on, to be joined with the items.
    """
    known = settle(bench.groupBy("h").agg(F.bool_or("literal").alias("literal")), "hashes")
    hits = windows(docs.select("doc_id", "text"), sizes or [WORDS_OF_A_WINDOW]).join(broadcast_if_small(known), "h")
    hits = settle(hits.select("doc_id", "at", "h", "literal", F.slice("tok", F.col("at"), F.col("n")).alias("words")), "hits")
    key = lambda words: F.when(F.col("literal"), F.col("h")).otherwise(F.xxhash64("h", words)).alias("key")
    cells = bench.select("item_id", "b_at", "b_words", "item_windows", key("b_words"))
    return hits.select("doc_id", "at", "words", key("words")).join(broadcast_if_small(settle(cells, "cells")), "key").drop("key")


def consistent(hits: DataFrame) -> DataFrame:
    """The windows of ``hits`` whose values map consistently, with ``same``
    (whether no value differs).

    Of the values that a benchmark value meets in a document, in whatever window
    and at whatever shift, the one met most often holds, and of the benchmark
    values that meet a document's value likewise; a window that holds another
    pair of values does not count, the others of its item do.
    """
    window = ["doc_id", "item_id", "at", "b_at"]
    is_slot = F.filter(F.arrays_zip("b_words", "words"), lambda z: template(z["b_words"]) < "\x04")
    slots = hits.select(*window, F.explode(F.array_distinct(is_slot)).alias("s"))
    slots = slots.select(*window, F.col("s.b_words").alias("asked"), F.col("s.words").alias("given"))
    met = settle(slots.groupBy("doc_id", "item_id", "asked", "given").agg(F.count("*").alias("met")), "met")
    by_asked = Window.partitionBy("doc_id", "item_id", "asked").orderBy(F.desc("met"), "given")
    by_given = Window.partitionBy("doc_id", "item_id", "given").orderBy(F.desc("met"), "asked")
    judged = met.withColumn("holds", (F.row_number().over(by_asked) == 1) & (F.row_number().over(by_given) == 1))
    judged = slots.join(judged.drop("met"), ["doc_id", "item_id", "asked", "given"]).groupBy(*window)
    judged = judged.agg(F.bool_and("holds").alias("holds"), F.bool_and(F.col("asked") == F.col("given")).alias("same"))
    kept = hits.join(judged, window, "left").where(F.coalesce("holds", F.lit(True)))
    return kept.select(*window, "item_windows", F.coalesce("same", F.lit(True)).alias("same"))


def contamination(docs: DataFrame, benchmark: DataFrame, min_windows: int = 6, min_share: float = 0.5) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, exact for each document
    that holds a benchmark item or a re-parameterised form of it.

    A pair counts if consistent matches cover ``min_windows`` windows of the
    item (13 words in a row), or the share ``min_share`` of a shorter item's.
    ``exact``: no value differs.  Items of fewer than LEAST_WORDS words match
    nothing, as they occur in clean texts by chance.  Null and empty texts hold
    nothing; rows without doc_id or item_id take no part; repeated rows count
    once; an empty table gives an empty result; other columns are ignored.
    """
    bench, sizes = benchmark_windows(benchmark)
    hits = settle(matched_windows(docs.where("doc_id is not null"), bench, sizes).distinct(), "matches")
    pairs = consistent(hits).groupBy("doc_id", "item_id").agg(
        F.countDistinct("b_at").alias("matched_windows"), F.max("item_windows").alias("item_windows"), F.bool_and("same").alias("exact")
    )
    return pairs.where(F.col("matched_windows") >= F.least(F.lit(min_windows), F.ceil(F.col("item_windows") * min_share)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    gone = settle(contamination(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
