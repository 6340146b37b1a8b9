"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where a session
    on one machine has none (tests) a temporary folder is set, and any other
    session without one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="framequery-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(folder)
    return str(folder)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a re-run.  The
    tables stay until ``release``, as a result may still read them.
    """
    spark = df.sparkSession
    path = f"{_settled(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _settled(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/framequery/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has settled; to be called when
    its results have been written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_settled(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def labelled(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, name): one row for each labelled document.

    Rows without id or label are no labels; of contradicting repeated rows the
    larger label holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy("doc_id").agg(F.max(name).cast("int").alias(name))


def broadcast_if_small(df: DataFrame, max_bytes: int = 32_000_000) -> DataFrame:
    """A broadcast hint for a settled table whose measured size is within
    ``max_bytes``; beyond it Spark shuffles both sides."""
    wide = [F.octet_length(F.col(c).cast("string")) for c, t in df.dtypes if t in ("string", "binary")]
    nested = [F.octet_length(F.to_json(F.struct(c))) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    row = F.lit(16 + 8 * len(df.columns))
    for part in wide + nested:
        row = row + F.coalesce(part, F.lit(0))
    found = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if found <= max_bytes else df


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id long, text): the rows with an id, null texts as empty; of rows that
    repeat an id the text with the least md5 holds."""
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    repeated = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = broadcast_if_small(settle(repeated, "repeated"))
    again = known.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"))
    return known.join(repeated, "doc_id", "left_anti").unionByName(again)


def hash_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, the first by a hash of ``key``: the same ones on
    every run, whatever the partitions."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def crc32_sql(text: str) -> str:
    """SQL for the crc32 of an ASCII text, bit by bit, for an engine without it."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    fold = "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), {fold}))"
