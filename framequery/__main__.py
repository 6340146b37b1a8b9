"""Command line, for spark-submit or ``python -m framequery``.

    list                                      the registered queries
    query NAME --data DIR [--out PATH]        one of them over a folder of tables
    probe SOURCE [--out PATH]                 sizes, frames and seconds of video files
    track DETECTIONS --out PATH               tracks of a table of detections, with lengths

Without --out the first rows are shown.  The model names and tasks that --name and
--type take say how raw predictions are read; unknown names are an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequery.functions.text import DECODERS, MODELS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framequery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["list", "query", "probe", "track"])
    p.add_argument("what", nargs="?", help="a query, a source or a table")
    p.add_argument("--data", help="the folder of the tables")
    p.add_argument("--out", help="where the result is written")
    p.add_argument("--format", default="parquet", help="parquet, csv, json or orc")
    p.add_argument("--name", default="yolov8", help="the model")
    p.add_argument("--type", default="tracking", help="tracking or plain")
    p.add_argument("--recursive", action=argparse.BooleanOptionalAction, default=False)
    p.add_argument("--verbose", action=argparse.BooleanOptionalAction, default=False, help="also print the plan")
    return p


def task_of(name: str, kind: str) -> str:
    """What a model does: tracking if asked for, else its family's decoding."""
    found = MODELS.get(name.lower().split(" ")[0])
    if found is None:
        raise SystemExit(f"no model {name!r}; known: {', '.join(sorted(MODELS))}")
    return "tracking" if kind == "tracking" else DECODERS[found[1]]


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from framequery.operators import decode, tracker, tracks
    from framequery.sources import media, probe

    if args.command == "query":
        from framequery.plans import catalog, streams

        assert streams  # registers its queries
        if args.what not in catalog.QUERIES or not args.data:
            raise SystemExit("query NAME --data DIR; see list")
        return catalog.QUERIES[args.what](spark, args.data)
    if not args.what:
        raise SystemExit(f"{args.command} needs a source")
    if args.command == "probe":
        files = media.source_files(spark, args.what, args.recursive)
        return probe.probe(files.where(probe.extension(F.col("path")).isin(*probe.VIDEO_ENDINGS)))
    rows = spark.read.parquet(args.what)
    task = task_of(args.name, args.type)
    if "scores" in rows.columns or "values" in rows.columns:
        rows = decode.class_scores(rows, task.removeprefix("decode_") if task != "tracking" else MODELS[args.name.lower()][1]) if "values" in rows.columns else rows
        rows = decode.nms(decode.decode(rows))
    return tracks.track_length(tracker.track_assign(rows)) if task == "tracking" else rows


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        from framequery.plans import catalog, streams

        assert streams
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("framequery").getOrCreate()
    found = result(spark, args)
    if args.verbose:
        found.explain("formatted")
    if args.out:
        found.write.format(args.format).save(args.out)
    else:
        found.show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
