"""Messages out and in: a log of topics in a folder, written and read as batch or stream.

The log is a folder on any file system that pyarrow opens, with one Arrow file a
segment.  Tasks write under a staging folder; only the commit gives a segment its
number, so readers see whole commits and a failed task leaves nothing.  A stream
reads the segments after its offset, one partition a segment.  A broker would take
the log's place behind the same two names, ``read`` and ``write``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framequery.functions.text import parsed_payload, timing_payload
from framequery.sources.folder import Folder

TOPIC = "stage_times"
POSITIONS = "_positions"
SEGMENT = re.compile(r"(\d{12})(?:\.([A-Za-z0-9_-]+)\.(\d+)\.(\d+))?\.arrow$")
STORED = pa.schema([("topic", pa.string()), ("payload", pa.binary())])
MESSAGE_DDL = "topic string, payload binary, segment long, place long"


def timing_messages(speed: DataFrame, topic: str = TOPIC) -> DataFrame:
    """(topic, value) rows, one a frame, fit for a Kafka or message sink."""
    payload = timing_payload(*[F.col(c) for c in ("preprocess", "inference", "postprocess")])
    return speed.select("camera_id", "frame_no", F.lit(topic).alias("topic"), payload.alias("value"))


def read_timings(messages: DataFrame) -> DataFrame:
    """(…, value) -> the three timings; a payload that is none gives nulls."""
    m = parsed_payload(F.col("value"))
    return messages.withColumns({c: F.try_element_at(m, F.lit(c)) for c in ("preprocess", "inference", "postprocess")})


def payload_text(payload: Column) -> Column:
    """The bytes of a message as text; null where they are no UTF-8."""
    return F.try_validate_utf8(payload.cast("string"))


class Log(Folder):
    """The folder of a log."""

    def segments(self) -> dict[int, str]:
        """The committed segments by number."""
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return {int(m[1]): f.path for f in found if (m := SEGMENT.search(f.base_name))}

    def stage(self, job: str, batches: Iterator[pa.RecordBatch]) -> tuple[str, int]:
        """Writes a task's messages to a file in the job's staging folder."""
        path, n = f"{self.staging(job)}/{uuid.uuid4().hex}.arrow", 0
        with self.fs.open_output_stream(path) as out, pa.ipc.new_stream(out, STORED) as writer:
            for batch in batches:
                names = batch.schema.names
                payload = batch.column(names.index("payload" if "payload" in names else "value")).cast(pa.binary())
                writer.write_batch(pa.RecordBatch.from_arrays([batch.column(names.index("topic")).cast(pa.string()), payload], schema=STORED))
                n += batch.num_rows
        return path, n

    def publish(self, staged: list[str | None], writer: str | None = None, batch: int = 0) -> None:
        """Numbers the staged segments on from the last; those that ``writer`` has
        published for this batch already, in a commit that was cut off, are left out."""
        known = self.segments()
        done = {int(m[4]) for p in known.values() if (m := SEGMENT.search(p)) and writer and (m[2], int(m[3] or 0)) == (writer, batch)}
        number = max(known, default=0)
        for part, path in enumerate(staged):
            if path is None or part in done:
                continue
            number += 1
            tag = f".{writer}.{batch}.{part}" if writer else ""
            self.fs.move(path, f"{self.path}/{number:012d}{tag}.arrow")

    def messages(self, number: int, path: str, topic: str | None) -> Iterator[pa.RecordBatch]:
        """MESSAGE_DDL rows of a segment; places count before the topic is chosen."""
        place = 0
        with self.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
            for batch in reader:
                n = batch.num_rows
                numbers = [pa.array([number] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
                rows = pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=["topic", "payload", "segment", "place"])
                place += n
                yield rows if topic is None else rows.filter(pc.equal(rows.column(0), topic))

    def position(self, group: str) -> int:
        """The last segment that a group of readers has committed."""
        path = f"{self.path}/{POSITIONS}/{group}.json"
        if not self.exists(path):
            return 0
        with self.fs.open_input_stream(path) as source:
            return int(json.loads(source.read())["segment"])

    def set_position(self, group: str, segment: int) -> None:
        self.fs.create_dir(f"{self.path}/{POSITIONS}")
        part = f"{self.path}/{POSITIONS}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            out.write(json.dumps({"segment": segment}).encode())
        self.fs.move(part, f"{self.path}/{POSITIONS}/{group}.json")


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class MessageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.job = dict(options), uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return Written(*Log(self.options["path"]).stage(self.job, batches))

    def commit(self, messages: list[Written | None]) -> None:
        self._publish(messages)

    def abort(self, messages: list[Written | None]) -> None:
        Log(self.options["path"]).unstage(self.job)

    def _publish(self, messages: list[Written | None], *batch: object) -> None:
        log = Log(self.options["path"])
        log.publish([m.path if m and m.rows else None for m in messages], *batch)
        log.unstage(self.job)
        log.sweep()


class MessageStreamWriter(MessageWriter, DataSourceStreamArrowWriter):
    """With the option ``writer``, a name that a query keeps, a batch that is
    committed again after a failure is not published twice."""

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._publish(messages, self.options.get("writer"), batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        Log(self.options["path"]).unstage(self.job)


class SegmentPartition(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


class _Reader:
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def log(self) -> Log:
        return Log(self.options["path"])

    def between(self, start: int, end: int) -> Sequence[InputPartition]:
        return [SegmentPartition(n, p) for n, p in sorted(self.log().segments().items()) if start < n <= end]

    def read(self, partition: SegmentPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty log: Spark asks for one partition that is none
            return iter([])
        return self.log().messages(partition.number, partition.path, self.options.get("topic"))


class MessageReader(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.between(0, max(self.log().segments(), default=0))


class MessageStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are segment numbers.  A new query starts where its ``group`` has
    committed, or at the beginning; ``perBatch`` bounds the segments of a batch."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segment": self.log().position(self.options["group"]) if "group" in self.options else 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max(self.log().segments(), default=0)
        begin = self.at if self.at is not None else self.initialOffset()["segment"]
        self.at = min(last, begin + int(self.options.get("perBatch", last + 1)))
        return {"segment": max(self.at, begin)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at or 0, end["segment"])
        return self.between(start["segment"], end["segment"])

    def commit(self, end: dict) -> None:
        if "group" in self.options:
            self.log().set_position(self.options["group"], end["segment"])


class Messages(DataSource):
    """``messages``: (topic, value or payload) rows out, MESSAGE_DDL rows in.

    Options: path; topic, the one to subscribe to (none: all); for streams group
    and perBatch (in), writer (out).
    """

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return MESSAGE_DDL

    def reader(self, schema: StructType) -> DataSourceReader:
        return MessageReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return MessageStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return MessageWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return MessageStreamWriter(self.options)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label text, one folder a camera and frame."""
    ordered = lines.repartition("camera_id", "frame_no").sortWithinPartitions("camera_id", "frame_no", "det_idx")
    ordered.select("camera_id", "frame_no", F.col("line").alias("value")).write.partitionBy("camera_id", "frame_no").text(path)


def label_count(spark: SparkSession, path: str) -> int:
    """Frames that have a label file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("frame")).distinct().count()
