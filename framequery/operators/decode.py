"""Raw predictions to detections: argmax, confidence filter, boxes, suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.functions import geometry as G

FRAME_KEYS = ["camera_id", "frame_no"]


def class_scores(raw: DataFrame, family: str = "v8") -> DataFrame:
    """(…, values) -> (…, scores): the class scores of a raw row, which start at
    its fifth value, or at the sixth where there is an objectness."""
    first = {"v8": 5, "v5": 6}[family]
    return raw.withColumn("scores", F.slice("values", first, F.greatest(F.size("values") - (first - 1), F.lit(0)))).drop("values")


def best_class(raw: DataFrame) -> DataFrame:
    """Adds conf and cls_id, the largest score and its first place."""
    top = F.array_max("scores")
    return raw.withColumn("conf", top).withColumn("cls_id", (F.array_position("scores", top) - 1).cast("long"))


def decode(raw: DataFrame, conf: float = 0.4, box_mode: str = "ref") -> DataFrame:
    """RAW_PRED rows whose best score reaches ``conf``, as detections; frames
    without one give no rows."""
    kept = best_class(raw).where(F.col("conf") >= conf)
    boxes = G.corners(*[F.col(c) for c in ("cx", "cy", "w", "h")], box_mode)
    columns = [*FRAME_KEYS, F.col("anchor_idx").alias("det_idx"), F.lit(None).cast("long").alias("track_id"), "cls_id", "conf"]
    return kept.select(*columns, *[v.alias(k) for k, v in boxes.items()])


def nms(det: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Greedy suppression in each frame, over all classes: by falling conf (ties
    by det_idx) a box stays unless it overlaps a kept one by more than
    ``threshold``.  A native fold over the frame's ordered boxes; for frames of
    thousands of boxes use ``nms_dense``."""
    rest = F.struct(*[F.col(f"`{c}`") for c in det.columns])
    box = F.struct((-F.col("conf")).alias("order"), "det_idx", "x1", "y1", "x2", "y2", rest.alias("row"))
    frames = det.groupBy(*FRAME_KEYS).agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def step(kept, b):  # noqa: ANN001, ANN202
        clash = F.exists(kept, lambda k: G.iou(k, b) > threshold)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(b)))

    kept = frames.select(F.explode(F.aggregate("boxes", F.slice("boxes", 1, 0), step)).alias("b"))
    return kept.select("b.row.*")


def kept_boxes(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, threshold: float) -> list[int]:
    """Places of the boxes that stay, of one frame's in the order of suppression."""
    area, left, kept = (x2 - x1) * (y2 - y1), np.arange(len(x1)), []
    while len(left):
        i, left = int(left[0]), left[1:]
        kept.append(i)
        sides = np.minimum(x2[left], x2[i]) - np.maximum(x1[left], x1[i]), np.minimum(y2[left], y2[i]) - np.maximum(y1[left], y1[i])
        inter = np.clip(sides[0], 0, None) * np.clip(sides[1], 0, None)
        union = area[left] + area[i] - inter
        left = left[~((union > 0) & (inter > threshold * np.where(union > 0, union, 1)))]
    return kept


def nms_dense(det: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``nms`` for crowded frames: frames lie sorted side by side in a partition and
    stream through in Arrow batches, each suppressed by a vectorised pass."""
    by_conf = [F.desc("conf"), "det_idx"]
    ordered = det.repartition(*FRAME_KEYS).sortWithinPartitions(*FRAME_KEYS, *by_conf)

    def suppress(rows: pd.DataFrame) -> pd.DataFrame:
        new = np.zeros(len(rows), bool)
        for k in FRAME_KEYS:
            code = pd.factorize(rows[k], use_na_sentinel=False)[0]  # nulls are one key
            new[1:] |= code[1:] != code[:-1]
        starts = [0, *np.flatnonzero(new), len(rows)]
        sides = [rows[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2")]
        kept = [a + i for a, b in zip(starts, starts[1:]) for i in kept_boxes(*[v[a:b] for v in sides], threshold)]
        return rows.iloc[kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            same = np.ones(len(rows), bool)
            for k in FRAME_KEYS:
                last = rows[k].iloc[-1] if len(rows) else None
                same &= (rows[k].isna() if pd.isna(last) else rows[k] == last).to_numpy()
            held = rows[same]  # its frame may go on in the next batch
            yield suppress(rows[~same])
        if held is not None:
            yield suppress(held)

    return ordered.mapInPandas(run, det.schema)


def outputs(raw: DataFrame, embed: bool = False, conf: float = 0.4, box_mode: str = "ref") -> DataFrame:
    """What a model's rows become: detections, or with ``embed`` the raw vectors,
    camera_id, frame_no, anchor_idx, vector array<float>, without any of the work
    that comes after the model."""
    if embed:
        vector = F.concat(F.array("cx", "cy", "w", "h"), "scores").cast("array<float>")
        return raw.select(*FRAME_KEYS, "anchor_idx", vector.alias("vector"))
    return decode(raw, conf, box_mode)


def unletterbox(det: DataFrame, height: int, width: int, target: int = 640) -> DataFrame:
    """Boxes in source pixels, not clipped to the frame."""
    g = G.letterbox(F.lit(float(height)), F.lit(float(width)), target)
    pads = {"x1": "pad_x", "x2": "pad_x", "y1": "pad_y", "y2": "pad_y"}
    return det.withColumns({c: G.unletterbox(F.col(c), g[p], g["scale"]) for c, p in pads.items()})


def frame_results(det: DataFrame) -> DataFrame:
    """One row a frame with its boxes in order."""
    box = F.struct("det_idx", "track_id", "cls_id", "conf", "x1", "y1", "x2", "y2")
    return det.groupBy(*FRAME_KEYS).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


def zipped(batches: DataFrame) -> DataFrame:
    """Frame rows of parallel arrays (boxes, ids, classes) -> one row for each
    place, the arrays cut to the shortest."""
    n = F.least(F.size("boxes"), F.size("ids"), F.size("classes"))
    place = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    rows = batches.withColumn("i", F.explode(place))
    return rows.select(*FRAME_KEYS, "i", F.col("boxes")[F.col("i")].alias("box"), F.col("ids")[F.col("i")].alias("track_id"), F.col("classes")[F.col("i")].alias("cls_id"))  # noqa: E501
