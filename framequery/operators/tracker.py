"""Tracks from detections: motion prediction and assignment in two stages.

The published method of associating every box: a constant-velocity Kalman filter
for each track; confident boxes are assigned first, to all tracks, by overlap and
score; the remaining tracks may then take a doubtful box.  A camera's frames are
one ordered fold, cut where the tracker is certainly empty, so that the segments
of a camera fold apart and their tracks are numbered on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequery.streaming.shared import written

#: Fixed values of the published filter: noise of place and speed, by the height of the box.
PLACE, SPEED = 1 / 20, 1 / 160
BOX = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class TrackerOptions:
    """high, low: scores of confident and of doubtful boxes; new: score of a box
    that may start a track; match, doubtful, fresh: the largest cost of a match in
    the first stage, the second, and of tracks seen once; memory: frames that a
    lost track is kept; twin: overlap of a kept and a lost track that are one;
    every: frames from one to the next."""

    high: float = 0.5
    low: float = 0.1
    new: float = 0.6
    match: float = 0.8
    doubtful: float = 0.5
    fresh: float = 0.7
    memory: int = 30
    twin: float = 0.85
    every: int = 1


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of (n, 4) and (m, 4) corners."""
    sides = np.minimum(a[:, None, 2:], b[None, :, 2:])
    sides -= np.maximum(a[:, None, :2], b[None, :, :2])
    np.maximum(sides, 0, out=sides)
    inter = sides[..., 0] * sides[..., 1]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def assignment(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """The (row, column) pairs that save most, where a pair saves ``limit - cost``:
    who has no choice but each other at once, the rest by shortest augmenting paths."""
    i, j = np.nonzero(cost < limit)
    if not len(i):
        return []
    lone = (np.bincount(i)[i] == 1) & (np.bincount(j)[j] == 1)
    if lone.all():
        return list(zip(i.tolist(), j.tolist(), strict=True))
    pairs = list(zip(i[lone].tolist(), j[lone].tolist(), strict=True))
    rows, cols = np.unique(i[~lone]), np.unique(j[~lone])
    pairs += [(int(rows[a]), int(cols[b])) for a, b in augmented(cost[np.ix_(rows, cols)], limit)]
    return sorted(pairs)


def augmented(cost: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """``assignment`` by shortest augmenting paths over all rows."""
    c = np.minimum(cost - limit, 0.0)
    if len(c) > c.shape[1]:
        return sorted((i, j) for j, i in augmented(cost.T, limit))
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for i in range(n):
        match[m], at = i, m  # column m is where a search begins
        least, via, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while match[at] != n:
            done[at] = True
            free = ~done[:m]
            reduced = c[match[at]] - u[match[at]] - v[:m]
            better = free & (reduced < least)
            least[better], via[better] = reduced[better], at
            to = int(np.argmin(np.where(free, least, np.inf)))
            step = least[to]
            u[match[done]] += step
            v[done] -= step
            least[free] -= step
            at = to
        while at != m:
            match[at] = match[via[at]]
            at = int(via[at])
        match[m] = n
    return sorted((int(match[j]), j) for j in range(m) if match[j] < n and cost[match[j], j] < limit)


@dataclass
class Tracks:
    """The state of one camera: for each track its id, whether it was seen in the
    last frame, whether it is confirmed, its first and last frame, and for each of
    (centre x, centre y, width / height, height) value, speed, and covariance."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    sure: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: (tracks, 4, 5): value, speed, variances of value, both, speed
    motion: np.ndarray = field(default_factory=lambda: np.zeros((0, 4, 5)))
    issued: int = 0
    frame: int | None = None

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("ids", "seen", "sure", "first", "last", "motion"):
            setattr(self, name, getattr(self, name)[chosen])

    def corners(self) -> np.ndarray:
        centre, (ratio, h) = self.motion[:, :2, 0], self.motion[:, 2:, 0].T
        half = np.empty_like(centre)
        half[:, 0], half[:, 1] = ratio * h / 2, h / 2
        return np.concatenate([centre - half, centre + half], axis=1)

    def to_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()}

    @staticmethod
    def from_dict(d: dict) -> Tracks:
        kinds = {"seen": bool, "sure": bool, "motion": float}
        made = {k: np.array(v, kinds.get(k, np.int64)) if isinstance(v, list) else v for k, v in d.items()}
        return Tracks(**made | {"motion": made["motion"].reshape(-1, 4, 5)})


def _noise(height: np.ndarray, place: float, speed: float, ratio: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty((2, len(height), 4))
    out[0], out[1] = (height * place)[:, None], (height * speed)[:, None]
    out[0, :, 2], out[1, :, 2] = ratio
    out *= out
    return out[0], out[1]


def measured(corners: np.ndarray) -> np.ndarray:
    out = np.empty((len(corners), 4))
    side = corners[:, 2:] - corners[:, :2]
    w, h = side.T
    out[:, :2] = corners[:, :2] + side / 2
    out[:, 2] = 1.0
    np.divide(w, h, out=out[:, 2], where=h > 0)
    out[:, 3] = h
    return out


def predict(t: Tracks) -> None:
    m = t.motion
    m[~t.seen, 3, 1] = 0.0  # the height of a lost track stays
    place, speed = _noise(m[:, 3, 0], PLACE, SPEED, (1e-2, 1e-5))
    m[..., 0] += m[..., 1]
    m[..., 2] += 2 * m[..., 3] + m[..., 4] + place
    m[..., 3] += m[..., 4]
    m[..., 4] += speed


def correct(t: Tracks, which: np.ndarray, z: np.ndarray) -> None:
    m = t.motion[which]
    noise = _noise(m[:, 3, 0], PLACE, 0.0, (1e-1, 0.0))[0]
    gain = m[..., 2:4] / (m[..., 2] + noise)[..., None]
    off = z - m[..., 0]
    both = m[..., 3].copy()
    m[..., 0] += gain[..., 0] * off
    m[..., 1] += gain[..., 1] * off
    m[..., 2] *= 1 - gain[..., 0]
    m[..., 3] *= 1 - gain[..., 0]
    m[..., 4] -= gain[..., 1] * both
    t.motion[which] = m


def step(t: Tracks, frame: int, boxes: np.ndarray, conf: np.ndarray, o: TrackerOptions) -> np.ndarray:
    """One frame: the track of each box, 0 for none; ``t`` becomes the next state."""
    given = np.zeros(len(boxes), np.int64)
    confident, doubtful = np.flatnonzero(conf >= o.high), np.flatnonzero((conf >= o.low) & (conf < o.high))
    predict(t)
    met = np.zeros(len(t.ids), bool)
    started = not len(t.ids)
    # a track is corrected once a frame, so what the later stages compare is as predicted
    like, z = overlaps(t.corners(), boxes), measured(boxes)

    def assign(tracks: np.ndarray, some: np.ndarray, limit: float, by_score: bool) -> np.ndarray:
        """Matches; the boxes of ``some`` that are left."""
        if not len(tracks) or not len(some):
            return some
        close = like[tracks[:, None], some]
        pairs = assignment(1 - (close * conf[some] if by_score else close), limit)
        if not pairs:
            return some
        at, which = np.array(pairs).T
        i, j = tracks[at], some[which]
        correct(t, i, z[j])
        given[j], met[i] = t.ids[i], True
        t.last[i], t.sure[i] = frame, True
        left = np.ones(len(some), bool)
        left[which] = False
        return some[left]

    seen, sure = t.seen.copy(), t.sure.copy()
    left = assign(np.flatnonzero(sure), confident, o.match, True)
    assign(np.flatnonzero(sure & seen & ~met), doubtful, o.doubtful, False)
    left = assign(np.flatnonzero(~sure), left, o.fresh, True)
    t.seen = met
    stays = met | (sure & (frame - t.last <= o.memory * o.every))
    if not stays.all():
        t.keep(stays)
    fresh = left[conf[left] >= o.new]
    if len(fresh):
        born = z[fresh]
        place, speed = _noise(born[:, 3], 2 * PLACE, 10 * SPEED, (1e-2, 1e-5))
        motion = np.stack([born, np.zeros_like(born), place, np.zeros_like(born), speed], axis=2)
        ids = t.issued + 1 + np.arange(len(fresh))
        n = len(fresh)
        added = {"ids": ids, "seen": np.ones(n, bool), "sure": np.full(n, started), "first": np.full(n, frame), "last": np.full(n, frame), "motion": motion}
        for name, values in added.items():
            setattr(t, name, np.concatenate([getattr(t, name), values]))
        t.issued += n
        if started:
            given[fresh] = ids
    _drop_twins(t, o)
    t.frame = frame
    return given


def _drop_twins(t: Tracks, o: TrackerOptions) -> None:
    """Of a kept and a lost track at one place the younger goes."""
    kept, lost = np.flatnonzero(t.seen & t.sure), np.flatnonzero(~t.seen)
    if len(kept) and len(lost):
        corners = t.corners()
        i, j = np.nonzero(overlaps(corners[kept], corners[lost]) > o.twin)
        if not len(i):
            return
        older = (t.last - t.first)[kept[i]] > (t.last - t.first)[lost[j]]
        gone = np.zeros(len(t.ids), bool)
        gone[lost[j[older]]] = gone[kept[i[~older]]] = True
        t.keep(~gone)


def advance(t: Tracks, frame: int, boxes: np.ndarray, conf: np.ndarray, o: TrackerOptions) -> np.ndarray:
    """``step`` after the empty frames since the last one."""
    if t.frame is not None:
        for missed in range(t.frame + o.every, frame, o.every):
            if not len(t.ids):
                break
            step(t, missed, np.zeros((0, 4)), np.zeros(0), o)
    return step(t, frame, boxes, conf, o)


def fold_frames(t: Tracks, frames: np.ndarray, boxes: np.ndarray, conf: np.ndarray, o: TrackerOptions) -> np.ndarray:
    """The track of each box of rows in order of their frames, 0 for none; ``t`` becomes
    the state after the last."""
    given, start = np.zeros(len(frames), np.int64), 0
    for end in (np.flatnonzero(np.diff(frames)) + 1).tolist() + [len(frames)] * bool(len(frames)):
        given[start:end] = advance(t, int(frames[start]), boxes[start:end], conf[start:end], o)
        start = end
    return given


def segments(det: DataFrame, o: TrackerOptions = TrackerOptions()) -> DataFrame:
    """camera_id, frame_no, segment: the frames with boxes that count, numbered on
    where so many empty ones come before that no track can be left."""
    frames = det.where(F.col("conf") >= o.low).select("camera_id", "frame_no").distinct()
    by_frame = Window.partitionBy("camera_id").orderBy("frame_no")
    far = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(by_frame) > (o.memory + 1) * o.every, F.lit(False))
    return frames.withColumn("far", far.cast("long")).select("camera_id", "frame_no", F.sum("far").over(by_frame).alias("segment"))


def track_assign(det: DataFrame, options: TrackerOptions = TrackerOptions()) -> DataFrame:
    """``det`` with ``track_id`` set: numbers from 1 a camera, null for boxes that
    belong to no confirmed track.

    A track of one box is confirmed by its second; where there is no track at all,
    new ones are confirmed at once.  Boxes under the low score, or with a null in
    a corner or the score, never have a track.  An empty table gives an empty result.
    """
    columns = [c for c in det.columns if c != "track_id"]
    usable = det.where(F.col("conf") >= options.low).dropna(subset=["camera_id", "frame_no", "det_idx", *BOX])
    rows = usable.select("camera_id", "frame_no", "det_idx", "conf", *BOX).join(segments(usable, options), ["camera_id", "frame_no"])
    # ranges, so that cameras do not share a task by chance; a given number is not merged again
    parts = int(det.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = written(rows, "boxes").repartitionByRange(parts, "camera_id", "segment").sortWithinPartitions("camera_id", "segment", "frame_no", "det_idx")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tracks, held = None, Tracks(), None

        def folded(part: pd.DataFrame) -> pd.DataFrame:
            """Folds whole frames, segment by segment."""
            nonlocal key, tracks
            of = part[["camera_id", "segment"]].to_numpy(np.int64)
            frames, boxes, conf = part["frame_no"].to_numpy(np.int64), part[BOX].to_numpy(float), part["conf"].to_numpy(float)
            local, issued, start = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), 0
            for end in (np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist() + [len(part)] * bool(len(part)):
                if (at := tuple(of[start])) != key:
                    key, tracks = at, Tracks()
                local[start:end] = fold_frames(tracks, frames[start:end], boxes[start:end], conf[start:end], options)
                issued[start:end] = tracks.issued
                start = end
            return part[["camera_id", "segment", "frame_no", "det_idx"]].assign(local=local, issued=issued)

        for batch in batches:
            part = batch if held is None else pd.concat([held, batch])
            if len(part):
                same = (part[["camera_id", "segment", "frame_no"]].to_numpy() == part[["camera_id", "segment", "frame_no"]].iloc[-1].to_numpy()).all(1)
                held = part[same]  # the last frame may go on
                yield folded(part[~same])
        if held is not None:
            yield folded(held)

    kinds = "camera_id long, segment long, frame_no long, det_idx long, local long, issued long"
    found = written(ordered.mapInPandas(fold, kinds), "tracks")
    each = found.groupBy("camera_id", "segment").agg(F.max("issued").alias("issued"))
    before = Window.partitionBy("camera_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("camera_id", "segment", F.coalesce(F.sum("issued").over(before), F.lit(0)).alias("base"))
    ids = found.where("local > 0").join(base, ["camera_id", "segment"])
    ids = ids.select("camera_id", "frame_no", "det_idx", (F.col("base") + F.col("local")).alias("track_id"))
    return det.select(*columns).join(ids, ["camera_id", "frame_no", "det_idx"], "left").select(*det.columns if "track_id" in det.columns else [*columns, "track_id"])
