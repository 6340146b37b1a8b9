"""Pixel work, batch by batch: crop, zoom, letterbox, model input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PAD = 114


def crop(img: np.ndarray, top: int = 100, bottom: int = 0, left: int = 25, right: int = 25) -> np.ndarray:
    h, w = img.shape[:2]
    return img[min(top, h) : h - min(bottom, h), min(left, w) : w - min(right, w)]


def resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, sampled at pixel centres."""
    h, w = img.shape[:2]
    if (h, w) == (height, width) or not h or not w:
        return img
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a = img.astype(np.float32)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def zoom(img: np.ndarray, factor: float = 1.5) -> np.ndarray:
    h, w = img.shape[:2]
    zh, zw = int(h / factor), int(w / factor)
    top, left = h // 2 - zh // 2, w // 2 - zw // 2
    return resize(img[top : top + zh, left : left + zw], h, w)


def letterbox(img: np.ndarray, target: int = 640) -> np.ndarray:
    """Scaled to fit a square and padded in grey on both sides."""
    h, w = img.shape[:2]
    scale = min(target / w, target / h)
    small = resize(img, round(h * scale), round(w * scale))
    out = np.full((target, target, img.shape[2]), PAD, np.uint8)
    top, left = (target - small.shape[0]) // 2, (target - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def model_input(imgs: list[np.ndarray]) -> np.ndarray:
    """(B, 3, H, W) floats of 0 to 1 in RGB from BGR images of one shape."""
    return np.stack(imgs)[..., ::-1].transpose(0, 3, 1, 2).astype(np.float32) / 255


STEPS = {"crop": crop, "zoom": zoom, "letterbox": letterbox}


def transform_frames(frames: DataFrame, *steps: str) -> DataFrame:
    """FRAME rows with the named pixel steps applied; rows without data pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch.index[batch["data"].notna()]:
                shape = tuple(int(batch.at[i, c]) for c in ("height", "width", "n_channels"))
                img = np.frombuffer(batch.at[i, "data"], np.uint8).reshape(shape)
                for step in steps:
                    img = STEPS[step](img)
                batch.at[i, "height"], batch.at[i, "width"] = img.shape[:2]
                batch.at[i, "data"] = np.ascontiguousarray(img).tobytes()
            yield batch

    return frames.mapInPandas(run, frames.schema)


def stub_model(classes: int = 4, anchors: int = 3):  # noqa: ANN201
    """A stand-in model for ``predict_batch_udf``: deterministic raw rows from
    the mean grey levels of an image's quarters."""

    def make():  # noqa: ANN202
        def predict(means: np.ndarray) -> np.ndarray:
            base = means.reshape(len(means), -1).mean(1, keepdims=True)
            k = np.arange(anchors * (4 + classes))[None, :]
            return ((base * 7 + k * 13) % 97 / 97).astype(np.float32)

        return predict

    return make
