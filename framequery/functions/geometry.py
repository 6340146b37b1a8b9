"""Box, region and frame geometry as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(x1: Column, x2: Column) -> Column:
    return (x1 + x2) / 2


def box_views(height: Column, width: Column) -> dict[str, Column]:
    """Centre form, normalised centre form and normalised corners of x1..y2."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    cx, cy, w, h = center(x1, x2), center(y1, y2), x2 - x1, y2 - y1
    views = {"cx": cx, "cy": cy, "w": w, "h": h}
    views |= {"cxn": cx / width, "cyn": cy / height, "wn": w / width, "hn": h / height}
    return views | {"x1n": x1 / width, "y1n": y1 / height, "x2n": x2 / width, "y2n": y2 / height}


def corners(cx: Column, cy: Column, w: Column, h: Column, box_mode: str = "ref") -> dict[str, Column]:
    """Corner boxes of raw rows.  ``ref`` keeps the published behaviour, whose
    right and bottom edges lie a full width and height from the centre;
    ``centered`` halves them."""
    if box_mode not in ("ref", "centered"):
        raise ValueError(f"box_mode is 'ref' or 'centered', not {box_mode!r}")
    far = 1.0 if box_mode == "ref" else 0.5
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w * F.lit(far), "y2": cy + h * F.lit(far)}


def letterbox(height: Column, width: Column, target: int = 640) -> dict[str, Column]:
    """Scale into a square of ``target`` and what is left to pad."""
    t = F.lit(float(target))
    scale = F.least(t / width, t / height)
    return {"scale": scale, "pad_x": t - width * scale, "pad_y": t - height * scale}


def unletterbox(value: Column, pad: Column, scale: Column) -> Column:
    """A letterboxed coordinate in source pixels; half the padding, rounded down."""
    return (value - F.floor(pad / 2)) / scale


def crop_bounds(height: Column, width: Column, top: int = 100, bottom: int = 0, left: int = 25, right: int = 25) -> dict[str, Column]:
    """Half-open pixel window of a crop, the margins clamped to the frame."""
    cut = lambda margin, size: F.least(F.lit(margin).cast("long"), size)
    return {"row_lo": cut(top, height), "row_hi": height - cut(bottom, height), "col_lo": cut(left, width), "col_hi": width - cut(right, width)}


def zoom_bounds(height: Column, width: Column, factor: float = 1.5) -> dict[str, Column]:
    """Half-open window round the centre that a zoom by ``factor`` shows."""

    def window(size: Column) -> tuple[Column, Column]:
        shown = F.floor(size / F.lit(factor))
        low = F.floor(size / 2) - F.floor(shown / 2)
        return low, low + shown

    (row_lo, row_hi), (col_lo, col_hi) = window(height), window(width)
    return {"row_lo": row_lo, "row_hi": row_hi, "col_lo": col_lo, "col_hi": col_hi}


def model_size(size: Column, stride: int = 32) -> Column:
    """The next multiple of the model's stride."""
    return (F.ceil(size / F.lit(float(stride))) * stride).cast("long")


def rectangles_overlap(a: str, b: str) -> Column:
    """Closed rectangles meet: touching edges count.  ``a`` and ``b`` are aliases."""
    col = lambda t, c: F.col(f"{t}.{c}")
    left, right = F.greatest(col(a, "x1"), col(b, "x1")), F.least(col(a, "x2"), col(b, "x2"))
    top, bottom = F.greatest(col(a, "y1"), col(b, "y1")), F.least(col(a, "y2"), col(b, "y2"))
    return (left <= right) & (top <= bottom)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    inter = side("x1", "x2") * side("y1", "y2")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def inside_rectangle(x: Column, y: Column) -> Column:
    """Strictly inside the joined region's rectangle; its border is outside."""
    return (x > F.col("xmin")) & (x < F.col("xmax")) & (y > F.col("ymin")) & (y < F.col("ymax"))


def inside_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Strictly inside a simple polygon: an odd number of edges crosses the ray
    to the right and no edge holds the point."""
    n = F.size(polygon)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(polygon[i].alias("a"), polygon[(i + 1) % n].alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    def holds(e: Column) -> Column:
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        between = (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"]))
        return (turn == 0) & between & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, holds)


def translate(polygon: Column, dx: Column, dy: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def centroid(polygon: Column) -> tuple[Column, Column]:
    """Mean of the vertices, the centroid of a rectangle."""
    mean = lambda c: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[c]) / F.size(polygon)
    return mean("x"), mean("y")


def label_box(cx: Column, cy: Column, text_w: Column, text_h: Column, margin: int = 5) -> dict[str, Column]:
    """Integer corners of a label centred on a point, with a margin around it."""
    x, y = cx.cast("int") - F.floor(text_w / 2), cy.cast("int") + F.floor(text_h / 2)
    out = {"text_x": x, "text_y": y, "box_x1": x - margin, "box_y1": y - text_h - margin, "box_x2": x + text_w + margin, "box_y2": y + margin}
    return {k: v.cast("long") for k, v in out.items()}
