"""Arithmetic on boxes and landmarks; pixels stay outside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_of(box: Column) -> tuple[Column, Column]:
    """Width and height of a corner box [x1, y1, x2, y2]."""
    return box[2] - box[0], box[3] - box[1]


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y + h)


def xywh(box: Column) -> Column:
    w, h = size_of(box)
    return F.array(box[0], box[1], w, h)


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """A corner box inside the image."""
    zero = F.lit(0.0)
    return F.array(F.greatest(zero, box[0]), F.greatest(zero, box[1]), F.least(width, box[2]), F.least(height, box[3]))


def square_margin_box(box: Column, width: Column, height: Column, margin: float) -> Column:
    """A square of side max(w, h) * (1 + 2 * margin) around the box's centre, clipped, truncated to integers."""
    w, h = size_of(box)
    side = F.greatest(w, h) * (1 + 2 * margin)
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    out = clip_box(F.array(cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2), width, height)
    return F.transform(out, lambda x: x.cast("int"))


def proportional_margin_box(box: Column, width: Column, height: Column, margin: float) -> Column:
    """Each side moved out by an integer share of the box's size, clipped."""
    whole = F.transform(box, lambda x: x.cast("int"))
    w, h = size_of(whole)
    dx, dy = (w * margin).cast("int"), (h * margin).cast("int")
    zero = F.lit(0)
    return F.array(F.greatest(zero, whole[0] - dx), F.greatest(zero, whole[1] - dy), F.least(width.cast("int"), whole[2] + dx), F.least(height.cast("int"), whole[3] + dy))


def centre(points: Column, first: int, count: int) -> Column:
    """Mean point of `count` landmarks from 0-based `first`: (x, y)."""
    some = F.slice(points, first + 1, count)
    mean = lambda i: F.aggregate(F.transform(some, lambda p: p[i]), F.lit(0.0), lambda s, x: s + x) / count
    return F.array(mean(0), mean(1))


def left_right(a: Column, b: Column) -> tuple[Column, Column]:
    """Two eye points ordered by x on screen."""
    return F.when(a[0] <= b[0], a).otherwise(b), F.when(a[0] <= b[0], b).otherwise(a)


def eye_alignment(left: Column, right: Column, eye_distance: float = 35.0, to: tuple[float, float] = (56.0, 52.0)) -> Column:
    """angle (degrees), scale and the 2x3 matrix, by rows, that levels the eyes at `eye_distance` with their middle at `to`.

    Scale and matrix are null where the eyes coincide.
    """
    dx, dy = right[0] - left[0], right[1] - left[1]
    distance = F.hypot(dx, dy)
    scale = F.when(distance > 0, eye_distance / distance)
    a, b = scale * dx / distance, scale * dy / distance
    cx, cy = (left[0] + right[0]) / 2, (left[1] + right[1]) / 2
    matrix = F.array(a, b, to[0] - a * cx - b * cy, -b, a, to[1] + b * cx - a * cy)
    return F.struct(F.degrees(F.atan2(dy, dx)).alias("angle"), scale.alias("scale"), F.when(distance > 0, matrix).alias("matrix"))


#: Where eyes, nose and corners of the mouth lie in an aligned crop of 112 x 112 pixels.
TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def similarity(points: Column, template: tuple[tuple[float, float], ...] = TEMPLATE) -> Column:
    """The 2x3 matrix, by rows, that turns, scales and shifts landmarks onto a template with the least squared error.

    Null where there are fewer landmarks than the template has, or where they coincide.
    """
    n = len(template)
    tx, ty = (sum(p[i] for p in template) / n for i in (0, 1))
    total = lambda terms: sum(terms, F.lit(0.0))
    x, y = ([F.get(F.get(points, F.lit(k)), F.lit(i)) for k in range(n)] for i in (0, 1))
    cx, cy = total(x) / n, total(y) / n
    spread = total((x[k] - cx) * (x[k] - cx) + (y[k] - cy) * (y[k] - cy) for k in range(n))
    a = total((x[k] - cx) * (template[k][0] - tx) + (y[k] - cy) * (template[k][1] - ty) for k in range(n)) / spread
    b = total((x[k] - cx) * (template[k][1] - ty) - (y[k] - cy) * (template[k][0] - tx) for k in range(n)) / spread
    matrix = F.array(a, -b, tx - a * cx + b * cy, b, a, ty - b * cx - a * cy)
    return F.when(spread > 0, matrix)


def usable_eyes(left: Column, right: Column, least: float) -> Column:
    """Whether the eyes are at least `least` apart (0: not at one point)."""
    d = F.hypot(right[0] - left[0], right[1] - left[1])
    return d >= least if least > 0 else d != 0


def valid_keypoints(points: Column, visibility: Column, least: int = 5, seen: float = 0.3) -> Column:
    """At least `least` keypoints, the first two (eyes) visible."""
    return (F.size(points) >= least) & (F.get(visibility, F.lit(0)) >= seen) & (F.get(visibility, F.lit(1)) >= seen)


def out_of_frame(points: Column, width: Column, height: Column) -> Column:
    """Whether any landmark lies outside the image."""
    return F.exists(points, lambda p: (p[0] < 0) | (p[1] < 0) | (p[0] >= width) | (p[1] >= height))
