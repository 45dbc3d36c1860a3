"""Boxes as four integer columns (x1, y1, x2, y2), half open."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def struct(self, **more: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in {**self._asdict(), **more}.items()])


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box in columns like ``x1`` with a prefix or suffix."""
    return Box(*[F.col(f"{prefix}{k}{suffix}") for k in Box._fields])


def of(s: Column) -> Box:
    """The box in a struct."""
    return Box(s["x1"], s["y1"], s["x2"], s["y2"])


def _pos(c: Column) -> Column:
    return F.greatest(c, F.lit(0))


def area(b: Box) -> Column:
    return _pos(b.x2 - b.x1) * _pos(b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection (SP1)."""
    return area(intersection(a, b))


def iou(a: Box, b: Box, page_a: Column | None = None, page_b: Column | None = None) -> Column:
    """Intersection over union; 0 for boxes on different pages, a null page is any page (SP2)."""
    inter = overlap(a, b)
    value = F.when(inter == 0, 0.0).otherwise(F.try_divide(inter, area(a) + area(b) - inter))
    return value if page_a is None else F.when(page_a != page_b, 0.0).otherwise(value)


def coverage(part: Box, by: Box) -> Column:
    """Share of one box that another covers."""
    return F.coalesce(F.try_divide(overlap(part, by), area(part)), F.lit(0.0))


def valid(b: Box) -> Column:
    return F.coalesce((b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def clamp(b: Box, width: Column, height: Column, padding: int = 0) -> Box:
    """Grown by ``padding`` and cut to the image; all null if nothing is left (SP10)."""
    side = lambda c, most: F.greatest(F.lit(0), F.least(c, most))
    out = Box(side(b.x1 - padding, width), side(b.y1 - padding, height), side(b.x2 + padding, width), side(b.y2 + padding, height))
    return Box(*[F.when(valid(out), c) for c in out])


def clip_inside(b: Box, width: Column, height: Column) -> Box:
    """Cut to the last pixel of the image; all null if nothing is left (SP10)."""
    return clamp(b, width - 1, height - 1)


def to_pdf(b: Box, page_width: Column, page_height: Column, width: Column, height: Column, padding: float = 2.0) -> Box:
    """Image pixels as page units with the origin at the bottom left, padded and cut to the page (SP11)."""
    sx, sy = page_width / width, page_height / height
    zero = F.lit(0.0)
    out = Box(
        F.greatest(zero, b.x1 * sx - padding), F.greatest(zero, page_height - b.y2 * sy - padding),
        F.least(page_width, b.x2 * sx + padding), F.least(page_height, page_height - b.y1 * sy + padding),
    )
    ok = (width > 0) & (height > 0) & valid(out)
    return Box(*[F.when(ok, c) for c in out])


def letterbox(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Scale and offsets with which an image fills a square model input, its shape kept (SP12)."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    inner = lambda c: F.greatest(F.lit(1), F.least(F.lit(size), F.bround(c * scale, 0).cast("int")))
    half = lambda c: F.floor((F.lit(size) - inner(c)) / 2).cast("int")
    return {"scale_x": scale, "scale_y": scale, "offset_x": half(width), "offset_y": half(height)}


def stretch(width: Column, height: Column, size: int) -> dict[str, Column]:
    """The same where the shape isn't kept (SP12)."""
    return {"scale_x": F.lit(float(size)) / width, "scale_y": F.lit(float(size)) / height, "offset_x": F.lit(0), "offset_y": F.lit(0)}


def from_model(v: tuple[Column, Column, Column, Column], t: dict[str, Column], width: Column, height: Column, size: int, centred: bool = True) -> Box:
    """A detector's box back in image pixels; values up to 1.5 count as shares of the input (SP12)."""
    a, b, c, d = v
    x1, y1, x2, y2 = (a - c / 2, b - d / 2, a + c / 2, b + d / 2) if centred else v
    unit = F.when(F.greatest(*[F.abs(x) for x in v]) <= 1.5, F.lit(float(size))).otherwise(1.0)
    pixel = lambda x, off, scale, most: F.greatest(F.lit(0), F.least(F.bround((x * unit - off) / scale, 0).cast("int"), most))
    out = Box(
        pixel(x1, t["offset_x"], t["scale_x"], width), pixel(y1, t["offset_y"], t["scale_y"], height),
        pixel(x2, t["offset_x"], t["scale_x"], width), pixel(y2, t["offset_y"], t["scale_y"], height),
    )
    return Box(*[F.when(valid(out), x) for x in out])


def region_ok(b: Box, width: Column, height: Column, margin: int = 20, least: tuple[int, int] = (100, 30)) -> Box:
    """Grown by the margin and cut; all null below the least size (SP15)."""
    out = Box(F.greatest(F.lit(0), b.x1 - margin), F.greatest(F.lit(0), b.y1 - margin), F.least(width, b.x2 + margin), F.least(height, b.y2 + margin))
    ok = (out.x2 - out.x1 >= least[0]) & (out.y2 - out.y1 >= least[1])
    return Box(*[F.when(ok, c) for c in out])


def mask_region(x: Column, y: Column, w: Column, h: Column, from_size: tuple[Column, Column], to_size: tuple[Column, Column]) -> dict[str, Column]:
    """A configured region in another frame size, cut to the frame; all null outside (SP16)."""
    (fw, fh), (tw, th) = from_size, to_size
    scaled = lambda c, a, b: F.when((fw > 0) & (fh > 0), F.bround(c * (b / a), 0).cast("int")).otherwise(c)
    x, w = F.greatest(F.lit(0), scaled(x, fw, tw)), scaled(w, fw, tw)
    y, h = F.greatest(F.lit(0), scaled(y, fh, th)), scaled(h, fh, th)
    ok = (tw > 0) & (th > 0) & (w > 0) & (h > 0) & (x < tw) & (y < th)
    return {k: F.when(ok, c) for k, c in {"x": x, "y": y, "width": F.least(w, tw - x), "height": F.least(h, th - y)}.items()}


def even_crop(r: dict[str, Column]) -> dict[str, Column]:
    """A region with even bounds, inside the old one (SP17); all null if nothing is left."""
    out = {}
    for a, s in (("x", "width"), ("y", "height")):
        odd = r[a] % 2
        size = r[s] - odd
        out |= {a: r[a] + odd, s: size - size % 2}
    ok = (out["width"] > 0) & (out["height"] > 0)
    return {k: F.when(ok, c) for k, c in out.items()}


def crop_filter(r: dict[str, Column], width: Column, height: Column) -> Column:
    """The crop filter's text; empty if the region is the whole frame (SP17)."""
    c = even_crop(r)
    whole = (c["x"] == 0) & (c["y"] == 0) & (c["width"] == width) & (c["height"] == height)
    text = F.concat(F.lit("crop="), F.concat_ws(":", *[c[k].cast("string") for k in ("width", "height", "x", "y")]))
    return F.when(c["x"].isNull() | whole, "").otherwise(text)


def mask_filter(r: dict[str, Column], width: Column, height: Column) -> Column:
    """Up to four filled boxes around the region, as filter text (SP17)."""
    s = lambda c: c.cast("string")
    end = F.lit(":color=black@1:t=fill")
    right, low = r["x"] + r["width"], r["y"] + r["height"]
    return F.concat_ws(
        ",",
        F.when(r["x"] > 0, F.concat(F.lit("drawbox=0:0:"), s(r["x"]), F.lit(":ih"), end)),
        F.when(right < width, F.concat(F.lit("drawbox="), s(right), F.lit(":0:iw-"), s(right), F.lit(":ih"), end)),
        F.when(r["y"] > 0, F.concat(F.lit("drawbox=0:0:iw:"), s(r["y"]), end)),
        F.when(low < height, F.concat(F.lit("drawbox=0:"), s(low), F.lit(":iw:ih-"), s(low), end)),
    )


def polygon_box(points: Column, dx: Column, dy: Column) -> Box:
    """Bounds of an array of (x, y) structs, moved and rounded half to even (SP18)."""
    at = lambda f, k, d: F.bround(f(F.transform(points, lambda p: p[k])) + d, 0).cast("int")
    return Box(at(F.array_min, "x", dx), at(F.array_min, "y", dy), at(F.array_max, "x", dx), at(F.array_max, "y", dy))


def yolo_line(b: Box, width: Column, height: Column) -> Column:
    """'0 cx cy w h' in shares of the image with eight decimals; null for a box outside (SP19)."""
    c = clamp(b, width, height)
    w, h = c.x2 - c.x1, c.y2 - c.y1
    return F.when(c.x1.isNotNull(), F.format_string("0 %.8f %.8f %.8f %.8f", (c.x1 + w / 2.0) / width, (c.y1 + h / 2.0) / height, w / width, h / height))


def yolo_valid(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Positive size, inside the unit square (SP19)."""
    inside = lambda c, s: (c - s / 2.0 >= 0.0) & (c + s / 2.0 <= 1.0)
    return F.coalesce((w > 0) & (h > 0) & inside(cx, w) & inside(cy, h), F.lit(False))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def widened(b: Box, old: Column, new: Column, image_width: Column, per_char: int = 20, margin: int = 15) -> Box:
    """Wider by what a longer text needs, at ``per_char`` pixels a character (SP20, SP23)."""
    more = (F.length(new) - F.length(old)) * per_char
    return Box(b.x1, b.y1, F.when(more > 0, F.least(b.x2 + more + margin, image_width)).otherwise(b.x2), b.y2)


def near(a: Box, b: Box, limit: int = 10) -> Column:
    """Upper left corners within the limit on both axes."""
    return (F.abs(a.x1 - b.x1) <= limit) & (F.abs(a.y1 - b.y1) <= limit)


def mergeable(a: Box, b: Box, limit: int = 50) -> Column:
    """Gap within the limit on either axis."""
    gap = lambda lo1, lo2, hi1, hi2: F.greatest(F.lit(0), F.greatest(lo1, lo2) - F.least(hi1, hi2))
    return (gap(a.x1, b.x1, a.x2, b.x2) <= limit) | (gap(a.y1, b.y1, a.y2, b.y2) <= limit)


def place_beside(b: Box, image_width: Column, offset: int = 20) -> Box:
    """The box of the same size to the right on the line, inside the image."""
    w = b.x2 - b.x1
    x = F.least(b.x2 + F.greatest(w + offset, F.lit(offset)), image_width - w)
    return Box(x, b.y1, F.least(x + w, image_width), b.y2)


def _height(spans: Column) -> Column:
    """Length of the union of an array of (lo, hi) structs."""
    def step(s: Column, y: Column) -> Column:
        gain = F.greatest(F.lit(0), y["hi"] - F.greatest(y["lo"], s["end"]))
        return F.struct((s["sum"] + gain).alias("sum"), F.greatest(s["end"], y["hi"]).alias("end"))

    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-(2**31)).cast("bigint").alias("end"))
    return F.aggregate(F.array_sort(spans), start, step)["sum"]


def union_area(boxes: Column) -> Column:
    """Area of the union of an array of box structs, slab by slab between the x edges (SP6).

    For the boxes of one page, whose number is small; ``operators.spatial.union_area`` works on rows.
    """

    def area_of(good: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda b: F.array(b["x1"].cast("bigint"), b["x2"].cast("bigint"))))))
        last = lambda e: F.greatest(F.size(e) - 1, F.lit(0))
        slabs = let(edges, lambda e: F.zip_with(F.slice(e, F.lit(1), last(e)), F.slice(e, F.lit(2), last(e)), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))))

        def slab(s: Column) -> Column:
            over = F.filter(good, lambda b: (b["x1"] < s["hi"]) & (b["x2"] > s["lo"]))
            spans = F.transform(over, lambda b: F.struct(b["y1"].cast("bigint").alias("lo"), b["y2"].cast("bigint").alias("hi")))
            return (s["hi"] - s["lo"]) * _height(spans)

        return F.aggregate(slabs, F.lit(0).cast("bigint"), lambda a, s: a + slab(s))

    return F.coalesce(let(F.filter(boxes, lambda b: valid(of(b))), area_of), F.lit(0).cast("bigint"))
