"""Box sets joined, matched and measured, one group (image, frame, instance) at a time.

Boxes of a group are collected into an array: a group is one image, whose boxes are few.
Joins are equi-joins on the group, so nothing compares boxes of different images.  What costs
more than a pass over the boxes is done in numpy for a whole Arrow batch of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions.text import let
from .evaluation import f1, ratio

_BOX = ("x1", "y1", "x2", "y2")


def box_list(boxes: DataFrame, group: str, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(group, array of boxes in order of idx)."""
    return boxes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("idx", *_BOX, *extra))).alias(name))


def in_batches(rows: DataFrame, keep: list[str], run, more: str) -> DataFrame:
    """Columns ``keep`` of the rows, and those of the schema ``more`` that ``run`` (Arrow batch to a list of arrays) gives."""
    kinds = T.StructType([rows.schema[k] for k in keep] + T._parse_datatype_string(more).fields)

    def each(batches):
        import pyarrow as pa

        for b in batches:
            got = [b.column(k) for k in keep] + [pa.array(x) for x in run(b)]
            yield pa.RecordBatch.from_arrays(got, names=kinds.names)

    return rows.mapInArrow(each, kinds)


def side_by_side(gold: DataFrame, pred: DataFrame, group: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(group, gt, pr) for each group of either side; a side without boxes has an empty array."""
    g, p = box_list(gold, group, "gt", extra), box_list(pred, group, "pr", extra)
    out = g.join(p, group, "full_outer")
    kind = dict(out.dtypes)
    return out.select(group, *[F.coalesce(c, F.array().cast(kind[c])).alias(c) for c in ("gt", "pr")])


def best_iou(gold: DataFrame, pred: DataFrame, group: str) -> DataFrame:
    """(group, idx, best_iou) of each gold box, 0 where its group has no prediction (J10, SP9)."""
    g, p = gold.alias("g"), pred.alias("p")
    # greatest and least skip nulls, so a missing prediction has to be kept from them
    pair = F.when(F.col("p.idx").isNotNull(), G.iou(G.box("g."), G.box("p.")))
    return g.join(p, group, "left").groupBy(F.col(f"g.{group}").alias(group), F.col("g.idx").alias("idx")).agg(F.coalesce(F.max(pair), F.lit(0.0)).alias("best_iou"))


def box_coverage(gt: Column, pr: Column) -> Column:
    """Mean best IoU of two arrays; 1 if both are empty, 0 if one is (SP9)."""
    best = F.transform(gt, lambda g: F.array_max(F.transform(pr, lambda p: G.iou(G.of(g), G.of(p)))))
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(gt)
    return F.when((F.size(gt) == 0) & (F.size(pr) == 0), 1.0).when((F.size(gt) == 0) | (F.size(pr) == 0), 0.0).otherwise(mean)


def greedy_matches(gt: Column, pr: Column, least: float) -> Column:
    """One-to-one pairs by falling (IoU, gold index, prediction index) down to a threshold.

    Conflicts propagate, so it is a fold over the sorted pairs and no window.
    """
    pairs = F.flatten(F.transform(gt, lambda g: F.transform(pr, lambda p: F.struct(G.iou(G.of(g), G.of(p)).alias("iou"), g["idx"].alias("g"), p["idx"].alias("p")))))
    order = F.sort_array(F.filter(pairs, lambda x: x["iou"] >= least), asc=False)
    add = lambda acc, x: F.when(F.exists(acc, lambda y: (y["g"] == x["g"]) | (y["p"] == x["p"])), acc).otherwise(F.array_append(acc, x))
    return let(order, lambda o: F.aggregate(o, F.slice(o, F.lit(1), F.lit(0)), add))


def ordered_matches(gt: Column, pr: Column, test) -> Column:
    """How many gold boxes, in order, find a free prediction that passes ``test``."""
    start = F.struct(F.lit(0).alias("n"), F.filter(F.transform(pr, lambda p: p["idx"]), lambda i: F.lit(False)).alias("used"))

    def step(s: Column, g: Column) -> Column:
        free = F.filter(pr, lambda p: test(g, p) & ~F.array_contains(s["used"], p["idx"]))
        hit = F.get(free, F.lit(0))
        return F.when(F.size(free) > 0, F.struct((s["n"] + 1).alias("n"), F.array_append(s["used"], hit["idx"]).alias("used"))).otherwise(s)

    return F.aggregate(gt, start, step)["n"]


def union_coverage(gt: Column, pr: Column) -> Column:
    """Sum over gold boxes of the share that all predictions together cover (SP8)."""
    part = lambda g: G.union_area(F.transform(pr, lambda p: G.intersection(G.of(g), G.of(p)).struct())) / G.area(G.of(g))
    return F.aggregate(F.transform(gt, part), F.lit(0.0), lambda a, x: a + x)


def detector_metrics(gold: DataFrame, pred: DataFrame, group: str, by: DataFrame, kind: str, least: float = 0.5) -> DataFrame:
    """Annotations, predictions, true positives, their ratios, mean best IoU and coverage, overall (kind null) and by kind.

    ``by`` maps a group to its kind.  Groups without gold boxes aren't evaluated.
    """
    rows = side_by_side(gold, pred, group).where(F.size("gt") > 0).join(by, group, "left").select(F.coalesce(F.col(kind), F.lit("UNKNOWN")).alias(kind), F.size("gt").alias("a"), F.size("pr").alias("p"), "gt", "pr")

    def run(batch):
        both = [A.flat(batch.column(k), ("idx", *_BOX)) for k in ("gt", "pr")]
        return A.evaluated(*both, least).values()

    each = in_batches(rows, [kind, "a", "p"], run, "tp long, iou double, cov double")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = each.rollup(kind).agg(n("a").alias("annotations"), n("p").alias("predictions"), n("tp").alias("true_positives"), n("iou").alias("iou"), n("cov").alias("cov"))
    c = F.col
    p, r = ratio(c("true_positives"), c("predictions")), ratio(c("true_positives"), c("annotations"))
    return out.select(kind, "annotations", "predictions", "true_positives", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(c("iou"), c("annotations")).alias("mean_best_iou"), ratio(c("cov"), c("annotations")).alias("mean_coverage"))


def union_area(boxes: DataFrame, group: str) -> DataFrame:
    """(group, area) of the union of each group's boxes (SP6)."""
    rows = boxes.groupBy(group).agg(F.collect_list(F.struct(*_BOX)).alias("b"))
    return in_batches(rows, [group], lambda batch: [A.union_area(A.flat(batch.column("b"), _BOX))], "area long")


def union_area_rows(boxes: DataFrame, group: str) -> DataFrame:
    """The same by rows, for groups of very many boxes: slabs between x edges, joined to the boxes that cross them."""
    edges = boxes.select(group, F.explode(F.array("x1", "x2")).alias("lo")).distinct()
    slabs = edges.withColumn("hi", F.lead("lo").over(W.partitionBy(group).orderBy("lo"))).where("hi is not null")
    over = slabs.join(boxes.withColumnRenamed(group, "__g"), (F.col(group) == F.col("__g")) & (F.col("x1") < F.col("hi")) & (F.col("x2") > F.col("lo")))
    w = W.partitionBy(group, "lo", "hi").orderBy("y1", "y2").rowsBetween(W.unboundedPreceding, -1)
    gain = F.greatest(F.lit(0), F.col("y2") - F.greatest("y1", F.coalesce(F.max("y2").over(w), F.col("y1"))))
    return over.withColumn("gain", gain).groupBy(group).agg(F.sum((F.col("hi") - F.col("lo")) * F.col("gain")).cast("bigint").alias("area"))


def intersections(gt: Column, pr: Column) -> Column:
    """All non-empty pairwise intersections of two arrays of boxes (SP4)."""
    each = F.flatten(F.transform(pr, lambda p: F.transform(gt, lambda g: G.intersection(G.of(p), G.of(g)).struct())))
    return F.filter(each, lambda b: G.valid(G.of(b)))


def clip_all(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes cut to a canvas, empty ones dropped (SP5)."""
    return F.filter(F.transform(boxes, lambda b: G.intersection(G.of(b), G.Box(F.lit(0), F.lit(0), width, height)).struct()), lambda b: G.valid(G.of(b)))


def over_redaction(gold: DataFrame, pred: DataFrame, group: str, width: int, height: int) -> DataFrame:
    """(group, false_positive_fraction, removed_fraction, over_redaction_score) (SP7).

    What two sets cover both is the sum of their areas less that of their union, so no pairs are formed.
    """

    def run(batch):
        import numpy as np

        g, p = (A.flat(batch.column(k), _BOX) for k in ("gt", "pr"))
        cg, cp = A.clip(g, width, height), A.clip(p, width, height)
        sets = (g, p, A.join_sets(g, p), cg, cp, A.join_sets(cg, cp))
        # all six in one call: a set of a group is a group of its own
        areas = A.union_area((np.concatenate([n for n, _ in sets]), [np.concatenate(x) for x in zip(*[f for _, f in sets])]))
        gold_, pred_, either, c_gold, c_pred, c_either = np.split(areas, 6)
        share = lambda x, y: np.where(y > 0, np.maximum(0, x) / np.maximum(1, y), 0.0)
        false = share(pred_ - (gold_ + pred_ - either), pred_)
        gone = np.minimum(1.0, share(c_pred - (c_gold + c_pred - c_either), np.maximum(0, width * height - c_gold)))
        return [false, gone, ((1.0 - false) + (1.0 - gone)) / 2.0]

    return in_batches(side_by_side(gold, pred, group), [group], run, "false_positive_fraction double, removed_fraction double, over_redaction_score double")


def nms(boxes: Column, limit: float, mode: str = "candidate") -> Column:
    """Greedy non-maximum suppression of an array of (score, idx, box), best first (SP13).

    candidate: overlap over the candidate's area, in pixels counted inclusively; iou: plain IoU.
    """
    order = F.sort_array(boxes, asc=False)

    def over(kept: Column, b: Column) -> Column:
        if mode == "iou":
            return G.iou(G.of(kept), G.of(b))
        one = lambda x: G.Box(x.x1, x.y1, x.x2 + 1, x.y2 + 1)
        return G.overlap(one(G.of(kept)), one(G.of(b))) / G.area(one(G.of(b)))

    add = lambda acc, b: F.when(F.exists(acc, lambda k: over(k, b) > limit), acc).otherwise(F.array_append(acc, b))
    return let(order, lambda o: F.aggregate(o, F.slice(o, F.lit(1), F.lit(0)), add))


def leakage(gold: DataFrame, pred: DataFrame, group: str, least_iou: float = 0.3, least_cover: float = 0.5) -> DataFrame:
    """One row: frames with gold boxes, frames where one isn't found, their share in per cent."""
    hit = lambda g, p: (G.iou(G.of(g), G.of(p)) >= least_iou) | (G.coverage(G.of(g), G.of(p)) >= least_cover)
    rows = side_by_side(gold, pred, group).where(F.size("gt") > 0)
    leaks = F.exists("gt", lambda g: ~F.exists("pr", lambda p: hit(g, p)))
    found = ordered_matches(F.col("gt"), F.col("pr"), hit)
    out = rows.agg(F.count("*").alias("frames"), F.count_if(leaks).alias("leaked"), F.coalesce(F.sum(found), F.lit(0)).cast("bigint").alias("tp"), F.coalesce(F.sum(F.size("gt")), F.lit(0)).cast("bigint").alias("entities"))
    return out.select("frames", "leaked", F.round(100.0 * ratio(F.col("leaked"), F.col("frames")), 6).alias("leakage_rate"), F.round(ratio(F.col("tp"), F.col("entities")), 6).alias("entity_recall"))


def viewport_preservation(boxes: DataFrame, group: str, width: int, height: int, radius: int) -> DataFrame:
    """(group, preserved): per cent of a centred disc's pixels that no box covers.

    Row by row of the image: the disc's chord minus the union of the boxes' spans on it.
    """
    cx, cy = width // 2, height // 2
    chord = {}
    for y in range(max(0, cy - radius), min(height, cy + radius + 1)):
        half = int((radius**2 - (y - cy) ** 2) ** 0.5)
        while (half + 1) ** 2 + (y - cy) ** 2 <= radius**2:
            half += 1
        while half**2 + (y - cy) ** 2 > radius**2:
            half -= 1
        chord[y] = (max(0, cx - half), min(width, cx + half + 1))
    safe = sum(b - a for a, b in chord.values())
    rows = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi")) for y, (a, b) in chord.items()])
    lists = boxes.groupBy(group).agg(F.collect_list(F.struct(*_BOX)).alias("b"))

    def covered(r: Column) -> Column:
        over = F.filter("b", lambda b: (b["y1"] <= r["y"]) & (b["y2"] > r["y"]) & (b["x1"] < r["hi"]) & (b["x2"] > r["lo"]))
        spans = F.transform(over, lambda b: F.struct(F.greatest(b["x1"].cast("bigint"), r["lo"]).alias("lo"), F.least(b["x2"].cast("bigint"), r["hi"]).alias("hi")))
        return G._height(spans)

    gone = F.aggregate(F.transform(rows, covered), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select(group, (F.lit(100.0) * (F.lit(safe) - gone) / F.lit(float(safe))).alias("preserved"))


def combine_line(words: Column, y_tolerance: int = 10, gap: int = 10) -> Column:
    """Words (text, box) merged along lines, in order of (y1, x1), against the growing box."""
    order = F.array_sort(F.transform(words, lambda w: F.struct(w["y1"].alias("k1"), w["x1"].alias("k2"), w["idx"].alias("k3"), w.alias("w"))))

    def step(acc: Column, item: Column) -> Column:
        w, last = item["w"], F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1))["y1"] - w["y1"]) <= y_tolerance) & (w["x1"] - F.try_element_at(acc, F.lit(-1))["x2"] <= gap)
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(
            F.concat(last["text"], F.lit(" "), w["text"]).alias("text"), F.least(last["x1"], w["x1"]).alias("x1"), F.least(last["y1"], w["y1"]).alias("y1"), F.greatest(last["x2"], w["x2"]).alias("x2"), F.greatest(last["y2"], w["y2"]).alias("y2")
        )
        alone = F.struct(w["text"].alias("text"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["x2"].alias("x2"), w["y2"].alias("y2"))
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.array_append(acc, alone))

    none = F.array().cast("array<struct<text:string,x1:int,y1:int,x2:int,y2:int>>")
    return F.aggregate(order, none, step)


def merge_scan(boxes: Column, kind: str) -> Column:
    """Neighbours of an ordered array merged as a detector does it.

    east: within 10 and 5 pixels, bounds grow, best confidence; word: within 8 and 5 pixels, the
    first upper edge and the last right edge stay; region: within 50 pixels on either axis.
    """

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        if kind == "region":
            joins = G.mergeable(G.of(last), G.of(b))
        else:
            joins = (F.abs(b["x1"] - last["x2"]) < (10 if kind == "east" else 8)) & (F.abs(b["y1"] - last["y1"]) < 5)
        low = {"east": last["x1"], "word": last["x1"], "region": F.least(last["x1"], b["x1"])}[kind]
        top = last["y1"] if kind == "word" else F.least(last["y1"], b["y1"])
        right = b["x2"] if kind == "word" else F.greatest(last["x2"], b["x2"])
        grown = F.struct(low.alias("x1"), top.alias("y1"), right.alias("x2"), F.greatest(last["y2"], b["y2"]).alias("y2"), F.greatest(last["conf"], b["conf"]).alias("conf"))
        alone = F.struct(*[b[k].alias(k) for k in (*_BOX, "conf")])
        return F.when((F.size(acc) > 0) & joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.array_append(acc, alone))

    none = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int,conf:double>>")
    return F.aggregate(boxes, none, step)


def reading_order(y: Column, x: Column, step: int) -> list[Column]:
    """Sort keys: the line (half to even), then x."""
    return [F.bround(y / F.lit(float(max(step, 1))), 0), x]


def split_regions(boxes: list[tuple[int, int, int, int]], axis: int = 0, gap: int = 25, depth: int = 0, most: int = 10) -> list[tuple[int, int, int, int]]:
    """Boxes cut apart at the widest gap, axis by axis; the bounds of what stays together (SP14)."""
    if not boxes:
        return []
    bounds = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))
    if len(boxes) == 1 or depth >= most:
        return [bounds]
    order = sorted(boxes, key=lambda b: (b[axis], b[1 - axis]))
    gaps = [(nxt[axis] - cur[axis + 2], -i) for i, (cur, nxt) in enumerate(zip(order, order[1:]))]
    wide, at = max(gaps)
    if wide > gap:
        return split_regions(order[: 1 - at], 1 - axis, gap, depth + 1, most) + split_regions(order[1 - at :], 1 - axis, gap, depth + 1, most)
    return split_regions(boxes, 1 - axis, gap, depth + 1, most) if depth == 0 else [bounds]


def region_split(boxes: DataFrame, group: str, gap: int = 25) -> DataFrame:
    """(group, region, box) of each group's regions (SP14); a group is one page's boxes."""
    kind = dict(boxes.dtypes)[group]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for g, xs in zip(pdf[group], pdf["b"]):
                found = split_regions([tuple(b[k] for k in _BOX) for b in xs], gap=gap)
                rows += [(g, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=[group, "region", *_BOX])

    # one row a page: pages travel to Python in batches, not one by one
    lists = boxes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*_BOX))).alias("b"))
    return lists.mapInPandas(run, f"{group} {kind}, region int, x1 int, y1 int, x2 int, y2 int")


def span_boxes(words: Column, target: Column) -> Column:
    """Boxes of the words that spell a target text (J17): at each word of it, the run that goes on; done at half of its words."""
    goal = F.filter(F.split(F.lower(target), r"\s+"), lambda w: w != "")

    def step(s: Column, w: Column) -> Column:
        at = F.array_position(goal, F.lower(w["text"]))
        rest = F.slice(goal, F.greatest(at, F.lit(1)).cast("int"), F.size(goal))
        ahead = F.slice(words, w["pos"], F.size(goal))
        n = F.aggregate(F.zip_with(ahead, rest, lambda a, b: F.coalesce(F.lower(a["text"]) == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda t, ok: F.struct(F.when(t["on"] & ok, t["n"] + 1).otherwise(t["n"]).alias("n"), (t["on"] & ok).alias("on")))["n"]
        found = F.concat(s["out"], F.slice(ahead, F.lit(1), n))
        return F.when(s["done"] | (at == 0), s).otherwise(F.struct(found.alias("out"), (F.size(found) >= F.size(goal) / 2).alias("done")))

    start = F.struct(F.filter(words, lambda w: F.lit(False)).alias("out"), F.lit(False).alias("done"))
    return F.aggregate(words, start, step)["out"]
