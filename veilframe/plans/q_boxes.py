"""Queries over boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import spatial as S
from .tables import query

BOXES = ("boxes_pred",)


def _inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _area(a: str) -> str:
    return f"greatest(0, {a}.x2 - {a}.x1) * greatest(0, {a}.y2 - {a}.y1)"


def _iou(a: str, b: str) -> str:
    return f"CASE WHEN {_inter(a, b)} = 0 THEN 0e0 ELSE {_inter(a, b)} / ({_area(a)} + {_area(b)} - {_inter(a, b)}) END"


def _union(name: str, src: str, key: str) -> str:
    """Union area by key of a relation (key, x1..y2): slabs, then merged spans."""
    return f"""{name}_e AS (SELECT DISTINCT {key}, x FROM (SELECT {key}, x1 AS x FROM {src} UNION ALL SELECT {key}, x2 FROM {src})), {name}_s AS (SELECT {key}, x AS lo, lead(x) OVER (PARTITION BY {key} ORDER BY x) AS hi FROM {name}_e),
    {name}_o AS (SELECT s.{key}, lo, hi, y1, y2, max(y2) OVER (PARTITION BY s.{key}, lo ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {name}_s s JOIN {src} b ON s.{key} = b.{key} AND b.x1 < s.hi AND b.x2 > s.lo WHERE hi IS NOT NULL),
    {name} AS (SELECT {key}, sum((hi - lo) * greatest(0, y2 - greatest(y1, coalesce(top, y1))))::BIGINT AS area FROM {name}_o GROUP BY {key})"""


@query("box_iou_best", f"SELECT g.instance, g.idx, round(coalesce(max({_iou('g', 'p')}) FILTER (p.idx IS NOT NULL), 0e0), 9) AS best_iou FROM boxes_gt g LEFT JOIN boxes_pred p ON g.instance = p.instance GROUP BY g.instance, g.idx", BOXES)
def box_iou_best(t):
    """Best IoU of each gold box (J10, SP1, SP2)."""
    g, p = t.boxes()
    return S.best_iou(g, p, "instance").withColumn("best_iou", F.round("best_iou", 9))


_GREEDY = f"""pairs AS (SELECT g.instance, list({{'iou': {_iou("g", "p")}, 'g': g.idx, 'p': p.idx}} ORDER BY {_iou("g", "p")} DESC, g.idx DESC, p.idx DESC) AS l FROM boxes_gt g JOIN boxes_pred p ON g.instance = p.instance WHERE {_iou("g", "p")} >= 5e-1 GROUP BY g.instance),
    m AS (SELECT instance, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.g = x[1].g OR y.p = x[1].p)) > 0 THEN a ELSE list_concat(a, x) END) AS m FROM pairs)"""


@query("box_greedy_match", f"WITH {_GREEDY}, u AS (SELECT instance, unnest(m) AS r FROM m) SELECT instance, r.g AS g, r.p AS p, round(r.iou, 9) AS iou FROM u", BOXES)
def box_greedy_match(t):
    """One-to-one matches by falling IoU."""
    rows = S.side_by_side(*t.boxes(), "instance")
    return rows.select("instance", F.inline(S.greedy_matches(F.col("gt"), F.col("pr"), 0.5))).select("instance", "g", "p", F.round("iou", 9).alias("iou"))


_COVER = f"""cut AS (SELECT g.instance || '/' || g.idx AS k, greatest(g.x1, p.x1) AS x1, greatest(g.y1, p.y1) AS y1, least(g.x2, p.x2) AS x2, least(g.y2, p.y2) AS y2 FROM boxes_gt g JOIN boxes_pred p ON g.instance = p.instance WHERE {_inter("g", "p")} > 0), {_union("cov", "cut", "k")}"""


@query(
    "detector_metrics",
    f"""WITH {_GREEDY}, {_COVER}, b AS (SELECT g.instance, g.idx, coalesce(max({_iou("g", "p")}) FILTER (p.idx IS NOT NULL), 0e0) AS best FROM boxes_gt g LEFT JOIN boxes_pred p ON g.instance = p.instance GROUP BY g.instance, g.idx),
    g AS (SELECT b.instance, count(*) AS a, sum(best) AS iou, sum(coalesce(area, 0) / ({_area("z")})) AS cov FROM b JOIN boxes_gt z ON b.instance = z.instance AND b.idx = z.idx LEFT JOIN cov ON cov.k = b.instance || '/' || b.idx GROUP BY b.instance),
    e AS (SELECT g.*, coalesce(o_orderpriority, 'UNKNOWN') AS modality, coalesce((SELECT count(*) FROM boxes_pred p WHERE p.instance = g.instance), 0) AS p, coalesce(len(m.m), 0) AS tp FROM g LEFT JOIN m USING (instance) LEFT JOIN orders ON o_orderkey = g.instance),
    r AS (SELECT modality, sum(a)::BIGINT AS annotations, sum(p)::BIGINT AS predictions, sum(tp)::BIGINT AS true_positives, sum(iou) AS iou, sum(cov) AS cov FROM e GROUP BY ROLLUP (modality))
    SELECT modality, annotations, predictions, true_positives, round(true_positives / predictions, 6) AS precision, round(true_positives / annotations, 6) AS recall, round(2e0 * true_positives / (annotations + predictions), 6) AS f1, round(iou / annotations, 6) AS mean_best_iou, round(cov / annotations, 6) AS mean_coverage FROM r""",
    BOXES,
)
def detector_metrics(t):
    """Precision, recall, F1, IoU and coverage by modality and overall (A7, A8, J6, SP8, SP9)."""
    m = S.detector_metrics(*t.boxes(), "instance", t.modality(), "modality")
    return m.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in m.dtypes])


@query("box_union_area", f"WITH {_union('u', 'boxes_pred', 'instance')} SELECT instance, area FROM u", BOXES)
def box_union_area(t):
    """Area that the boxes of an instance cover (SP6)."""
    return S.union_area(t.boxes_pred(), "instance")


@query("box_union_area_rows", f"WITH {_union('u', 'boxes_gt', 'instance')} SELECT instance, area FROM u", BOXES)
def box_union_area_rows(t):
    """The same by rows (SP6)."""
    return S.union_area_rows(t.boxes()[0], "instance")


_CLIP = "greatest(x1, 0) AS x1, greatest(y1, 0) AS y1, least(x2, 100) AS x2, least(y2, 80) AS y2"
_PAIR = "greatest(g.x1, p.x1) AS x1, greatest(g.y1, p.y1) AS y1, least(g.x2, p.x2) AS x2, least(g.y2, p.y2) AS y2"
_OK = "x2 > x1 AND y2 > y1"


@query(
    "over_redaction",
    f"""WITH bth AS (SELECT * FROM (SELECT g.instance, {_PAIR} FROM boxes_gt g JOIN boxes_pred p ON g.instance = p.instance) WHERE {_OK}), cg AS (SELECT * FROM (SELECT instance, {_CLIP} FROM boxes_gt) WHERE {_OK}), cp AS (SELECT * FROM (SELECT instance, {_CLIP} FROM boxes_pred) WHERE {_OK}),
    cb AS (SELECT * FROM (SELECT g.instance, {_PAIR} FROM cg g JOIN cp p ON g.instance = p.instance) WHERE {_OK}), {_union("ub", "bth", "instance")}, {_union("up", "boxes_pred", "instance")}, {_union("ucg", "cg", "instance")}, {_union("ucp", "cp", "instance")}, {_union("ucb", "cb", "instance")},
    k AS (SELECT instance FROM boxes_gt UNION SELECT instance FROM boxes_pred), a AS (SELECT k.instance, coalesce(up.area, 0) AS p, coalesce(ub.area, 0) AS b, coalesce(ucg.area, 0) AS cg, coalesce(ucp.area, 0) AS cp, coalesce(ucb.area, 0) AS cb FROM k LEFT JOIN up USING (instance) LEFT JOIN ub USING (instance) LEFT JOIN ucg USING (instance) LEFT JOIN ucp USING (instance) LEFT JOIN ucb USING (instance)),
    f AS (SELECT instance, coalesce(greatest(0, p - b) / nullif(p, 0), 0e0) AS f, least(1e0, coalesce(greatest(0, cp - cb) / nullif(greatest(0, 8000 - cg), 0), 0e0)) AS r FROM a)
    SELECT instance, f AS false_positive_fraction, r AS removed_fraction, ((1e0 - f) + (1e0 - r)) / 2e0 AS over_redaction_score FROM f""",
    BOXES,
)
def over_redaction(t):
    """What is covered needlessly, of the boxes and of the canvas (SP4, SP5, SP7)."""
    return S.over_redaction(*t.boxes(), "instance", 100, 80)


_ONE = "greatest(0, least(y.x2, x[1].x2) + 1 - greatest(y.x1, x[1].x1)) * greatest(0, least(y.y2, x[1].y2) + 1 - greatest(y.y1, x[1].y1)) / ((x[1].x2 + 1 - x[1].x1) * (x[1].y2 + 1 - x[1].y1))"


@query(
    "box_nms",
    f"""WITH l AS (SELECT instance, list({{'conf': conf, 'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY conf DESC, idx DESC) AS l FROM boxes_pred GROUP BY instance),
    k AS (SELECT instance, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: {_ONE} > 3e-1)) > 0 THEN a ELSE list_concat(a, x) END) AS k FROM l), u AS (SELECT instance, unnest(k) AS r FROM k) SELECT instance, r.idx AS idx, r.conf AS conf FROM u""",
    BOXES,
)
def box_nms(t):
    """Boxes that survive non-maximum suppression (SP13)."""
    rows = t.boxes_pred().groupBy("instance").agg(F.collect_list(F.struct("conf", "idx", "x1", "y1", "x2", "y2")).alias("b"))
    return rows.select("instance", F.inline(S.nms(F.col("b"), 0.3))).select("instance", "idx", "conf")


@query(
    "phi_leakage",
    f"""WITH a AS (SELECT g.instance, g.idx, coalesce(max(CASE WHEN {_iou("g", "p")} >= 3e-1 OR {_inter("g", "p")} / ({_area("g")}) >= 5e-1 THEN 1 ELSE 0 END) FILTER (p.idx IS NOT NULL), 0) AS hit FROM boxes_gt g LEFT JOIN boxes_pred p ON g.instance = p.instance GROUP BY g.instance, g.idx),
    f AS (SELECT instance, min(hit) AS ok FROM a GROUP BY instance) SELECT count(*) AS frames, count(*) FILTER (ok = 0) AS leaked, round(1e2 * count(*) FILTER (ok = 0) / count(*), 6) AS leakage_rate FROM f""",
    BOXES,
)
def phi_leakage(t):
    """Frames in which a gold box isn't found."""
    return S.leakage(*t.boxes(), "instance").select("frames", "leaked", "leakage_rate")


@query("entity_recall")
def entity_recall(t):
    """Gold boxes that find a free prediction in order (J12, A16); tested against brute force."""
    return S.leakage(*t.boxes(), "instance").select("entity_recall")


@query(
    "viewport_preservation",
    f"""WITH y AS (SELECT unnest(generate_series(0, 79)) AS y), ch AS (SELECT y, greatest(0, 50 - floor(sqrt(900 - (y - 40) * (y - 40)))::INT) AS lo, least(100, 51 + floor(sqrt(900 - (y - 40) * (y - 40)))::INT) AS hi FROM y WHERE abs(y - 40) <= 30),
    o AS (SELECT instance, y, greatest(x1, lo) AS a, least(x2, hi) AS b FROM boxes_pred JOIN ch ON y1 <= y AND y2 > y AND x1 < hi AND x2 > lo), w AS (SELECT *, max(b) OVER (PARTITION BY instance, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o),
    g AS (SELECT instance, sum(greatest(0, b - greatest(a, coalesce(top, a)))) AS gone FROM w GROUP BY instance), s AS (SELECT sum(hi - lo) AS safe FROM ch), k AS (SELECT DISTINCT instance FROM boxes_pred)
    SELECT instance, round(1e2 * (safe - coalesce(gone, 0)) / safe, 6) AS preserved FROM k LEFT JOIN g USING (instance), s""",
    BOXES,
)
def viewport_preservation(t):
    """Per cent of the viewport's disc that stays visible."""
    return S.viewport_preservation(t.boxes_pred(), "instance", 100, 80, 30).withColumn("preserved", F.round("preserved", 6))


@query("lines_combined")
def lines_combined(t):
    """Words merged along lines."""
    w = t.boxes()[0].withColumn("text", F.concat(F.lit("w"), F.col("idx").cast("string")))
    rows = w.groupBy("instance").agg(F.collect_list(F.struct("idx", "text", "x1", "y1", "x2", "y2")).alias("w"))
    return rows.select("instance", F.inline(S.combine_line(F.col("w"))))


@query("detections_merged")
def detections_merged(t):
    """Neighbours merged by three detectors' rules."""
    p = t.boxes_pred()
    y, x = S.reading_order(F.col("y1"), F.col("x1"), 10)
    rows = p.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct(y.alias("line"), x.alias("x"), "idx", F.struct("x1", "y1", "x2", "y2", "conf").alias("b")))), lambda r: r["b"]).alias("b"))
    return rows.select("instance", *[F.size(S.merge_scan(F.col("b"), k)).alias(k) for k in ("east", "word", "region")])


@query("region_split")
def region_split(t):
    """Boxes cut apart at wide gaps (SP14)."""
    return S.region_split(t.boxes()[0], "instance", 8)


@query(
    "box_transforms",
    """WITH b AS (SELECT instance, idx, x1, y1, x2, y2 FROM boxes_gt), c AS (SELECT *, greatest(0, least(x1 - 4, 100)) AS a1, greatest(0, least(y1 - 4, 80)) AS b1, greatest(0, least(x2 + 4, 100)) AS a2, greatest(0, least(y2 + 4, 80)) AS b2 FROM b)
    SELECT instance, idx, CASE WHEN a2 > a1 AND b2 > b1 THEN a1 END AS cx1, CASE WHEN a2 > a1 AND b2 > b1 THEN b2 END AS cy2, round(greatest(0e0, x1 * 6e0 - 2e0), 6) AS px1, round(greatest(0e0, 8e2 - y2 * 1e1 - 2e0), 6) AS py1,
      printf('0 %.8f %.8f %.8f %.8f', (x1 + (least(x2, 200) - x1) / 2e0) / 2e2, (y1 + (least(y2, 160) - y1) / 2e0) / 16e1, (least(x2, 200) - x1) / 2e2, (least(y2, 160) - y1) / 16e1) AS yolo,
      CASE WHEN least(200, x2 + 20) - greatest(0, x1 - 20) >= 100 AND least(160, y2 + 20) - greatest(0, y1 - 20) >= 30 THEN greatest(0, x1 - 20) ELSE -1 END AS region_x1 FROM c""",
    BOXES,
)
def box_transforms(t):
    """Clamped, in page units, as label lines and as crop regions (SP10, SP11, SP15, SP19, SC20)."""
    b, i = G.box(), F.lit
    c, p, r = G.clamp(b, i(100), i(80), 4), G.to_pdf(b, i(600.0), i(800.0), i(100), i(80)), G.region_ok(b, i(200), i(160))
    return t.boxes()[0].select("instance", "idx", c.x1.alias("cx1"), c.y2.alias("cy2"), F.round(p.x1, 6).alias("px1"), F.round(p.y1, 6).alias("py1"), G.yolo_line(b, i(200), i(160)).alias("yolo"), F.coalesce(r.x1, F.lit(-1)).alias("region_x1"))


@query(
    "mask_regions",
    """WITH b AS (SELECT instance, idx, greatest(0, round_even(x1 * 2e0, 0)::INT) AS x, greatest(0, round_even(y1 * 15e-1, 0)::INT) AS y, round_even((x2 - x1) * 2e0, 0)::INT AS w, round_even((y2 - y1) * 15e-1, 0)::INT AS h FROM boxes_gt), m AS (SELECT instance, idx, x, y, least(w, 200 - x) AS w, least(h, 120 - y) AS h FROM b WHERE x < 200 AND y < 120)
    SELECT instance, idx, CASE WHEN ((w - x % 2) // 2) * 2 > 0 AND ((h - y % 2) // 2) * 2 > 0 THEN 'crop=' || ((w - x % 2) // 2) * 2 || ':' || ((h - y % 2) // 2) * 2 || ':' || (x + x % 2) || ':' || (y + y % 2) ELSE '' END AS crop,
      concat_ws(',', CASE WHEN x > 0 THEN 'drawbox=0:0:' || x || ':ih:color=black@1:t=fill' END, CASE WHEN x + w < 200 THEN 'drawbox=' || (x + w) || ':0:iw-' || (x + w) || ':ih:color=black@1:t=fill' END, CASE WHEN y > 0 THEN 'drawbox=0:0:iw:' || y || ':color=black@1:t=fill' END,
        CASE WHEN y + h < 120 THEN 'drawbox=0:' || (y + h) || ':iw:ih-' || (y + h) || ':color=black@1:t=fill' END) AS mask FROM m""",
    BOXES,
)
def mask_regions(t):
    """Scaled regions as crop and mask filters (SP16, SP17)."""
    c, i = F.col, F.lit
    m = G.mask_region(c("x1"), c("y1"), c("x2") - c("x1"), c("y2") - c("y1"), (i(100), i(80)), (i(200), i(120)))
    rows = t.boxes()[0].select("instance", "idx", *[v.alias(k) for k, v in m.items()]).where("x is not null")
    r = {k: c(k) for k in m}
    return rows.select("instance", "idx", G.crop_filter(r, i(200), i(120)).alias("crop"), G.mask_filter(r, i(200), i(120)).alias("mask"))


@query(
    "model_boxes",
    """WITH b AS (SELECT instance, idx, x1 + 10 AS cx, y1 + 10 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM boxes_gt), s AS (SELECT *, least(64e0 / 300, 64e0 / 200) AS k, 0 AS ox, ((64 - 43) / 2) AS oyf FROM b),
    p AS (SELECT instance, idx, round_even(((cx - w / 2e0) - ox) / k, 0)::INT AS x1, round_even(((cy - h / 2e0) - floor(oyf)) / k, 0)::INT AS y1, round_even(((cx + w / 2e0) - ox) / k, 0)::INT AS x2, round_even(((cy + h / 2e0) - floor(oyf)) / k, 0)::INT AS y2 FROM s),
    c AS (SELECT instance, idx, greatest(0, least(x1, 300)) AS x1, greatest(0, least(y1, 200)) AS y1, greatest(0, least(x2, 300)) AS x2, greatest(0, least(y2, 200)) AS y2 FROM p) SELECT instance, idx, x1, y1, x2, y2 FROM c WHERE x2 > x1 AND y2 > y1""",
    BOXES,
)
def model_boxes(t):
    """Detections in letterboxed input back in image pixels (SP12, F4)."""
    c, i = F.col, F.lit
    box = G.from_model((c("x1") + 10, c("y1") + 10, c("x2") - c("x1"), c("y2") - c("y1")), G.letterbox(i(300), i(200), 64), i(300), i(200), 64)
    return t.boxes()[0].select("instance", "idx", *[v.alias(k) for k, v in box._asdict().items()]).where("x1 is not null")


@query(
    "close_boxes",
    """WITH p AS (SELECT instance, idx, x1, y1, x2, y2 FROM boxes_gt WHERE idx = 1), c AS (SELECT p.instance, arg_min({'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}, {'x': b.x1, 'i': b.idx}) AS r FROM p JOIN boxes_gt b ON p.instance = b.instance AND abs(b.y1 - p.y1) <= 10 AND b.x1 >= p.x2 + (p.x2 - p.x1) + 20 GROUP BY p.instance)
    SELECT p.instance, coalesce(r.x1, least(x2 + (x2 - x1) + 20, 300 - (x2 - x1))) AS x1, coalesce(r.y1, y1) AS y1, coalesce(r.x2, least(least(x2 + (x2 - x1) + 20, 300 - (x2 - x1)) + (x2 - x1), 300)) AS x2, coalesce(r.y2, y2) AS y2 FROM p LEFT JOIN c USING (instance)""",
    BOXES,
)
def close_boxes(t):
    """The next free box on the line, or a new one beside."""
    g = t.boxes()[0]
    p = g.where("idx = 1").select("instance", *[F.col(k).alias(f"p{k}") for k in G.Box._fields])
    c, P = F.col, G.box("p")
    fits = (F.abs(c("y1") - P.y1) <= 10) & (c("x1") >= P.x2 + F.greatest(P.x2 - P.x1 + 20, F.lit(20)))
    found = p.join(g, "instance").groupBy("instance", *P).agg(F.min_by(F.when(fits, G.box().struct()), F.when(fits, F.struct("x1", "idx"))).alias("r"))
    new = G.place_beside(P, F.lit(300))
    return found.select("instance", *[F.coalesce(c(f"r.{k}"), v).alias(k) for k, v in new._asdict().items()])


@query(
    "detector_union",
    """WITH a AS (SELECT instance, x1, y1, x2, y2 FROM boxes_gt WHERE idx % 2 = 0 UNION SELECT instance, x1, y1, x2, y2 FROM boxes_pred), c AS (SELECT DISTINCT instance, greatest(0, least(x1, 90)) AS x1, greatest(0, least(y1, 70)) AS y1, greatest(0, least(x2, 90)) AS x2, greatest(0, least(y2, 70)) AS y2 FROM a) SELECT * FROM c WHERE x2 > x1 AND y2 > y1""",
    BOXES,
)
def detector_union(t):
    """Clamped regions of several detectors without repeats."""
    cols = ["instance", *G.Box._fields]
    g, p = t.boxes()
    c = G.clamp(G.box(), F.lit(90), F.lit(70))
    both = g.where("idx % 2 = 0").select(*cols).unionByName(p.select(*cols))
    return both.select("instance", *[v.alias(k) for k, v in c._asdict().items()]).where("x1 is not null").distinct()


@query("span_boxes")
def span_boxes(t):
    """Boxes of the words of a target text."""
    w = t.boxes()[0].groupBy("instance").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("pos"), F.concat(F.lit("w"), (F.col("idx") % 3).cast("string")).alias("text"), *G.Box._fields))).alias("w"))
    return w.select("instance", F.inline(S.span_boxes(F.col("w"), F.lit("W1 w2")))).select("instance", "pos", *G.Box._fields)
