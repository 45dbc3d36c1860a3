"""Queries of record operators, regions, maps and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import geometry as G
from ..functions import sensitive as N
from ..functions import text as X
from ..operators import records as O
from ..sources import files as FI
from ..sources import records as R
from ..sources import sinks as SK
from ..sources.shared import folder
from .q_text import _strip
from .tables import FIRST, LAST, lit, query, spread

c = F.col


@query(
    "sensitive_spans",
    f"""SELECT doc_id, s.kind AS kind, len(s.m) AS n, s.m[1] AS first FROM (SELECT doc_id, unnest([{", ".join(f"{{'kind': '{k}', 'm': regexp_extract_all(text, {lit(p)})}}" for k, p in N.PATTERNS.items())}]) AS s FROM documents) WHERE len(s.m) > 0""", wide="n")
def sensitive_spans(t):
    """Matches of each kind of sensitive span."""
    return t.documents.select("doc_id", F.inline(N.spans(c("text")))).select("doc_id", "kind", F.size("found").alias("n"), c("found")[0].alias("first"))


@query("min_text_frames", f"SELECT video, frame FROM frames WHERE length({_strip('text')}) >= 40", ("frames",))
def min_text_frames(t):
    """Frames with enough text (F1)."""
    return t.frames().where(O.min_text(c("text"), 40)).select("video", "frame")


@query("confident_words", f"SELECT video, frame FROM frames WHERE {_strip('text')} <> '' AND conf * 100 >= 60 AND length(text) % 50 > 0 AND frame % 5 > 0", ("frames",))
def confident_words(t):
    """Words of enough confidence with a box (F2)."""
    return t.frames().where(O.confident_word(c("text"), c("conf") * 100, F.length("text") % 50, c("frame") % 5, 0.6)).select("video", "frame")


@query("detector_rows", "SELECT instance, idx, conf FROM boxes_pred WHERE conf >= 4e-1 AND x2 > x1 AND y2 > y1 AND idx % 4 IN (0, 2)", ("boxes_pred",))
def detector_rows(t):
    """Detections of listed classes and enough score."""
    return t.boxes_pred().where(O.detector_row(G.box(), c("conf"), c("idx") % 4, 0.4, (0, 2))).select("instance", "idx", "conf")


@query("top_classes", "SELECT instance, idx, CASE WHEN a >= b AND a >= d THEN 0 WHEN b >= d THEN 1 ELSE 2 END::INT AS cls, greatest(a, b, d) AS score FROM (SELECT instance, idx, conf AS a, (idx % 10) / 1e1 AS b, 55e-2 AS d FROM boxes_pred)", ("boxes_pred",))
def top_classes(t):
    """Class of the greatest score of raw detector rows."""
    return t.boxes_pred().select("instance", "idx", O.top_class(F.array("conf", (c("idx") % 10) / 10.0, F.lit(0.55))).alias("t")).select("instance", "idx", "t.cls", "t.score")


@query("patient_signal", "SELECT file, count(*) FILTER (first_name IS NOT NULL OR last_name IS NOT NULL) AS with_signal, count(*) AS records FROM predicted GROUP BY file", ("predicted",))
def patient_signal(t):
    """Records that name a patient."""
    return t.predicted().groupBy("file").agg(F.count_if(O.patient_signal(c("first_name"), c("last_name"))).alias("with_signal"), F.count("*").alias("records"))


@query("priority_frames", "SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY coalesce(conf, 5e-1) DESC, frame)::INT AS priority FROM (SELECT video, frame, CASE WHEN frame % 7 <> 0 THEN conf END AS conf FROM frames)", ("frames",))
def priority_frames(t):
    """Frames by falling confidence, unknown ones as 0.5."""
    return O.by_confidence(t.frames().withColumn("conf", F.when(c("frame") % 7 != 0, c("conf"))), "video", "conf", "frame").select("video", "frame", "priority")


@query("labels_of_images", "SELECT o_orderkey AS instance, count(b.instance) AS n_boxes, coalesce(string_agg(x1 || ' ' || y1 || ' ' || x2 || ' ' || y2, ';' ORDER BY x1, y1, x2, y2), '') AS boxes FROM orders LEFT JOIN (SELECT * FROM boxes_gt WHERE l_partkey % 3 = 0) b ON b.instance = o_orderkey GROUP BY o_orderkey", ("boxes_gt",), wide="n_boxes")
def labels_of_images(t):
    """Boxes of each image, none for a negative."""
    out = O.with_boxes(t.orders.select(c("o_orderkey").alias("instance")), t.boxes_gt().where(c("l_partkey") % 3 == 0), "instance")
    text = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", b["x1"].cast("string"), b["y1"].cast("string"), b["x2"].cast("string"), b["y2"].cast("string"))), ";")
    return out.select("instance", F.size("boxes").alias("n_boxes"), text.alias("boxes"))


@query("imprints_of_images", "SELECT c_custkey, n_name AS imprint FROM customer JOIN nation ON c_nationkey = n_nationkey")
def imprints_of_images(t):
    """Each image with its imprint; a missing one is an error."""
    right = t.nation.select(c("n_nationkey").alias("key"), c("n_name").alias("imprint"))
    return O.required_join(t.customer.select("c_custkey", c("c_nationkey").alias("key")), right, "key", "imprint").select("c_custkey", "imprint")


_PIPELINES = [("R1", "text_report"), ("R2", "text_report"), ("V1", "video_frame"), ("V2", "video_frame"), ("V3", "video_frame")]


@query("matrix_runs", f"SELECT video, frame, pipeline FROM (SELECT *, CASE WHEN role = 'user' THEN 'video_frame' ELSE 'text_report' END AS input_type FROM frames) JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PIPELINES)}) p(pipeline, input_type) USING (input_type)", ("frames",))
def matrix_runs(t):
    """Samples with the pipelines of their modality."""
    kind = R.input_type(F.when(c("role") == "user", F.lit(" Image-Frame")).otherwise("PDF"))
    return O.runs_of(t.frames().withColumn("input_type", kind), t.spark.createDataFrame(_PIPELINES, "pipeline string, input_type string")).select("video", "frame", "pipeline")


_ENTRIES = ["Adlerhof", "Beckermann", "Conradty", "Deckers", "Engelsmann", "Fischer", "Geigers", "Hellers", "Jaegers", "Lehmanns"]


@query(
    "corrected_names", f"""WITH x AS (SELECT ord, last_name AS word FROM predicted), e AS (SELECT unnest([{", ".join(map(lit, _ENTRIES))}]) AS entry),
    r AS (SELECT word, entry, 1 - levenshtein(word, entry) / (length(entry) * 1e0) AS r FROM (SELECT DISTINCT word FROM x) JOIN e ON length(entry) > length(word)),
    b AS (SELECT word, min_by(entry, (-r, entry)) AS e FROM r WHERE r > 85e-2 GROUP BY word) SELECT ord, coalesce(e, word) AS fixed FROM x LEFT JOIN b USING (word)""", ("predicted",))
def corrected_names(t):
    """Words replaced by a longer entry that is nearly alike."""
    words = t.predicted().select("ord", c("last_name").alias("word"))
    return O.corrected(words, t.spark.createDataFrame([(e,) for e in _ENTRIES], "entry string"), "word").select("ord", "fixed")


_FIXES = {"the": "THE", "model": "modell", "data": "dates"}


@query("spelled_lines", f"SELECT doc_id, string_agg(CASE WHEN length({_strip('line')}) < 4 OR regexp_matches(line, '[0-9]') THEN line ELSE array_to_string(list_transform(string_split(line, ' '), lambda w: CASE {' '.join(f"WHEN lower(w) = '{a}' THEN '{b}'" for a, b in _FIXES.items())} ELSE w END), ' ') END, chr(10) ORDER BY pos) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY doc_id")
def spelled_lines(t):
    """Lines with the words that a dictionary corrects."""
    fixes = F.create_map(*[F.lit(x) for kv in _FIXES.items() for x in kv])
    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x: O.spelled(x, fixes)), "\n").alias("text"))


@query("redaction_totals", "SELECT count(DISTINCT instance) AS pages, count(*) AS regions, min(conf) AS min_conf, max(conf) AS max_conf, round(avg(conf), 6) AS mean_conf FROM boxes_pred", ("boxes_pred",))
def redaction_totals(t):
    """Pages, regions and confidences."""
    return O.redaction_summary(t.boxes_pred(), "instance", "conf").withColumn("mean_conf", F.round("mean_conf", 6))


@query("source_completeness", """SELECT p.ord AS ord, ((coalesce(trim(p.first_name), '') <> '' OR coalesce(trim(g.first_name), '') <> '')::INT + (coalesce(trim(p.last_name), '') <> '')::INT + (coalesce(trim(g.dob), '') <> '')::INT) / 3e0 AS completeness,
    array_to_string(list_filter([CASE WHEN coalesce(trim(p.first_name), '') <> '' OR coalesce(trim(p.last_name), '') <> '' THEN 'llm' END, CASE WHEN coalesce(trim(g.first_name), '') <> '' OR coalesce(trim(g.dob), '') <> '' THEN 'rules' END], lambda x: x IS NOT NULL), ',') AS used
    FROM predicted p JOIN (SELECT ord, CASE WHEN ord % 4 <> 0 THEN first_name END AS first_name, CASE WHEN ord % 3 = 0 THEN dob END AS dob FROM gold) g USING (ord)""", ("predicted",))
def source_completeness(t):
    """Fields that any source fills, and the sources used."""
    g = t.gold().select("ord", F.when(c("ord") % 4 != 0, c("first_name")).alias("f"), F.when(c("ord") % 3 == 0, c("dob")).alias("d"))
    share, used = O.completeness({"llm": {"first_name": c("first_name"), "last_name": c("last_name")}, "rules": {"first_name": c("f"), "dob": c("d")}})
    return t.predicted().drop("dob").join(g, "ord").select("ord", share.alias("completeness"), F.array_join(used, ",").alias("used"))


@query("sampler_stats", "SELECT count(*) AS samples, round(coalesce(avg(conf), 0), 6) AS avg_score, coalesce(max(conf), 0) AS max_score FROM frames WHERE conf > 5e-1", ("frames",))
def sampler_stats(t):
    """Samples of a frame selector and their scores."""
    return O.sampler_stats(t.frames().where("conf > 0.5"), "conf").withColumn("avg_score", F.round("avg_score", 6))


@query("zipped_frames", "SELECT video, frame, text FROM frames", ("frames",))
def zipped_frames(t):
    """Parallel arrays back to rows."""
    lists = t.frames().groupBy("video").agg(F.array_sort(F.collect_list(F.struct("frame", "text"))).alias("x")).select("video", c("x.frame").alias("frame"), c("x.text").alias("text"))
    return O.zipped(lists, ["frame", "text"])


@query("required_fields", "SELECT event_id, props->>'$.k' AS k FROM events")
def required_fields(t):
    """Named values of an open map."""
    return t.events.select("event_id", *O.required(F.from_json("props", "map<string,string>"), ["k"]))


@query("name_templates", "SELECT ord, replace(replace(CASE WHEN ord % 2 = 0 THEN 'last_name, first_name' ELSE 'first_name last_name' END, 'first_name', first_name), 'last_name', coalesce(last_name, '-')) AS name, CASE WHEN ord % 3 = 0 THEN first_name || '|' || coalesce(last_name, '-') WHEN ord % 3 = 1 THEN coalesce(last_name, '-') || ', ' || first_name ELSE first_name || ' ' || coalesce(last_name, '-') END AS lines FROM gold", ("gold",))
def name_templates(t):
    """Names in a device's format, and as lines of a layout."""
    first, last = c("first_name"), F.coalesce("last_name", F.lit("-"))
    layout = F.element_at(F.array(*map(F.lit, ("separate", "last_first", "one"))), (c("ord") % 3 + 1).cast("int"))
    form = F.when(c("ord") % 2 == 0, "last_name, first_name").otherwise("first_name last_name")
    return t.gold().select("ord", O.formatted_name(form, first, last).alias("name"), F.array_join(O.name_layout(layout, first, last), "|").alias("lines"))


@query("identifier_counterparts", r"SELECT doc_id, part, line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS part FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '\bthe\b') THEN [text, regexp_replace(text, '\bthe\b', 'der', 'g')] ELSE [text] END AS x FROM documents))", wide="part")
def identifier_counterparts(t):
    """Lines that name an identifier, with its counterpart behind them."""
    return t.documents.select("doc_id", F.posexplode(O.with_counterpart(c("text"), "the", "der")).alias("part", "line"))


@query("metadata_payloads", """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS phone FROM customer""")
def metadata_payloads(t):
    """Records from flat, nested and broken JSON (K9)."""
    flat = F.to_json(F.struct(c("c_name").alias("name"), c("c_mktsegment").alias("phone")))
    raw = F.when(c("c_custkey") % 5 == 0, "[1, 2]").when(c("c_custkey") % 2 == 0, flat).otherwise(F.concat(F.lit('{"source": 1, "llm_extracted": '), flat, F.lit("}")))
    return t.customer.select("c_custkey", O.payload(raw, "name string, phone string").alias("p")).select("c_custkey", "p.name", "p.phone")


@query("final_texts", "SELECT ord, CASE WHEN ord % 3 = 0 THEN 'best ' || ord WHEN ord % 3 = 1 THEN 'known ' || ord ELSE concat_ws(' | ', concat_ws(' ', first_name, last_name), 'DOB: ' || dob) END AS text FROM gold", ("gold",))
def final_texts(t):
    """A video's final text: best, known or representative (K7)."""
    k = c("ord").cast("string")
    best, known = (F.when(c("ord") % 3 == n, F.concat(F.lit(w), k)).otherwise("") for n, w in ((0, "best "), (1, "known ")))
    return t.gold().select("ord", O.final_text(best, known, X.representative(c("first_name"), c("last_name"), DOB=c("dob"))).alias("text"))


@query("report_outputs", """SELECT ord, array_to_string(list_sort(list_concat(CASE WHEN first_name IS NOT NULL THEN ['first_name=' || first_name] ELSE ['first_name=meta'] END, CASE WHEN last_name IS NOT NULL THEN ['last_name=' || last_name] ELSE [] END, ['pages=3'])), ';') AS output FROM predicted""", ("predicted",))
def report_outputs(t):
    """Record, extracted fields and metrics in one map."""
    pair = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    out = O.assembled(pair("first_name", c("first_name"), "last_name", c("last_name")), pair("first_name", "meta", "last_name", " "), pair("pages", "3", "last_name", F.lit(None).cast("string")))
    return t.predicted().select("ord", F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("output"))


@query("first_valid_candidates", "SELECT video, arg_min(frame, n) AS frame FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS n FROM frames) WHERE n <= 2 AND conf > 3e-1 GROUP BY video", ("frames",))
def first_valid_candidates(t):
    """The first valid one of two candidates a video (K5)."""
    return O.first_valid(t.frames().select("video", "frame", "conf"), "video", "frame", c("conf") > 0.3).select("video", "frame")


@query("unified_records", """SELECT ord, CASE WHEN s THEN first_name ELSE 'frame' END AS first_name, CASE WHEN s THEN last_name END AS last_name, CASE WHEN s THEN NULL ELSE 'scope' END AS endoscope_type FROM
    (SELECT ord, first_name, last_name, coalesce(trim(first_name) <> '', false) OR coalesce(trim(last_name) <> '', false) AS s FROM (SELECT ord, CASE WHEN ord % 4 <> 0 THEN first_name END AS first_name, CASE WHEN ord % 4 = 1 THEN last_name END AS last_name FROM gold))""", ("gold",))
def unified_records(t):
    """Rule extraction where it found anything, else frame patterns (K3, K4)."""
    k = c("ord") % 4
    out = O.unified({"first_name": F.when(k != 0, c("first_name")), "last_name": F.when(k == 1, c("last_name"))}, {"first_name": F.lit("frame"), "endoscope_type": F.lit("scope")})
    return t.gold().select("ord", *[v.alias(n) for n, v in out.items()])


@query("regions_with_fallback", """WITH d AS (SELECT instance, idx FROM boxes_pred WHERE instance % 4 <> 0), r AS (SELECT instance, idx FROM boxes_gt), u AS (SELECT instance, idx FROM boxes_gt WHERE idx = 1) SELECT DISTINCT instance, idx FROM (SELECT * FROM u UNION ALL SELECT * FROM d UNION ALL SELECT * FROM r WHERE instance NOT IN (SELECT instance FROM d))""", ("boxes_pred",))
def regions_with_fallback(t):
    """Regions of both detectors, of the reader where they have none."""
    gt, pred = t.boxes_gt().select("instance", "idx"), t.boxes_pred().select("instance", "idx")
    return O.with_fallback(gt.where("idx = 1"), pred.where("instance % 4 <> 0"), gt, "instance")


@query("removal_plans", "SELECT video, count(*) AS total, count(*) FILTER (conf > 8e-1) AS removed, count(*) FILTER (conf > 8e-1) = 0 AS copy FROM frames GROUP BY video", ("frames",))
def removal_plans(t):
    """Frames to drop of each video."""
    return O.removal_plan(t.frames(), "video", "frame", c("conf") > 0.8)


@query("fill_boxes", "SELECT instance, idx, least(x1, 70) AS x1, least(y1, 60) AS y1, least(x2, 70) AS x2, least(y2, 60) AS y2 FROM boxes_gt", ("boxes_gt",))
def fill_boxes(t):
    """Boxes cut to the image for filling (SP21)."""
    return t.boxes_gt().select("instance", "idx", O.fill_plan(G.box(), F.lit(70), F.lit(60)).alias("b")).select("instance", "idx", "b.*")


@query("mask_configs", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END AS x, CASE WHEN c_custkey % 2 = 0 THEN 50 WHEN c_custkey % 3 = 0 THEN 640 ELSE 1920 END AS width, CASE WHEN c_custkey % 3 = 0 THEN 640 ELSE 1920 END AS image_width FROM customer")
def mask_configs(t):
    """Mask settings with default sizes."""
    roi = F.when(c("c_custkey") % 2 == 0, F.struct(F.lit(5).alias("x"), F.lit(6).alias("y"), F.lit(50).alias("width"), F.lit(60).alias("height")))
    some = F.when(c("c_custkey") % 3 == 0, 640)
    return t.customer.select("c_custkey", O.mask_config(roi, some, some).alias("m")).select("c_custkey", "m.x", "m.width", "m.image_width")


def _flat(prefix: str):
    v = {"x": c("l_linenumber") - 2, "y": c("l_partkey") % 50, "width": c("l_suppkey") % 40, "height": c("l_quantity").cast("int")}
    return F.create_map(*[y for k, x in v.items() for y in (F.lit(prefix + k), x.cast("string"))])


@query("region_checks", """SELECT l_orderkey, l_linenumber, x >= 0 AS parsed, x >= 0 AND w > 0 AND h > 0 AS valid, CASE WHEN x < 0 THEN NULL WHEN w <= 0 OR h <= 0 THEN 'no size' WHEN y >= 30 OR x >= 60 THEN 'outside the image' END AS reason,
    CASE WHEN x >= 0 AND w > 0 AND h > 0 AND y < 30 AND x < 60 THEN least(w, 60 - x) END AS width FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 2)::INT AS x, (l_partkey % 50)::INT AS y, (l_suppkey % 40)::INT AS w, l_quantity::INT AS h FROM lineitem)""")
def region_checks(t):
    """Regions of prefixed keys, their validity and the policy for bad ones."""
    r = F.try_element_at(R.choose_roi(F.create_map().cast("map<string,struct<x:int,y:int,width:int,height:int>>"), _flat("endoscope_image_")), F.lit("endoscope_image"))
    rows = spread(t.lineitem).select("l_orderkey", "l_linenumber", r.alias("r")).withColumn("p", R.roi_policy(c("r"), F.lit(60), F.lit(30)))
    return rows.select("l_orderkey", "l_linenumber", c("r").isNotNull().alias("parsed"), R.roi_valid(c("r")).alias("valid"), "p.reason", c("p.roi.width").alias("width"))


@query("parsed_boxes", "SELECT l_orderkey, l_linenumber, CASE WHEN w > 0 AND h > 0 THEN x END AS x1, CASE WHEN w > 0 AND h > 0 THEN x + w END AS x2, CASE WHEN w > 0 AND h > 0 THEN y + h END AS y2 FROM (SELECT l_orderkey, l_linenumber, (l_linenumber - 2)::INT AS x, (l_partkey % 50)::INT AS y, (l_suppkey % 40)::INT AS w, l_quantity::INT AS h FROM lineitem)")
def parsed_boxes(t):
    """Boxes from maps in either notation (SP3, K19)."""
    v = _flat("")
    g = lambda k: F.element_at(v, k).cast("int")
    corner = F.create_map(F.lit("x1"), g("x").cast("string"), F.lit("y1"), g("y").cast("string"), F.lit("x2"), (g("x") + g("width")).cast("string"), F.lit("y2"), (g("y") + g("height")).cast("string"))
    b = R.parse_box(F.when(c("l_linenumber") % 2 == 0, v).otherwise(corner))
    return t.lineitem.select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.x1", "b.x2", "b.y2")


@query("coerced_frames", "SELECT video, frame, CASE WHEN frame % 3 = 0 THEN 0 ELSE frame END::INT AS frame_index, conf AS ocr_confidence, CASE WHEN frame % 2 = 0 THEN text ELSE '' END AS ocr_text FROM frames", ("frames",))
def coerced_frames(t):
    """Frame samples from open maps, defaults where a value is missing or of another kind."""
    m = F.create_map(F.lit("frame_index"), F.when(c("frame") % 3 == 0, "n/a").otherwise(c("frame").cast("string")), F.lit("ocr_confidence"), c("conf").cast("string"), F.lit("ocr_text"), F.when(c("frame") % 2 == 0, c("text")))
    return t.frames().select("video", "frame", R.to_frame(m).alias("f")).select("video", "frame", "f.frame_index", "f.ocr_confidence", "f.ocr_text")


@query("flag_lists", "SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(' a, ,' || c_mktsegment || ',' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'b ' END, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS flags FROM customer")
def flag_lists(t):
    """Parts of comma lists."""
    raw = F.concat(F.lit(" a, ,"), c("c_mktsegment"), F.lit(","), F.when(c("c_custkey") % 2 == 0, "").otherwise("b "))
    return t.customer.select("c_custkey", F.array_join(R.flag_list(raw), "|").alias("flags"))


@query("merged_sources", "SELECT ord, coalesce(CASE WHEN lower(trim(first_name)) NOT IN ('', 'unknown') THEN first_name END, 'fallback') AS first_name, coalesce(last_name, 'Unbekannt') AS last_name, CASE WHEN ord % 2 = 0 THEN 2 ELSE 3 END::INT AS n FROM predicted", ("predicted",))
def merged_sources(t):
    """Sources by precedence, blanks give way; no nulls in the result."""
    s = F.lit
    m = R.merge_sources(F.create_map(s("first_name"), c("first_name"), s("last_name"), c("last_name")), F.create_map(s("first_name"), s("fallback"), s("last_name"), s("unknown")), F.create_map(s("last_name"), s("Unbekannt"), s("gender"), F.when(c("ord") % 2 == 0, " ").otherwise("male")))
    out = t.predicted().select("ord", R.without_nulls(m).alias("m"))
    return out.select("ord", F.element_at("m", "first_name").alias("first_name"), F.element_at("m", "last_name").alias("last_name"), F.size("m").alias("n"))


@query("stream_copies", "SELECT o_orderkey, codec IN ('h264', 'vp9') AND NOT regexp_matches(pix, '10le|12le|422') AND (audio IS NULL OR audio = 'aac') AS copy FROM (SELECT o_orderkey, ['h264', 'wmv3', 'vp9'][(o_orderkey % 3 + 1)::INT] AS codec, ['yuv420p', 'yuv420p10le', 'yuv422p', 'nv12'][(o_orderkey % 4 + 1)::INT] AS pix, [NULL, 'aac', 'pcm'][(o_orderkey % 3 + 1)::INT] AS audio FROM orders)")
def stream_copies(t):
    """Videos that need no encoding."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (c("o_orderkey") % n + 1).cast("int"))
    return t.orders.select("o_orderkey", FI.stream_copy(pick(("h264", "wmv3", "vp9"), 3), pick(("yuv420p", "yuv420p10le", "yuv422p", "nv12"), 4), pick((None, "aac", "pcm"), 3), F.lit("mp4")).alias("copy"))


@query("reading_modes", "SELECT instance, idx, CASE WHEN h < 50 OR w / (greatest(h, 1) * 1e0) > 8 THEN 'single_line' WHEN w / (h * 1e0) < 2 AND h < 100 THEN 'single_word' WHEN h < 200 THEN 'single_block' ELSE 'sparse_text' END AS mode, h < 60 OR w / (greatest(h, 1) * 1e0) > 7 AS numeric_only FROM (SELECT instance, idx, (x2 - x1) * 4 AS w, (y2 - y1) * 3 AS h FROM boxes_gt)", ("boxes_gt",))
def reading_modes(t):
    """How a reader takes each box."""
    w, h = (c("x2") - c("x1")) * 4, (c("y2") - c("y1")) * 3
    return t.boxes_gt().select("instance", "idx", FI.page_mode(w, h).alias("mode"), FI.numeric_only(w, h).alias("numeric_only"))


@query("black_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (1 << (bits - (o_orderkey % 2))::INT) - 1 WHEN o_orderkey % 2 = 1 THEN -(1 << (bits - 1)::INT) ELSE 0 END::BIGINT AS black FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 12 END AS bits FROM orders)", wide="black")
def black_values(t):
    """Pixel values of black."""
    k = c("o_orderkey")
    return t.orders.select("o_orderkey", FI.black_value(F.when(k % 3 == 0, "MONOCHROME1").otherwise("MONOCHROME2"), k % 2 == 1, F.when(k % 4 == 0, 8).otherwise(12)).alias("black"))


@query("percentile_windows", "WITH p AS (SELECT c_nationkey, quantile_cont(c_acctbal, 5e-3) AS lo, quantile_cont(c_acctbal, 995e-3) AS hi FROM customer GROUP BY c_nationkey) SELECT c_custkey, CASE WHEN hi > lo THEN floor(greatest(0, least(255, (c_acctbal - lo) * (255e0 / (hi - lo)))))::INT ELSE 0 END AS scaled FROM customer JOIN p USING (c_nationkey)")
def percentile_windows(t):
    """Values between percentiles as 0 to 255."""
    return FI.percentile_window(t.customer.select("c_custkey", "c_nationkey", c("c_acctbal").cast("double").alias("v")), "c_nationkey", "v").select("c_custkey", "scaled")


@query("image_tiles", """SELECT c_custkey, i * 700 AS "left", j * 700 AS upper, least(i * 700 + 800, w) AS "right", least(j * 700 + 800, h) AS lower FROM (SELECT c_custkey, (c_custkey % 3000 + 300)::INT AS w, 900 AS h FROM customer), LATERAL (SELECT unnest(generate_series(0, greatest(1, (w - 100) // 700) - 1))::INT AS i), LATERAL (SELECT unnest(generate_series(0, greatest(1, (h - 100) // 700) - 1))::INT AS j)""")
def image_tiles(t):
    """Overlapping grids over images."""
    return t.customer.select("c_custkey", F.inline(FI.tiles((c("c_custkey") % 3000 + 300).cast("int"), F.lit(900))))


@query("polygon_bounds", "SELECT instance, min(x1) + 3 AS x1, min(y1) - 1 AS y1, max(x2) + 3 AS x2, max(y2) - 1 AS y2 FROM boxes_gt GROUP BY instance", ("boxes_gt",))
def polygon_bounds(t):
    """Bounds of polygons, moved (SP18)."""
    corner = lambda a, b: F.struct(c(a).alias("x"), c(b).alias("y"))
    points = t.boxes_gt().groupBy("instance").agg(F.flatten(F.collect_list(F.array(corner("x1", "y1"), corner("x2", "y2")))).alias("p"))
    return points.select("instance", G.polygon_box(c("p"), F.lit(3), F.lit(-1)).struct().alias("b")).select("instance", "b.*")


@query("widened_boxes", "SELECT ord, 10 AS x1, CASE WHEN n > o THEN least(110 + (n - o) * 20 + 15, 220) ELSE 110 END::INT AS x2 FROM (SELECT ord, length(first_name) AS o, length(coalesce(last_name, '')) AS n FROM gold)", ("gold",))
def widened_boxes(t):
    """Boxes from x, y, w, h made wider for longer names (SP20, SP23)."""
    b = G.from_xywh(F.lit(10), F.lit(20), F.lit(100), F.lit(30))
    return t.gold().select("ord", G.widened(b, c("first_name"), F.coalesce("last_name", F.lit("")), F.lit(220)).struct().alias("b")).select("ord", "b.x1", "b.x2")


@query("reader_confidence", "SELECT event_id, CASE WHEN k IS NULL THEN 0e0 WHEN k > 1 THEN least(k / 1e2, 1e0) ELSE greatest(k, 0)::DOUBLE END AS confidence FROM (SELECT event_id, ((props->>'$.k')::INT - 5)::DOUBLE * 3 AS k FROM events)")
def reader_confidence(t):
    """Confidences as 0 to 1."""
    return t.events.select("event_id", X.confidence((F.get_json_object("props", "$.k").cast("int") - 5) * 3).alias("confidence"))


@query("export_totals", "SELECT count(*) AS files_written, count(*) FILTER (n > 0) AS masked_files, sum(n)::BIGINT AS masked_regions FROM (SELECT o_orderkey, o_orderkey % 4 AS n FROM orders)")
def export_totals(t):
    """Files, masked files and regions of an export (A26, A27, SC17)."""
    return SK.export_summary(t.orders.select((c("o_orderkey") % 4).alias("n")), "n")


@query("genders_by_name", "SELECT ord, CASE WHEN first_name IN ('Alice', 'Carla', 'Erika', 'Hanna') THEN 'female' WHEN first_name IN ('Bernd', 'Detlef') THEN 'male' ELSE 'unknown' END AS gender FROM gold", ("gold",))
def genders_by_name(t):
    """Gender by the lexicons of first names."""
    names = lambda *xs: t.spark.createDataFrame([(x,) for x in xs], "first string")
    return FI.gender_by_name(t.gold(), "first_name", names("alice", "Carla", "ERIKA", "Hanna", "Gerhard"), names("Bernd", "Detlef", "Gerhard")).select("ord", "gender")


@query("files_of_patients", "SELECT patient, count(*) AS files, min(path) AS first, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT 'p' || c_nationkey AS patient, '/data/p' || c_nationkey || '/' || c_custkey || ext AS path, CASE WHEN ext = '.PDF' THEN 'pdf' ELSE 'png' END AS kind FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN '.PDF' ELSE '.png' END AS ext FROM customer)) GROUP BY patient", wide="files")
def files_of_patients(t):
    """Files by patient folder, and their kinds (SC8, SC11)."""
    path = F.concat(F.lit("/data/p"), c("c_nationkey").cast("string"), F.lit("/"), c("c_custkey").cast("string"), F.when(c("c_custkey") % 3 == 0, ".PDF").otherwise(".png"))
    out = FI.by_patient(t.customer.select(path.alias("path")), "/data")
    return out.select("patient", F.size("paths").alias("files"), c("paths")[0].alias("first"), F.array_join(F.array_sort(F.array_distinct(F.transform("paths", FI.file_type))), ",").alias("kinds"))


@query("model_choice", "SELECT 'b' AS name")
def model_choice(t):
    """The available model of the least priority value."""
    wanted = t.spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "name string, priority int")
    return FI.pick_model(wanted, t.spark.createDataFrame([("d",), ("b",), ("c",)], "name string"))


@query("report_sources", "SELECT ord, CASE WHEN ord % 3 = 0 THEN first_name WHEN ord % 5 = 0 THEN 'pdf' ELSE 'image' END AS text FROM gold", ("gold",))
def report_sources(t):
    """The first source of a report's text that has any (SC10)."""
    k = c("ord")
    return t.gold().select("ord", FI.report_text(F.when(k % 3 == 0, c("first_name")), F.when(k % 5 == 0, "pdf").otherwise(" "), F.lit("image")).alias("text"))


@query("titled_examiners", rf"SELECT doc_id, nullif(regexp_extract(text, {lit(r'(Dr\.(?:med\.)?[\t-\r\x1c-\x20][A-Z][a-z]+(?:[\t-\r\x1c-\x20][A-Z][a-z]+){0,4})')}, 1), '') AS examiner FROM (SELECT doc_id, 'Untersucher: ' || CASE WHEN doc_id % 3 = 0 THEN 'Dr. Anna Maria Vogel, Arzt ' WHEN doc_id % 3 = 1 THEN 'Dr.med. Vogel ' ELSE 'Frau Vogel ' END || text AS text FROM documents)")
def titled_examiners(t):
    """Examiners by their title."""
    head = F.when(c("doc_id") % 3 == 0, "Dr. Anna Maria Vogel, Arzt ").when(c("doc_id") % 3 == 1, "Dr.med. Vogel ").otherwise("Frau Vogel ")
    return t.documents.select("doc_id", E.titled_examiner(F.concat(F.lit("Untersucher: "), head, c("text"))).alias("examiner"))


@query("examiner_fields", "SELECT ord, 'Schulze' AS first, 'Meier' AS last FROM overlays WHERE ord % 4 = 2", ("overlays",))
def examiner_fields(t):
    """Examiners by rule where an overlay names one (E5)."""
    first, last = E.examiner(c("text"))
    return t.overlays().select("ord", first.alias("first"), last.alias("last")).where("first is not null")


@query("birth_date_fields", "SELECT ord, CASE WHEN dob <> 'n/a' THEN make_date(right(dob, 4)::INT, substr(dob, 4, 2)::INT, left(dob, 2)::INT) END AS dob FROM gold WHERE ord % 4 = 1", ("gold",), text="dob")
def birth_date_fields(t):
    """Labelled birth dates."""
    return t.overlays().where("ord % 4 = 1").select("ord", E.birth_date(F.regexp_replace("text", "Untersuchung.*", "")).alias("dob"))


@query("key_value_answers", "SELECT ord, first_name, CASE WHEN last_name IS NOT NULL THEN last_name END AS last_name, CASE WHEN dob <> 'n/a' THEN right(dob, 4) || '-' || substr(dob, 4, 2) || '-' || left(dob, 2) END AS dob FROM gold WHERE dob <> 'n/a'", ("gold",))
def key_value_answers(t):
    """Fields of answers that are no JSON."""
    s = F.lit
    text = F.concat(s("Here it is:\n- Vorname: "), c("first_name"), s("\n last_name = '"), F.coalesce("last_name", s("unknown")), s("'\nGeburtsdatum: "), c("dob"))
    m = E.key_values(text)
    return t.gold().where("dob <> 'n/a'").select("ord", *[F.try_element_at(m, F.lit(k)).alias(k) for k in ("first_name", "last_name", "dob")])


@query("json_round_trip", "SELECT ord, first_name, last_name, dob FROM predicted", ("predicted",))
def json_round_trip(t):
    """Records as JSON lines, nulls left out, and read back (SC1, SC21, SC22, SC23, R4)."""
    path = folder(t.spark)
    SK.write_json(t.predicted().select("ord", "first_name", "last_name", "dob"), path)
    return R.read_json_lines(t.spark, path, "ord long, first_name string, last_name string, dob string").select("ord", "first_name", "last_name", "dob")


@query("mapping_round_trip", "SELECT DISTINCT trim(c_name) AS id_old, 'N' || c_custkey AS id_new FROM customer")
def mapping_round_trip(t):
    """A mapping file, written and checked as it is read (SC14, SC15)."""
    path = folder(t.spark)
    SK.write_mapping(t.customer.select(F.trim("c_name").alias("id_old"), F.concat(F.lit("N"), c("c_custkey").cast("string")).alias("id_new")), path)
    return R.read_mapping(t.spark, path)


@query("elements_round_trip", "SELECT instance, keyword, value FROM elements WHERE patient = 'Customer#000000001'", ("elements",))
def elements_round_trip(t):
    """Elements by patient, of which one is read back from its folder (SC16)."""
    path = f"{folder(t.spark)}/out"
    SK.write_elements(t.elements().select("patient", (c("instance") % 2).alias("study"), (c("instance") % 3).alias("series"), "instance", "keyword", "value"), path)
    return SK.read_elements(t.spark, path, "Customer#000000001").select("instance", "keyword", "value")


@query("index_scan", "SELECT '1.2.' || o_orderkey || '.1' AS instance_uid, 'f' || o_orderkey AS path FROM orders WHERE o_orderkey % 7 = 0")
def index_scan(t):
    """Paths of wanted instances, other elements unread (SC7)."""
    wanted = t.orders.where("o_orderkey % 7 = 0").select(F.concat(F.lit("1.2."), c("o_orderkey").cast("string"), F.lit(".1")).alias("instance_uid"))
    return FI.index_of(t.elements().withColumn("path", F.concat(F.lit("f"), c("instance").cast("string"))), wanted)


@query("label_files", "SELECT split, stem, CASE WHEN n = 0 THEN '' ELSE 'a' || chr(10) END AS value FROM (SELECT 's' || c_custkey % 2 AS split, c_custkey::VARCHAR AS stem, c_custkey % 3 AS n FROM customer)")
def label_files(t):
    """Label texts by split, empty ones for negatives (SC20)."""
    path = folder(t.spark)
    lines = F.when(c("c_custkey") % 3 != 0, F.array(F.lit("a")))
    SK.write_labels(t.customer.select(F.concat(F.lit("s"), (c("c_custkey") % 2).cast("string")).alias("split"), c("c_custkey").cast("string").alias("stem"), lines.alias("lines")), path)
    return t.spark.read.schema("stem string, value string, split string").json(path).select("split", "stem", "value")


@query("entity_files", "SELECT ord, entity FROM (SELECT ord::VARCHAR AS ord, unnest([first_name, coalesce(last_name, '-')]) AS entity FROM gold)", ("gold",))
def entity_files(t):
    """One row an entity (SC18)."""
    path = folder(t.spark)
    boxes = [F.lit(k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    SK.write_entities(t.gold().select(c("ord").cast("string").alias("phrase"), *boxes, F.lit(0.5).alias("confidence"), F.array("first_name", F.coalesce("last_name", F.lit("-"))).alias("entities")), path)
    return t.spark.read.option("header", True).csv(path).select(c("phrase").alias("ord"), "entity")


@query("name_lexicon", f"SELECT name, split_part(name, ' ', 1) AS first, CASE WHEN instr(name, ' ') > 0 THEN substr(name, instr(name, ' ') + 1) ELSE '' END AS rest FROM (VALUES {', '.join(f"({lit(n)})" for n in [*FIRST, 'Eva Maria Luise'])}) x(name)")
def name_lexicon(t):
    """Names of a file, first word and rest, ASCII ones only (SC24)."""
    path = folder(t.spark)
    t.spark.createDataFrame([(x,) for x in [*FIRST, " Eva Maria Luise ", "Jürgen", "", "  "]], "value string").write.text(path)
    return FI.lexicon(t.spark, path, True)


@query("file_hashes", f"SELECT sha256({lit(LAST[0] + chr(10))}) AS sha256, {len(LAST[0]) + 1} AS length", wide="length")
def file_hashes(t):
    """Hashes of whole files, and their lengths without reading them (SC6, SC26)."""
    path = folder(t.spark)
    t.spark.createDataFrame([(LAST[0],)], "value string").coalesce(1).write.text(path)
    hashes = FI.contents(t.spark, path, "*.txt").select("path", "sha256")
    return hashes.join(FI.scan_tree(t.spark, path, "*.txt"), "path").select("sha256", "length")
