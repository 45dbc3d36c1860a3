"""Operators on literal tables."""

import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import geometry as G
from veilframe.functions import privacy as P
from veilframe.operators import audit, evaluation, frames, redact, spatial, splits

SECRET = b"0123456789abcdef0123456789abcdef!"


def test_hmac_and_pseudonyms(spark):
    df = spark.createDataFrame([(v,) for v in ("ORIGINAL-123", "ü x", "", None)], "v string")
    got = df.select(P.keyed(SECRET, "patient", F.col("v")), P.patient_pseudonym(SECRET, F.col("v")), P.uid_pseudonym(SECRET, F.col("v")), P.shift_days(SECRET, F.col("v"))).collect()
    for v, r in zip(("ORIGINAL-123", "ü x"), got):
        d = lambda space, v=v: hmac.new(SECRET, f"{space}:{v}".encode(), hashlib.sha256).digest()
        assert r[0] == d("patient").hex() and r[1] == "PAT_" + d("patient").hex()[:32]
        assert r[2] == f"2.25.{int.from_bytes(d('uid')[:16], 'big')}"
        n = int.from_bytes(d("date-shift")[:4], "big")
        assert r[3] == (-1 if n & 1 else 1) * (n % 3650 + 1)
    assert got[2][1] is None and got[3][1] is None
    with pytest.raises(ValueError):
        P.keyed(b"short", "a", F.col("v"))


def test_decimal_of_hex(spark):
    values = ["0" * 32, "f" * 32, "0" * 31 + "1", "8" + "0" * 31, "00000000000000010000000000000000"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(P.hex_to_decimal(F.col("v"))).collect()] == [str(int(v, 16)) for v in values]


def test_date_shift_text(spark):
    df = spark.createDataFrame([(dt.date(1994, 3, 21), "s")], "d date, s string")
    want = dt.date(1994, 3, 21) + dt.timedelta(-1200 + int(hashlib.sha256(b"s1994-03-21").hexdigest(), 16) % 836)
    assert df.select(P.shift_date(F.col("d"), -1200, -365, F.col("s"))).first()[0] == want
    rows = spark.createDataFrame([("20260715", 3), ("", 3), ("x", 3), ("20261332", 1), ("20260715112233.1234", 1)], "v string, n int")
    got = rows.select(P.shift_compact_date(F.col("v"), F.col("n")), P.shift_compact_datetime(F.col("v"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("20260718", "20260718"), ("", ""), ("", ""), ("", ""), ("20260716", "20260716112233.1234")]


def test_elements(spark):
    rows = [
        (1, "PatientID", "LO", "ORIGINAL-123", False), (1, "PatientName", "PN", "A^B", False), (1, "OperatorsName", "PN", "C", False), (1, "SOPInstanceUID", "UI", "1.2.3", False), (1, "SOPClassUID", "UI", "1.2.840", False),
        (1, "StudyDate", "DA", "20260715", False), (1, "ImageComments", "LT", "about ORIGINAL-123", False), (1, "Manufacturer", "LO", "ACME", False), (1, "X", "LO", "secret", True), (1, "PatientID", "LO", "ORIGINAL-123", False),
    ]
    df = spark.createDataFrame(rows, "instance int, keyword string, vr string, value string, is_private boolean").withColumn("patient", F.lit("ORIGINAL-123"))
    out = redact.deidentify(df, SECRET)
    got = {r["keyword"]: r["value"] for r in out.collect()}
    assert got["PatientName"] == "ANON^PATIENT" and got["OperatorsName"] == "" and got["SOPClassUID"] == "1.2.840" and got["ImageComments"] == "" and got["Manufacturer"] == "ACME"
    assert got["PatientID"].startswith("PAT_") and got["SOPInstanceUID"].startswith("2.25.") and "X" not in got and len(got["StudyDate"]) == 8
    assert redact.residual(df, out).count() == 0 and redact.residual(df, df).count() == 3


def test_mapping_problems(spark):
    table = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("c", "3"), ("", "4"), ("d", "5")], "id_old string, id_new string")
    assert {(r["id_old"], r["problem"]) for r in redact.collisions(table).collect()} == {("", "blank"), ("a", "conflict"), ("b", "collision"), ("c", "collision")}


def test_record_evaluation(spark):
    gold = spark.createDataFrame([(0, "f1", "1", "Alice", "Doe"), (1, "f1", "2", "Bob", "Smith"), (2, "f2", "1", "Carla", None)], "ord int, file string, report_id string, first_name string, last_name string")
    pred = spark.createDataFrame([(0, "f1", "1", "Dr. Alice", "Doe"), (1, "f1", "2", None, "Smyth"), (2, "f3", "1", "Extra", "Person")], gold.schema)
    u = evaluation.unmatched(pred, gold, ["file", "report_id"], "ord").first()
    assert (u.matched, u.missing, u.extra, u.total_gold) == (2, 1, 1, 3)
    m = {r.field: r for r in evaluation.field_metrics(pred, gold, ["first_name", "last_name"], ["file", "report_id"], "ord").collect()}
    f, n = m["first_name"], m["last_name"]
    assert (f.support, f.exact_match_rate, f.presence_precision, f.presence_recall) == (2, 0.5, 1.0, 0.5)
    assert n.exact_match_rate == 0.5 and n.presence_f1 == 1.0 and n.mean_similarity > 0.5
    assert evaluation.macro(evaluation.field_metrics(pred, gold, ["first_name", "last_name"], ["file", "report_id"], "ord")).first()[0] == 0.5
    assert [r[0] for r in evaluation.cohort(gold, {"a": gold, "b": gold.where("ord = 0")}, ["file", "report_id"], "ord").collect()] == ["f1\x1f1"]
    twice = gold.unionByName(gold.withColumn("ord", F.col("ord") + 10).withColumn("first_name", F.lit("Z")))
    u = evaluation.unmatched(pred, twice, ["file", "report_id"], "ord").first()
    assert (u.total_gold, u.duplicate_gold, u.matched) == (6, 3, 2)
    assert {r.r.first_name for r in evaluation.keyed(twice, ["file", "report_id"], "ord").collect()} == {"Z"}


def test_confusion(spark):
    rows = spark.createDataFrame([(True, True), (False, False), (True, False), (None, True)], "x boolean, y boolean")
    c = evaluation.confusion(rows, F.col("x"), F.col("y")).first()
    assert (c.evaluated_pairs, c.tp, c.tn, c.fp, c.fn, c.precision, c.recall) == (3, 1, 1, 1, 0, 0.5, 1.0)
    assert c.accuracy == pytest.approx(2 / 3) and c.f1 == pytest.approx(2 / 3)


def test_privacy_audit(spark):
    rows = spark.createDataFrame([("A", "50-59", "f", "adenoma")] * 2 + [("B", "70-79", "m", "cancer")], "center string, age string, sex string, d string")
    k = audit.k_anonymity(rows, ["center", "age", "sex"], "d", 3, 2).first()
    assert (k.qi_projection_count, k.equivalence_class_count, k.minimum_equivalence_class_size, k.underprotected_pattern_count, k.frequency_deficit_total, k.synthetic_padding_lower_bound, k.l_diversity_violation_count) == (7, 14, 1, 14, 21, 2, 14)
    t = audit.t_closeness(rows, ["center", "age", "sex"], "d", 0.2).first()
    assert t.t_closeness_violation_count == 14 and t.max_t_closeness_distance == pytest.approx(2 / 3)
    nulls = spark.createDataFrame([(None, "x"), ("", "x"), (" ", "y"), (None, None)], "q string, s string")
    assert audit.k_anonymity(nulls, ["q"], "s", 2).first().equivalence_class_count == 2
    with pytest.raises(ValueError):
        audit.classes(rows, [], "d")


BOX = "g int, idx int, x1 int, y1 int, x2 int, y2 int"


def test_pixel_matching(spark):
    gt = spark.createDataFrame([(1, 0, 10, 10, 30, 30), (1, 1, 40, 40, 60, 60)], BOX)
    pr = spark.createDataFrame([(1, 0, 10, 10, 30, 30), (1, 1, 70, 70, 90, 90)], BOX)
    m = spatial.detector_metrics(gt, pr, "g", spark.createDataFrame([(1, "DX")], "g int, kind string"), "kind").where("kind is null").first()
    assert (m.true_positives, m.precision, m.recall, m.f1, m.mean_best_iou, m.mean_coverage) == (1, 0.5, 0.5, 0.5, 0.5, 0.5)
    none = spatial.detector_metrics(gt, pr.where("false"), "g", spark.createDataFrame([], "g int, kind string"), "kind").where("kind is null").first()
    assert (none.annotations, none.predictions, none.precision, none.mean_coverage) == (2, 0, 0.0, 0.0)


def test_union_area_equals_pixels(spark):
    r = random.Random(6)
    rows = [(g, i, x, y, x + r.randint(1, 12), y + r.randint(1, 12)) for g in range(8) for i in range(r.randint(1, 9)) for x, y in [(r.randint(0, 20), r.randint(0, 20))]]
    df = spark.createDataFrame([*rows, (99, 0, 5, 5, 5, 9)], BOX)
    want = {g: len({(x, y) for h, _, a, b, c, d in rows if h == g for x in range(a, c) for y in range(b, d)}) for g in range(8)}
    got = {r.g: r.area for r in spatial.union_area(df, "g").collect()}
    assert got == want | {99: 0}
    assert {r.g: r.area for r in spatial.union_area_rows(df.where("x2 > x1"), "g").collect()} == want
    two = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10)], BOX)
    assert spatial.union_area(two, "g").first().area == 200


def test_greedy_and_ordered_matches_equal_brute_force(spark):
    r = random.Random(9)
    box = lambda: (lambda x, y: (x, y, x + r.randint(4, 9), y + r.randint(4, 9)))(r.randint(0, 8), r.randint(0, 8))
    gt = [(g, i, *box()) for g in range(20) for i in range(4)]
    pr = [(g, i, *box()) for g in range(20) for i in range(5)]

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    want, tp, leak = set(), 0, 0
    for g in range(20):
        a, b = [x for x in gt if x[0] == g], [x for x in pr if x[0] == g]
        used_a, used_b = set(), set()
        for s, i, j in sorted(((iou(x[2:], y[2:]), x[1], y[1]) for x in a for y in b), reverse=True):
            if s >= 0.3 and i not in used_a and j not in used_b:
                want.add((g, i, j))
                used_a.add(i)
                used_b.add(j)
        cover = lambda x, y: iou(x[2:], y[2:]) >= 0.3 or max(0, min(x[4], y[4]) - max(x[2], y[2])) * max(0, min(x[5], y[5]) - max(x[3], y[3])) / ((x[4] - x[2]) * (x[5] - x[3])) >= 0.5
        free = list(b)
        for x in a:
            hit = next((y for y in free if cover(x, y)), None)
            if hit:
                tp += 1
                free.remove(hit)
        leak += any(not any(cover(x, y) for y in b) for x in a)
    g, p = spark.createDataFrame(gt, BOX), spark.createDataFrame(pr, BOX)
    rows = spatial.side_by_side(g, p, "g").select("g", F.inline(spatial.greedy_matches(F.col("gt"), F.col("pr"), 0.3)).alias("iou", "a", "b"))
    assert {(x.g, x.a, x.b) for x in rows.collect()} == want
    out = spatial.leakage(g, p, "g").first()
    assert out.entity_recall == pytest.approx(tp / 80, abs=1e-6) and out.leaked == leak


def test_over_redaction(spark):
    gt = spark.createDataFrame([(1, 0, 10, 20, 40, 60)], BOX)
    pr = spark.createDataFrame([(1, 0, 0, 0, 100, 100)], BOX)
    o = spatial.over_redaction(gt, pr, "g", 100, 100).first()
    assert (o.false_positive_fraction, o.removed_fraction) == (pytest.approx(0.88), 1.0) and o.over_redaction_score == pytest.approx(0.06)
    none = spatial.over_redaction(gt, pr.where("false"), "g", 100, 100).first()
    assert (none.false_positive_fraction, none.removed_fraction, none.over_redaction_score) == (0.0, 0.0, 1.0)


def test_folds(spark):
    words = [(1, 0, "a", 0, 0, 10, 10), (1, 1, "b", 15, 3, 25, 12), (1, 2, "c", 60, 0, 70, 10), (1, 3, "d", 0, 40, 9, 50)]
    df = spark.createDataFrame(words, "g int, idx int, text string, x1 int, y1 int, x2 int, y2 int").groupBy("g").agg(F.collect_list(F.struct("idx", "text", "x1", "y1", "x2", "y2")).alias("w"))
    got = df.select(F.inline(spatial.combine_line(F.col("w")))).collect()
    assert {(r.text, r.x1, r.y1, r.x2, r.y2) for r in got} == {("a", 0, 0, 10, 10), ("c b", 15, 0, 70, 12), ("d", 0, 40, 9, 50)}
    boxes = [(0, 0, 10, 10, 0.5), (15, 2, 20, 14, 0.9), (100, 2, 110, 9, 0.1)]
    b = spark.createDataFrame([([dict(zip(("x1", "y1", "x2", "y2", "conf"), x)) for x in boxes],)], "b array<struct<x1:int,y1:int,x2:int,y2:int,conf:double>>")
    east = b.select(F.inline(spatial.merge_scan(F.col("b"), "east"))).collect()
    assert [tuple(r) for r in east] == [(0, 0, 20, 14, 0.9), (100, 2, 110, 9, 0.1)]
    word = b.select(F.inline(spatial.merge_scan(F.col("b"), "word"))).collect()
    assert [tuple(r)[:4] for r in word] == [(0, 0, 20, 14), (100, 2, 110, 9)]
    assert spatial.split_regions([(0, 0, 10, 10), (12, 0, 20, 10), (100, 0, 110, 10), (100, 80, 110, 90)], gap=25) == [(0, 0, 20, 10), (100, 0, 110, 10), (100, 80, 110, 90)]
    w = spark.createDataFrame([([dict(pos=i + 1, text=t) for i, t in enumerate("Pat Jane Doe x Jane".split())],)], "w array<struct<pos:int,text:string>>")
    assert [r["pos"] for r in w.select(F.inline(spatial.span_boxes(F.col("w"), F.lit("jane doe")))).collect()] == [2, 3]


def test_frame_ranges_and_filters(spark):
    df = spark.createDataFrame([(1, f) for f in (3, 1, 2, 8, 8, 10)] + [(2, f) for f in (10, 11, 12)], "v int, f int")
    assert {tuple(r) for r in frames.frame_ranges(df, "v", "f").collect()} == {(1, 1, 3), (1, 8, 8), (1, 10, 10), (2, 10, 12)}
    out = frames.drop_filters(df.where("v = 2"), "v", "f", 25.0).first()
    assert "between(t\\,0.4\\,0.52)" in out.audio_filter and out.video_filter.startswith("select='not(eq(n\\,10)+eq(n\\,11)")
    many = spark.range(70).select(F.lit(1).alias("v"), F.col("id").alias("f"))
    assert "between(n\\,0\\,69)" in frames.drop_filters(many, "v", "f", 30.0).first().video_filter
    with pytest.raises(ValueError):
        frames.drop_filters(df, "v", "f", 0)
    with pytest.raises(Exception, match="negative"):
        frames.frame_ranges(spark.createDataFrame([(1, -1)], "v int, f int"), "v", "f").collect()


STATE = "v int, f int, first_name string, last_name string, dob string, casenumber string, examination_date string"


def test_fill_only_and_early_stop(spark):
    rows = [(1, 0, "Ann", None, None, None, None), (1, 1, "Bob", "Doe", "unknown", "", None), (1, 2, None, None, "2020-01-01", None, "1990-01-01"), (1, 3, None, "Zed", None, "5", None)]
    acc = frames.accumulate(spark.createDataFrame(rows, STATE), "v", "f")
    got = {r.f: r for r in acc.collect()}
    assert (got[3].first_name, got[3].last_name, got[3].dob, got[3].examination_date) == ("Ann", "Doe", "1990-01-01", "2020-01-01")
    assert [got[k].complete for k in range(4)] == [False, False, True, True]
    assert sorted(r.f for r in frames.early_stop(acc, "v", "f").collect()) == [0, 1, 2]


def test_sampling(spark):
    df = spark.createDataFrame([(1, i, i // 4) for i in range(120)], "v int, f int, h int")
    got, seen = [], set()
    for i in range(120):
        if i < 5 or i >= 115 or (i % 5 == 0 and i // 4 not in seen):
            got.append(i)
            seen.add(i // 4)
    assert sorted(r.f for r in frames.adaptive_sample(df, "v", "f", "h").collect()) == got
    assert sorted(r.f for r in frames.stride_sample(df, "v", "f", 12).collect()) == list(range(0, 120, 10))
    assert frames.reservoir(df, "f", 7).count() == 7


def test_golden_set_audit(spark):
    items = spark.createDataFrame([("text_report", "p", "g1")] + [("video_frame", "p", "g2")] * 4, "input_type string, subject_id string, source_group_id string")
    a = evaluation.golden_set_audit(items).first()
    assert (a.sample_count, a.subject_count, a.source_group_count, a.benchmark_ready) == (5, 1, 2, False)
    assert "only 1 independent subjects" in a.issues and "video_frame has 4 samples" in a.issues


def test_splits(spark):
    df = spark.createDataFrame([(f"g{i % 40}", i) for i in range(400)], "g string, i int")
    rows = df.withColumn("split", P.group_split(F.col("g"), 3, 0.25))
    assert splits.shared_groups(rows, "g", "split").count() == 0
    want = {g: "val" if int.from_bytes(hashlib.sha256(f"3:{g}".encode()).digest()[:8], "big") / 2**64 < 0.25 else "train" for g in {f"g{i}" for i in range(40)}}
    assert {r.g: r.split for r in rows.select("g", "split").distinct().collect()} == want
    names = {r.g: r.split for r in splits.positional_split(df, "g", 0.8, 0.1).collect()}
    assert sorted(names.values()).count("train") == 32 and sorted(names.values()).count("val") == 4


def test_geometry(spark):
    df = spark.createDataFrame([(1, 0, 20, 40, 60, 60)], BOX)
    line = df.select(G.yolo_line(G.box(), F.lit(100), F.lit(100))).first()[0]
    assert line == "0 0.40000000 0.50000000 0.40000000 0.20000000"
    assert spark.range(1).select(G.yolo_valid(F.lit(0.95), F.lit(0.5), F.lit(0.2), F.lit(0.1)), G.yolo_valid(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.1))).first() == (False, True)
    pages = spark.range(1).select(*[G.iou(*[G.Box(*[F.lit(v) for v in (0, 0, 2, 2)])] * 2, a, b) for a, b in ((F.lit(1), F.lit(2)), (F.lit(1), F.lit(None).cast("int")), (F.lit(1), F.lit(1)))]).first()
    assert tuple(pages) == (0.0, 1.0, 1.0)


def test_report_text(spark):
    df = spark.createDataFrame([(1, "Letter\nPatient: SCHULTZE, Anna-Lena 15.02.2024 Nr 1234567 a12345 \nanna  lena sah Dr. Weich am 2024-02-15\nfoot")], "i int, text string")
    out = df.select(redact.anonymise_report(df, "text", SECRET, F.lit("seed"), F.lit("Anna Lena"), F.lit("Schultze"), F.lit(None).cast("date"), F.lit("2024-02-15").cast("date"), ["Patient"], ["Weich"], ["Weich"])).first()[0]
    assert not any(x in out for x in ("SCHULTZE", "Anna", "anna", "1234567", "15.02.2024", "2024-02-15", "Weich", "Letter", "foot")) and "a12345" in out
    name = out.split("Patient: ")[1].split(",")[0]
    assert name.isupper()


def test_missing_parts_are_errors(spark):
    from veilframe.operators import records as O

    left = spark.createDataFrame([(1,), (2,)], "key long")
    right = spark.createDataFrame([(1, "a")], "key long, v string")
    assert O.required_join(left.where("key = 1"), right, "key", "imprint").collect()[0].v == "a"
    with pytest.raises(Exception, match="no imprint for 2"):
        O.required_join(left, right, "key", "imprint").collect()
    m = spark.createDataFrame([({"a": "1"},)], "m map<string,string>")
    with pytest.raises(Exception, match="b is missing"):
        m.select(*O.required(F.col("m"), ["a", "b"])).collect()


def test_sensitive_spans_are_marked(spark):
    from veilframe.functions import sensitive as N

    text = "Müller, Hans geb. 01.02.1970 Fallnr: 4711 Hauptstraße 12, Dr. med. Eva Vogel Tel 0511 1234567"
    row = spark.createDataFrame([(text,)], "t string").select(N.mark(F.col("t")).alias("m"), N.spans(F.col("t")).alias("s")).first()
    for part in ("Müller", "Hans", "1970", "4711", "straße", "Vogel", "1234567"):
        assert part not in row.m
    assert {x.kind for x in row.s} == set(N.PATTERNS) - {"social_security"}


def test_ensemble_choice_keeps_short_texts(spark, tmp_path):
    from veilframe.plans import catalog

    spark.createDataFrame([(1, 0, "user", "Kurz.")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.QUERIES["ensemble_choice"](spark, str(tmp_path)).collect()] == [(1, 0, "tesseract", "Kurz.")]
    rows = spark.createDataFrame([(1, "trocr", 0.9, "ab"), (1, "donut", 0.1, "abc\nd"), (2, "tesseract", 90.0, None), (2, "donut", 0.9, "x")], "k int, engine string, score double, text string")
    assert sorted(tuple(r) for r in frames.best_engine(rows, "k", "engine", "text", "score", short=0).collect()) == [(1, "trocr", "ab"), (2, "tesseract", None)]
    assert frames.best_engine(rows.where("k = 1"), "k", "engine", "text", "score").first().text == "abc\nd"


def test_boxes_in_batches_equal_pixels_and_folds(spark):
    from veilframe.functions import arrays as A

    rng = random.Random(5)
    box = lambda g, i: (g, i, x := rng.randrange(12), y := rng.randrange(12), x + rng.randrange(-1, 9), y + rng.randrange(-1, 9))
    gt, pr = ([box(g, i) for g in range(60) for i in range(rng.choice((0, 1, 2, 5, 9)))] for _ in range(2))
    g, p = (spark.createDataFrame(x, "g int, idx int, x1 int, y1 int, x2 int, y2 int") for x in (gt, pr))
    pixels = lambda rows, k, w=99: {(x, y) for r in rows if r[0] == k for x in range(r[2], min(w, r[4])) for y in range(r[3], min(w, r[5]))}
    assert {r.g: r.area for r in spatial.union_area(p, "g").collect()} == {k: len(pixels(pr, k)) for k in {r[0] for r in pr}}
    for r in spatial.over_redaction(g, p, "g", 10, 10).collect():
        a, b, ca, cb = pixels(gt, r.g), pixels(pr, r.g), pixels(gt, r.g, 10), pixels(pr, r.g, 10)
        false, gone = (len(b - a) / len(b) if b else 0.0), (min(1.0, len(cb - ca) / (100 - len(ca))) if len(ca) < 100 else 0.0)
        assert (r.false_positive_fraction, r.removed_fraction) == (pytest.approx(false), pytest.approx(gone))
    rows = spatial.side_by_side(g, p, "g").where(F.size("gt") > 0)
    want = rows.select(
        F.sum(F.size(spatial.greedy_matches(F.col("gt"), F.col("pr"), 0.3))).alias("tp"), F.sum(F.when(F.size("pr") > 0, spatial.box_coverage(F.col("gt"), F.col("pr")) * F.size("gt"))).alias("iou"), F.sum(F.size("gt")).alias("n")
    ).first()
    by = spark.createDataFrame([], "g int, kind string")
    got = spatial.detector_metrics(g, p, "g", by, "kind", 0.3).where("kind is null").first()
    assert (got.true_positives, got.annotations, got.mean_best_iou) == (want.tp, want.n, pytest.approx(want.iou / want.n))
    share = sum(len(pixels([(r[0], 0, *r[2:])], r[0]) & pixels(pr, r[0])) / max(1, len(pixels([(r[0], 0, *r[2:])], r[0]))) for r in gt)
    assert got.mean_coverage == pytest.approx(share / len(gt))
    # slices of a few cells give the same
    cells, A.CELLS = A.CELLS, 7
    try:
        n = A.np.array([sum(r[0] == k for r in pr) for k in range(60)])
        assert list(A.union_area((n, [A.np.array([r[i] for r in pr]) for i in range(2, 6)]))) == [len(pixels(pr, k)) for k in range(60)]
    finally:
        A.CELLS = cells


def test_boxes_in_batches_are_quick(spark):
    import time

    rows = spark.range(0, 240000, numPartitions=4).selectExpr("id div 8 AS g", "cast(id % 8 AS int) AS idx", "cast(id * 7 % 60 AS int) AS x1", "cast(id * 13 % 40 AS int) AS y1")
    rows = rows.withColumns({"x2": F.col("x1") + 25, "y2": F.col("y1") + 25}).cache()
    rows.count()
    start = time.time()
    assert spatial.over_redaction(rows, rows, "g", 100, 80).where("false_positive_fraction = 0").count() == 30000
    assert time.time() - start < 40


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from veilframe.plans import tables

    n = 200_000
    pq.write_table(pa.table({"c_custkey": range(n), "s": [hashlib.sha256(b"%d" % i).hexdigest() for i in range(n)]}), f"{tmp_path}/customer.parquet", row_group_size=n)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(f"{tmp_path}/customer.parquet")
        assert df.rdd.getNumPartitions() >= 4 and tables.row_groups(df) == [n]  # many splits, one of which has all rows
        sizes = tables.Tables(spark, str(tmp_path)).customer.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < n / 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_digest_for_a_uid(spark):
    plan = spark.createDataFrame([("1.2",)], "v string").select(P.uid_pseudonym(SECRET, F.col("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 2


def test_pipeline_summary_moves_no_rows(spark):
    rows = spark.createDataFrame([("a", "skipped", 0.5, None), ("a", "skipped", 0.7, 1.0), ("b", "ok", 0.2, None), ("b", "skipped", 0.9, 0.4), ("c", "failed", None, None)], "p string, status string, m double, o double")
    out = evaluation.pipeline_summary(rows, ["p"], ["m"], ["o"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0, 0, 2, 0.6, 1.0), ("b", 1, 1, 0, 1, 0.2, None), ("c", 1, 0, 1, 0, 0.0, None)]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_region_map_is_built_once(spark):
    from veilframe.sources import records

    flat = F.create_map(*[y for k in ("x", "y", "width", "height") for y in (F.lit(k), F.col("v").cast("string"))])
    df = spark.createDataFrame([(3,), (-1,), (None,)], "v int").select(records.choose_roi(F.create_map().cast("map<string,struct<x:int,y:int,width:int,height:int>>"), flat).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("map(x,") == 1
    assert [r.m and tuple(r.m["endoscope_image"]) for r in df.collect()] == [(3, 3, 3, 3), None, None]


def test_boxes_of_more_rows_take_more_tasks(spark, tmp_path, monkeypatch):
    from veilframe.plans import tables

    spark.range(4000).selectExpr("id div 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "cast(id % 50 AS double) AS l_quantity", "1.0D AS l_extendedprice").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tables, "TASK_ROWS", 400)
    t = tables.Tables(spark, str(tmp_path))
    out = spatial.union_area_rows(t.boxes()[0], "instance")
    assert out.count() == 1000 and out._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(l_orderkey") >= 1
    sizes = [r["count"] for r in t.boxes_gt().groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1000
