"""Readers, writers and adapters on small files."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import frames
from veilframe.sources import adapters, files, records, sinks
from veilframe.streaming import state


def test_record_shapes(spark, tmp_path):
    a, b = {"file": "f", "report_id": 1}, {"file": "g", "report_id": 2, "x": None}
    shapes = {"array": json.dumps([a, b, 3]), "one": json.dumps(a), "map": json.dumps({"7": {"file": "m"}, "8": {"file": "n"}}, indent=1), "lines": json.dumps(a) + ",\n\n" + json.dumps(b) + ",\n", "empty": ""}
    for k, v in shapes.items():
        (tmp_path / k).write_text(v)
    got = {k: [(r.file, r.report_id) for r in records.read_records(spark, str(tmp_path / k), ["file", "report_id"]).orderBy("ord").collect()] for k in shapes}
    assert got == {"array": [("f", "1"), ("g", "2")], "one": [("f", "1")], "map": [("m", "7"), ("n", "8")], "lines": [("f", "1"), ("g", "2")], "empty": []}
    with pytest.raises(ValueError, match="line 2"):
        records.parse_records('{"a": 1}\n{bad')
    assert records.repair('// c\n[{"a": 1,}, /* x */ {"b": [2,]}]') == [{"a": 1}, {"b": [2]}]
    assert records.repair('{"a": 1},\nbroken\n{"b": 2}') == [{"a": 1}, {"b": 2}]


def test_manifest(spark, tmp_path):
    item = {"sample_id": "s", "input_type": "Image-Frame", "path": "/x", "fixed_roi": {"a": {"x": 1, "y": 2, "width": 3, "height": 4}}, "ground_truth": {"first_name": "A", "bounding_boxes": [{"x1": 1, "y1": 2, "x2": 3, "y2": 4}]}}
    (tmp_path / "m").write_text(json.dumps(item) + ",\n")
    r = records.read_manifest(spark, str(tmp_path / "m")).first()
    assert (r.input_type, r.source_path, r.roi["a"].width, r.ground_truth.first_name, r.tags) == ("video_frame", "/x", 3, "A", [])
    (tmp_path / "bad").write_text(json.dumps({**item, "sample_id": None}))
    with pytest.raises(Exception, match="sample_id is missing"):
        records.read_manifest(spark, str(tmp_path / "bad")).collect()


def test_answers(spark):
    act = {"text": "N", "top_left": [1, 2], "bottom_right": [3, 4]}
    data = json.dumps({"0": {"action": "<pixels_hidden>", "action_text": f"<{json.dumps(act)}>"}, "1": {"action": "<tag_retained>", "action_text": "x"}})
    df = spark.createDataFrame([("<1.2.3>", data)], "SOPInstanceUID string, AnswerData string")
    assert [tuple(r) for r in records.pixel_annotations(df).collect()] == [("1.2.3", "N", 1, 2, 3, 4)]
    with pytest.raises(ValueError):
        records.pixel_annotations(df.select("AnswerData"))


def test_mapping_files(spark, tmp_path):
    table = spark.createDataFrame([("b", "2"), ("a,x", "1")], "id_old string, id_new string")
    sinks.write_mapping(table, str(tmp_path / "m"))
    assert {tuple(r) for r in records.read_mapping(spark, str(tmp_path / "m")).collect()} == {("a,x", "1"), ("b", "2")}
    sinks.write_mapping(spark.createDataFrame([("a", "1"), ("b", "1")], "id_old string, id_new string"), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="one-to-one"):
        records.read_mapping(spark, str(tmp_path / "n"))


def test_regions(spark):
    flat = "map<string,int>"
    df = spark.createDataFrame([({"endoscope_image_x": 1, "y": 2, "width": 3, "height": 4}, None), ({"x": 1, "y": 2}, None), ({"x": -1, "y": 2, "width": 3, "height": 4}, None), (None, {"n": {"x": 5, "y": 6, "width": 0, "height": 8}})], f"f {flat}, n map<string,struct<x:int,y:int,width:int,height:int>>")
    got = df.select(records.roi_of(F.col("f")).alias("r"), records.choose_roi(F.col("n"), F.col("f")).alias("c")).withColumn("ok", records.roi_valid(F.col("r"))).collect()
    assert [None if r.r is None else tuple(r.r) for r in got] == [(1, 2, 3, 4), None, None, None]
    assert [None if r.c is None else list(r.c) for r in got] == [["endoscope_image"], None, None, ["n"]] and [r.ok for r in got] == [True, False, False, False]
    box = spark.createDataFrame([({"x": "1", "y": "2", "width": "3", "height": "4"},), ({"x1": "5", "y1": "5", "x2": "5", "y2": "9"},)], "m map<string,string>").select(records.parse_box(F.col("m")).alias("b")).collect()
    assert tuple(box[0].b)[:4] == (1, 2, 4, 6) and box[1].b is None
    m = spark.createDataFrame([({"a": "unknown", "b": "1"}, {"a": "2", "b": "3", "c": None})], "p map<string,string>, q map<string,string>")
    assert m.select(records.merge_sources(F.col("p"), F.col("q"))).first()[0] == {"a": "2", "b": "1"}


def test_files(spark, tmp_path):
    for p in ("p1/a.dcm", "p1/b.dcm", "p2/c.dcm", "x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    found = files.scan_tree(spark, str(tmp_path))
    assert found.count() == 3 and files.scan_tree(spark, str(tmp_path), most=2).count() == 2
    assert {(r.patient, len(r.paths)) for r in files.by_patient(found, str(tmp_path)).collect()} == {("p1", 2), ("p2", 1)}
    (tmp_path / "names").write_text("Anna Schmidt\nJürgen\n\nBo Li Chen\n")
    assert {tuple(r) for r in files.lexicon(spark, str(tmp_path / "names"), True).collect()} == {("Anna Schmidt", "Anna", "Schmidt"), ("Bo Li Chen", "Bo", "Li Chen")}
    f, m = (spark.createDataFrame([(x,) for x in v], "first string") for v in (("Anna", "Kim"), ("Max", "Kim")))
    people = spark.createDataFrame([("anna",), ("MAX",), ("Kim",), (None,)], "n string")
    assert {(r.n, r.gender) for r in files.gender_by_name(people, "n", f, m).collect()} == {("anna", "female"), ("MAX", "male"), ("Kim", "unknown"), (None, "unknown")}
    assert spark.range(1).select(files.file_type(F.lit("a.JPG"))).first()[0] == "jpg"
    grid = spark.range(1).select(F.size(files.tiles(F.lit(1600), F.lit(900))), files.black_value(F.lit("MONOCHROME1"), F.lit(False), F.lit(12)), files.black_value(F.lit("MONOCHROME2"), F.lit(True), F.lit(12))).first()
    assert tuple(grid) == (2, 4095, -2048)


def test_adapter(spark):
    def make():
        def read(text):
            if text == "bad":
                raise RuntimeError("no")
            return [(0, 1, 2, 3, 4, 0.5, None)] * len(text)

        return read

    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "bad")], "k int, v string")
    got = adapters.apply(df, "k", "v", "detector", make).collect()
    assert sorted((r.k, r.x2, r.status) for r in got if r.x2 is not None) == [(1, 3, "ok"), (1, 3, "ok")]
    assert {(r.k, r.status) for r in got if r.x2 is None} == {(2, "ok"), (3, "failed")}


FRAMES = "video long, frame long, first_name string, last_name string, dob string, casenumber string, examination_date string"


def test_stream_equals_batch(spark):
    import random

    r = random.Random(3)
    some = lambda v: r.choice([None, "unknown", v, None])
    rows = [(v, f, some(f"F{f}"), some(f"L{f}"), some(f"19{r.randint(10, 99)}-01-01"), some(str(f)), some(f"20{r.randint(10, 24)}-01-01")) for v in range(6) for f in range(9)]
    df = spark.createDataFrame(rows, FRAMES).repartition(1)
    acc = frames.early_stop(frames.accumulate(df, "video", "frame"), "video", "frame")
    want = {(x.video, x.n, *x.r) for x in acc.groupBy("video").agg(F.count("*").alias("n"), F.max_by(F.struct(*frames.FIELDS), "frame").alias("r")).collect()}
    out = state.replay(df, lambda s: state.final_states(s, "video", "frame"), "video")
    assert {(x.video, x.frames_processed, *[x[f] for f in frames.FIELDS]) for x in out.collect()} == want
    capped = state.replay(df, lambda s: state.final_states(s, "video", "frame", cap=1), "video")
    assert {x.frames_processed for x in capped.collect()} == {1}


def test_stream_top_texts(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", float(i % 4)) for i in range(8)], "v long, f long, t string, s double")
    out = state.replay(df, lambda s: state.top_texts(s, "v", "f", "t", "s", 3), "v").first()
    assert out.best == ["t3", "t7", "t2"]


def test_elements_of_many_patients_are_few_files(spark, tmp_path):
    rows = spark.range(6000).selectExpr("concat('p', id % 2000) AS patient", "id % 2 AS study", "id % 3 AS series", "id AS instance", "'k' AS keyword", "cast(id AS string) AS value")
    path = tmp_path / "out"
    sinks.write_elements(rows, str(path))
    assert len(list(path.glob("**/*.parquet"))) <= sinks.BUCKETS
    assert sorted(r.instance for r in sinks.read_elements(spark, str(path), "p7").collect()) == [7, 2007, 4007]
    assert sinks.read_elements(spark, str(path), "nobody").count() == 0
    assert len(spark.read.parquet(str(path)).where("patient = 'p7' and study = 1").collect()) == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_elements(rows, str(path))
