"""Records from JSON in several shapes, and mapping files."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box
from ..functions.text import let


def parse_records(text: str) -> list[dict]:
    """Objects of an array, one object, a map of objects (the key becomes report_id) or JSON lines; a bad line is an error (SC1)."""
    text = text.strip()
    if not text:
        return []
    if text.startswith("["):
        return [x for x in json.loads(text) if isinstance(x, dict)]
    try:
        one = json.loads(text)
    except ValueError:
        one = None
    if isinstance(one, dict):
        if "\n" in text and one and all(isinstance(v, dict) for v in one.values()):
            return [{"report_id": k, **v} for k, v in one.items()]
        return [one]
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip().removesuffix(",").rstrip()
        if not line:
            continue
        try:
            x = json.loads(line)
        except ValueError as e:
            raise ValueError(f"line {n}: {e}") from e
        if not isinstance(x, dict):
            raise ValueError(f"line {n}: not an object")
        out.append(x)
    return out


def repair(text: str) -> list[dict]:
    """The objects of a file with comments, trailing commas and broken lines; the latter are dropped (SC3)."""
    text = re.sub(r"(?s)/\*.*?\*/", "", text)
    text = re.sub(r"(?m)//.*$", "", text)
    text = re.sub(r",(\s*[\]}])", r"\1", text).strip()
    try:
        one = json.loads(text)
        return [x for x in one if isinstance(x, dict)] if isinstance(one, list) else [one] if isinstance(one, dict) else []
    except ValueError:
        pass
    out = []
    for line in text.splitlines():
        try:
            x = json.loads(line.strip().removesuffix(",").rstrip())
        except ValueError:
            continue
        out += [y for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict)]
    return out


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def read_records(spark: SparkSession, path: str, fields: list[str], lenient: bool = False) -> DataFrame:
    """(source, ord, fields..): every record of the files, values as text; ord numbers a file's records (SC1, SC3, SC22, SC23).

    Files are read whole, as their shape decides how they are split; each file is one task's row.
    """
    parse = repair if lenient else parse_records

    def run(batches):
        for pdf in batches:
            rows = []
            for p, value in zip(pdf["source"], pdf["value"]):
                rows += [(p, k, *[_text(r.get(f)) for f in fields]) for k, r in enumerate(parse(value))]
            yield pd.DataFrame(rows, columns=["source", "ord", *fields])

    kind = "source string, ord long, " + ", ".join(f"`{f}` string" for f in fields)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value").mapInPandas(run, kind)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed JSON lines, in splits of any size; trailing commas are taken off and a bad line is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


BOX = T.StructType([T.StructField(k, T.IntegerType()) for k in (*Box._fields, "page_index")])
GOLDEN = (
    "sample_id string, input_type string, subject_id string, source_group_id string, source_path string, path string, file_path string, tags array<string>, roi map<string,struct<x:int,y:int,width:int,height:int>>, "
    "fixed_roi map<string,struct<x:int,y:int,width:int,height:int>>, ground_truth struct<first_name:string,last_name:string,dob:string,casenumber:string,examination_date:string,text:string,"
    "bounding_boxes:array<struct<x1:int,y1:int,x2:int,y2:int,page_index:int>>,image_dimensions:array<struct<width:int,height:int,page_index:int>>>"
)


def need(c: Column, name: str) -> Column:
    """The column, or an error where it is null."""
    return F.coalesce(c, F.raise_error(F.lit(f"{name} is missing")).cast("string"))


def input_type(c: Column) -> Column:
    """Modality from its many names."""
    t = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    kind = F.when(t.isin("frame", "image_frame", "video", "video_frame"), "video_frame").when(t.isin("document", "pdf", "report", "text_report", "text_report_document"), "text_report")
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported input_type: "), c)).cast("string"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Golden-set items from JSON lines, aliases resolved and required keys checked (SC2)."""
    rows = read_json_lines(spark, path, GOLDEN)
    return rows.select(
        need(F.col("sample_id"), "sample_id").alias("sample_id"), input_type(F.col("input_type")).alias("input_type"), "subject_id", "source_group_id", need(F.coalesce("source_path", "path", "file_path"), "source_path").alias("source_path"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("roi", "fixed_roi").alias("roi"), "ground_truth",
    )


ANSWERS = "map<string,struct<action:string,action_text:string>>"
ACTION = "struct<text:string,top_left:array<int>,bottom_right:array<int>>"


def unbracket(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\A<([\s\S]*)>\z", "$1")


def pixel_annotations(answers: DataFrame) -> DataFrame:
    """(instance_uid, text, x1..y2) of the hidden-pixel actions of an answer table (SC4, SC5, E18)."""
    lack = {"SOPInstanceUID", "AnswerData"} - set(answers.columns)
    if lack:
        raise ValueError(f"answer table lacks {sorted(lack)}")
    each = answers.select(unbracket(F.col("SOPInstanceUID")).alias("instance_uid"), F.explode(F.map_values(F.from_json("AnswerData", ANSWERS, {"mode": "FAILFAST"}))).alias("a"))
    box = each.where("a.action = '<pixels_hidden>'").select("instance_uid", F.from_json(unbracket(F.col("a.action_text")), ACTION, {"mode": "FAILFAST"}).alias("t"))
    return box.select("instance_uid", F.col("t.text").alias("text"), F.col("t.top_left")[0].alias("x1"), F.col("t.top_left")[1].alias("y1"), F.col("t.bottom_right")[0].alias("x2"), F.col("t.bottom_right")[1].alias("y2"))


def read_answers(spark: SparkSession, url: str, modalities: list[str] | None = None, table: str = "answer_data") -> DataFrame:
    """The answer table over JDBC; the modality filter is pushed to the database (SC5)."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table).load()
    return df if modalities is None else df.where(F.col("Modality").isin(*modalities))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id_old, id_new) of a mapping file; another header, blanks and conflicts are errors (SC14)."""
    from ..operators.redact import collisions

    head = spark.read.option("header", True).csv(path)
    if head.columns != ["id_old", "id_new"]:
        raise ValueError(f"a mapping file has the columns id_old,id_new, not {','.join(head.columns)}")
    table = head.select(F.trim("id_old").alias("id_old"), F.trim("id_new").alias("id_new")).distinct()
    wrong = collisions(table).first()
    if wrong:
        raise ValueError(f"mapping isn't one-to-one ({wrong['problem']}): {wrong['id_old']!r}")
    return table


ROI_ALIASES = ("", "endoscope_image_", "endoscope_type_", "first_name_")


def roi_of(m: Column) -> Column:
    """struct(x, y, width, height) of a flat map under any of the key prefixes; null unless all four are there and none is negative."""
    names = ("x", "y", "width", "height")
    parts = lambda v: F.struct(*[F.coalesce(*[F.try_element_at(v, F.lit(p + k)) for p in ROI_ALIASES]).try_cast("int").alias(k) for k in names])

    def checked(r: Column) -> Column:
        ok = F.lit(True)
        for k in names:
            ok = ok & F.coalesce(r[k] >= 0, F.lit(False))
        return F.when(ok, r)

    # the map is built once, not for each of its keys
    return let(let(m, parts), checked)


def roi_valid(r: Column, most: int = 5000) -> Column:
    """Inside the bounds and not empty."""
    ok = (r["width"] > 0) & (r["height"] > 0)
    for k in ("x", "y", "width", "height"):
        ok = ok & r[k].between(0, most)
    return F.coalesce(ok, F.lit(False))


def choose_roi(nested: Column, flat: Column) -> Column:
    """Map of regions: the nested one if it has any, else the flat one under its standard name."""
    kind = "map<string,struct<x:int,y:int,width:int,height:int>>"
    single = let(roi_of(flat), lambda one: F.when(one.isNotNull(), F.create_map(F.lit("endoscope_image"), one)).otherwise(F.lit(None).cast(kind)))
    return F.when(F.size(nested) > 0, nested.cast(kind)).otherwise(single)


def roi_policy(r: Column, width: Column, height: Column) -> Column:
    """struct(roi, fallback, reason): a region cut to the image, or why the whole image is used."""
    reason = (
        F.when(r.isNull(), None).when((r["x"] < 0) | (r["y"] < 0), "negative corner").when((r["width"] <= 0) | (r["height"] <= 0), "no size").when((r["x"] >= width) | (r["y"] >= height), "outside the image")
    )
    cut = F.struct(r["x"].alias("x"), r["y"].alias("y"), F.least(r["width"], width - r["x"]).alias("width"), F.least(r["height"], height - r["y"]).alias("height"))
    return F.struct(F.when(r.isNotNull() & reason.isNull(), cut).alias("roi"), reason.isNotNull().alias("fallback"), reason.alias("reason"))


def parse_box(m: Column) -> Column:
    """struct(x1..y2) of a map in either notation; null where it has no area (SP3, K19)."""
    v = lambda k: F.try_element_at(m, F.lit(k)).try_cast("int")
    b = F.struct(
        F.coalesce(v("x1"), v("x")).alias("x1"), F.coalesce(v("y1"), v("y")).alias("y1"), F.coalesce(v("x2"), v("x") + v("width")).alias("x2"), F.coalesce(v("y2"), v("y") + v("height")).alias("y2"),
        F.coalesce(v("page_index"), v("page")).alias("page_index"),
    )
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b)


def to_frame(v: Column) -> Column:
    """A frame sample from an open map, with defaults for what is missing or of another kind."""
    get = lambda k, kind, default: F.coalesce(F.try_element_at(v, F.lit(k)).try_cast(kind), F.lit(default).cast(kind)).alias(k)
    return F.struct(
        get("frame_index", "int", 0), get("timestamp", "double", 0.0), get("ocr_text", "string", ""), get("ocr_confidence", "double", 0.0), get("has_text", "boolean", False), get("has_patient_info", "boolean", False),
        get("has_ui_elements", "boolean", False), get("is_endoscopy_view", "boolean", False), get("quality_score", "double", 0.0),
    )


def flag_list(c: Column) -> Column:
    """Trimmed, non-empty parts of a comma list."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def without_nulls(m: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(m, lambda k, v: v.isNotNull())


def merge_sources(*records: Column) -> Column:
    """A map where earlier sources take precedence; nulls, blanks and unknown values give way (R2, Q11).

    To take several parts of it, select it into a column first: Spark evaluates nested lambdas
    wrongly where one projection repeats them.
    """
    keep = [F.map_filter(r, lambda k, v: v.isNotNull() & ~F.lower(F.trim(v)).isin("", "unknown")) for r in records]

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    out = keep[-1]
    for r in reversed(keep[:-1]):
        out = over(out, r)
    return out
