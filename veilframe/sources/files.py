"""Files by folder: discovery, hashes, lexicons, device profiles, index scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"jpg": "jpg", "jpeg": "jpeg", "png": "png", "tif": "tiff", "tiff": "tiff", "pdf": "pdf"}


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.dcm", most: int | None = None) -> DataFrame:
    """(path, length, modified) of the files below a folder in order of path (SC6, T14); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    out = files.select("path", "length", F.col("modificationTime").alias("modified"))
    return out if most is None else out.orderBy("path").limit(most)


def contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content, sha256) (SC26)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_type(path: Column) -> Column:
    """The kind of an image or PDF by its extension; an error for any other (SC11)."""
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, extension(path)), F.raise_error(F.concat(F.lit("unsupported file: "), path)).cast("string"))


def by_patient(files: DataFrame, root: str) -> DataFrame:
    """(patient, paths): by the first folder below the root, or the stem of a file in the root (SC8)."""
    rest = F.substring("path", F.position(F.lit(root.rstrip("/") + "/"), F.col("path")) + len(root.rstrip("/")) + 1, F.length("path"))
    parts = F.split(rest, "/")
    patient = F.when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(rest, r"\.[^.]*$", ""))
    return files.groupBy(patient.alias("patient")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def index_of(elements: DataFrame, wanted: DataFrame, uid: str = "SOPInstanceUID") -> DataFrame:
    """(instance_uid, path) of the wanted instances only; the other elements aren't read (SC7)."""
    rows = elements.where(F.col("keyword") == uid).select(F.col("value").alias("instance_uid"), "path")
    return rows.join(wanted.select("instance_uid").distinct(), "instance_uid", "left_semi").groupBy("instance_uid").agg(F.min("path").alias("path"))


def lexicon(spark: SparkSession, path: str, ascii_only: bool = False) -> DataFrame:
    """(name, first, rest) of a file with a name a line (SC24, D18)."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    if ascii_only:
        lines = lines.where(F.col("name").rlike(r"\A[\x20-\x7e\s]*\z"))
    w = F.split("name", r"\s+")
    return lines.select("name", w[0].alias("first"), F.array_join(F.slice(w, F.lit(2), F.size(w)), " ").alias("rest"))


def gender_by_name(records: DataFrame, first: str, female: DataFrame, male: DataFrame) -> DataFrame:
    """``records`` with the gender that the lexicons give a first name, unknown if none or both do."""
    names = female.select(F.lower("first").alias("__n"), F.lit("female").alias("g")).unionByName(male.select(F.lower("first").alias("__n"), F.lit("male").alias("g"))).distinct()
    one = names.groupBy("__n").agg(F.min("g").alias("__g"), F.count("*").alias("__k")).where("__k = 1")
    # lexicons have a fixed number of names; the optimiser sees their size and chooses the join
    return records.join(one, F.lower(first) == F.col("__n"), "left").withColumn("gender", F.coalesce("__g", F.lit("unknown"))).drop("__n", "__g", "__k")


DEVICE = "device string, name_box struct<x:int,y:int,width:int,height:int>, background_color array<int>, font_color array<int>, font string, text_formatting string"


def devices(spark: SparkSession, path: str) -> DataFrame:
    """Device profiles with defaults for what a file leaves out (SC25)."""
    d = spark.read.schema(DEVICE).option("multiLine", True).json(path)
    rgb = lambda *v: F.array(*map(F.lit, v))
    return d.select(
        F.coalesce("device", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)).alias("device"), "name_box", F.coalesce("background_color", rgb(0, 0, 0)).alias("background_color"), F.coalesce("font_color", rgb(255, 255, 255)).alias("font_color"),
        F.coalesce("font", F.lit("sans")).alias("font"), F.coalesce("text_formatting", F.lit("first_name last_name")).alias("text_formatting"),
    )


def report_text(given: Column, pdf: Column, image: Column) -> Column:
    """The first source of a report's text that has any (SC10)."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(some(given), some(pdf), some(image))


def stream_copy(codec: Column, pixel_format: Column, audio: Column, containers: Column) -> Column:
    """Whether a video can be copied without encoding: known codecs, eight bits, 4:2:0."""
    ok = codec.isin("h264", "hevc", "mpeg4", "vp9", "av1") & (audio.isNull() | audio.isin("aac", "mp3", "ac3", "opus"))
    return F.coalesce(ok & ~pixel_format.rlike("10le|12le|422") & containers.isNotNull(), F.lit(False))


def tiles(width: Column, height: Column, size: int = 800, overlap: int = 100) -> Column:
    """Array of (left, upper, right, lower) of the overlapping grid over an image."""
    step = size - overlap
    count = lambda n: F.greatest(F.lit(1), F.floor((n - overlap) / step).cast("int"))
    at = lambda n: F.transform(F.sequence(F.lit(0), count(n) - 1), lambda i: i * step)
    return F.flatten(F.transform(at(height), lambda y: F.transform(at(width), lambda x: F.struct(x.alias("left"), y.alias("upper"), F.least(x + size, width).alias("right"), F.least(y + size, height).alias("lower")))))


def page_mode(width: Column, height: Column) -> Column:
    """How a reader takes a box of this shape."""
    aspect = width / F.greatest(height, F.lit(1))
    return F.when((height < 50) | (aspect > 8), "single_line").when((aspect < 2) & (height < 100), "single_word").when(height < 200, "single_block").otherwise("sparse_text")


def numeric_only(width: Column, height: Column) -> Column:
    """Whether a box of this shape is read as digits."""
    return (height < 60) | (width / F.greatest(height, F.lit(1)) > 7)


def black_value(photometric: Column, signed: Column, bits: Column) -> Column:
    """The pixel value of black."""
    top = lambda n: F.call_function("shiftleft", F.lit(1), n)
    return F.when(photometric == "MONOCHROME1", top(bits - signed.cast("int")) - 1).when(signed, -top(bits - 1)).otherwise(0)


def percentile_window(values: DataFrame, group: str, value: str) -> DataFrame:
    """Values between the 0.5 and 99.5 percentiles of their group as 0 to 255; all 0 for a group without range."""
    cut = F.percentile(F.col(value), F.array(F.lit(0.005), F.lit(0.995)))
    w = values.groupBy(group).agg(cut.alias("__p"), F.min(value).cast("double").alias("__a"), F.max(value).cast("double").alias("__b"))
    flat = F.col("__p")[1] <= F.col("__p")[0]
    w = w.select(group, F.when(flat, F.col("__a")).otherwise(F.col("__p")[0]).alias("__lo"), F.when(flat, F.col("__b")).otherwise(F.col("__p")[1]).alias("__hi"))
    scaled = (F.col(value) - F.col("__lo")) * (F.lit(255.0) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    return values.join(w, group).withColumn("scaled", F.coalesce(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int"), F.lit(0))).drop("__lo", "__hi")


def pick_model(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """The available model of the least priority value."""
    return wanted.join(available.select("name").distinct(), "name", "left_semi").agg(F.min_by("name", F.struct("priority", "name")).alias("name"))
