"""Filters, joins, aggregates and assembly of metadata records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import privacy as P
from ..functions.text import strip


def min_text(c: Column, least: int = 2) -> Column:
    """At least ``least`` characters besides white space at the ends (F1)."""
    return F.coalesce(F.length(strip(c)) >= least, F.lit(False))


def confident_word(text: Column, conf: Column, width: Column, height: Column, least: float = 0.5) -> Column:
    """Some text, a confidence (0 to 100) of the limit, and a box with an area (F2)."""
    return F.coalesce((strip(text) != "") & (conf >= least * 100) & (width > 0) & (height > 0), F.lit(False))


def detector_row(b: G.Box, score: Column, cls: Column, least: float, classes: Sequence[int] | None = None) -> Column:
    """A detection that counts: its score, its class if some are listed, and an area."""
    ok = (score >= least) & (b.x2 > b.x1) & (b.y2 > b.y1)
    return F.coalesce(ok & cls.isin(*classes) if classes else ok, F.lit(False))


def top_class(scores: Column) -> Column:
    """struct(cls, score) of the greatest class score of a raw detector row, the first on ties."""
    return F.struct((F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("cls"), F.array_max(scores).alias("score"))


def patient_signal(first: Column, last: Column) -> Column:
    """A first or a last name is there."""
    return first.isNotNull() | last.isNotNull()


def by_confidence(rows: DataFrame, group: str, conf: str, pos: str, default: float = 0.5) -> DataFrame:
    """``rows`` with ``priority``: their place in the group by falling confidence, by position where equal."""
    return rows.withColumn("priority", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.coalesce(conf, F.lit(default))), pos)))


def with_boxes(records: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """``records`` with ``boxes``: the array of their (x1, y1, x2, y2), empty for a negative.

    An image has few boxes; they are collected on their own side before the join.
    """
    lists = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("boxes"))
    return records.join(lists, key, "left").withColumn("boxes", F.coalesce("boxes", F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")))


def required_join(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Left join in which a missing right side is an error."""
    there = right.withColumn("__there", F.lit(True))
    out = left.join(there, key, "left")
    sure = F.coalesce(F.col("__there"), F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(key).cast("string"))).cast("boolean"))
    return out.where(sure).drop("__there")


def runs_of(samples: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Every sample with each pipeline of its input type."""
    return samples.join(pipelines, "input_type")


def corrected(words: DataFrame, dictionary: DataFrame, column: str, ratio: float = 0.85) -> DataFrame:
    """``words`` with ``fixed``: the nearest entry that is longer, if more than ``ratio`` alike, else the word itself.

    Alike is 1 - distance / length of the longer one.  Distinct words are joined by the
    lengths that can reach the ratio; the entry of greatest likeness counts, then the first.
    """
    entry = dictionary.select(F.col("entry"), F.length("entry").alias("__size"))
    some = words.select(F.col(column).alias("__w")).where("__w is not null").distinct()
    sizes = some.withColumn("__size", F.explode(F.sequence(F.length("__w") + 1, F.greatest(F.length("__w") + 1, F.floor(F.length("__w") / ratio).cast("int")))))
    near = sizes.join(entry, "__size").withColumn("__r", 1 - F.levenshtein("__w", "entry") / F.length("entry")).where(F.col("__r") > ratio)
    best = near.groupBy("__w").agg(F.min_by("entry", F.struct(-F.col("__r"), "entry")).alias("__e"))
    return words.join(best, words[column] == F.col("__w"), "left").withColumn("fixed", F.coalesce("__e", F.col(column))).drop("__w", "__e")


def spelled(line: Column, fixes: Column, least: int = 4) -> Column:
    """A line with the words that a map corrects, unless it is short or has digits."""
    words = F.transform(F.split(line, " "), lambda w: F.coalesce(F.try_element_at(fixes, F.lower(w)), w))
    return F.when((F.length(strip(line)) < least) | line.rlike("[0-9]"), line).otherwise(F.array_join(words, " "))


def redaction_summary(regions: DataFrame, page: str, conf: str) -> DataFrame:
    """Pages, regions, and the least, greatest and mean confidence."""
    return regions.agg(F.countDistinct(page).alias("pages"), F.count("*").alias("regions"), F.min(conf).alias("min_conf"), F.max(conf).alias("max_conf"), F.avg(conf).alias("mean_conf"))


def completeness(sources: dict[str, dict[str, Column]]) -> tuple[Column, Column]:
    """(share of fields that any source fills, names of the sources that fill any) (A22; each field counts, quirk Q10)."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    fields = list(dict.fromkeys(f for m in sources.values() for f in m))
    n = sum((F.greatest(*cols) if len(cols := [filled(m[f]) for m in sources.values() if f in m]) > 1 else cols[0]).cast("int") for f in fields)
    used = F.filter(F.array(*[F.when(F.greatest(F.lit(False), *[filled(c) for c in m.values()]), name) for name, m in sources.items()]), lambda x: x.isNotNull())
    return n / float(len(fields)), used


def sampler_stats(samples: DataFrame, score: str) -> DataFrame:
    """Samples, mean and greatest score; zeros for none."""
    return samples.agg(F.count("*").alias("samples"), F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_score"), F.coalesce(F.max(score), F.lit(0.0)).alias("max_score"))


def zipped(rows: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays as rows, the shorter ones filled with nulls."""
    keep = [c for c in rows.columns if c not in arrays]
    return rows.select(*keep, F.inline(F.arrays_zip(*arrays)))


def required(m: Column, names: Sequence[str]) -> list[Column]:
    """The named values of an open map; a missing name is an error."""
    return [F.coalesce(F.try_element_at(m, F.lit(n)), F.raise_error(F.lit(f"{n} is missing")).cast("string")).alias(n) for n in names]


def formatted_name(template: Column, first: Column, last: Column) -> Column:
    """A template's first_name and last_name filled in."""
    return F.replace(F.replace(template, F.lit("first_name"), first), F.lit("last_name"), last)


def renamed_identifier(line: Column, old: str, new: str) -> Column:
    """Whole-word occurrences of an identifier renamed."""
    return F.regexp_replace(line, rf"\b{old}\b", new)


def with_counterpart(line: Column, old: str, new: str) -> Column:
    """A line and, if it names the identifier, a copy that names its counterpart."""
    return F.when(line.rlike(rf"\b{old}\b"), F.array(line, renamed_identifier(line, old, new))).otherwise(F.array(line))


def synthetic_identities(spark, n: int, secret: bytes, firsts: Sequence[str], lasts: Sequence[str]) -> DataFrame:
    """(id, first_name, last_name, dob, pid, acc) of ``n`` made-up persons, the same for each secret."""
    k = F.col("id").cast("string")
    digits = lambda tag, most: F.pmod(F.xxhash64(F.lit(secret.hex()), F.lit(tag), k), F.lit(most))
    return spark.range(n).select(
        "id", P.draw(firsts, secret, "first", k).alias("first_name"), P.draw(lasts, secret, "last", k).alias("last_name"), F.date_add(F.lit("1930-01-01").cast("date"), digits("dob", 29_000).cast("int")).alias("dob"),
        F.format_string("P%08d", digits("pid", 10**8)).alias("pid"), F.format_string("A%010d", digits("acc", 10**10)).alias("acc"),
    )


def name_layout(layout: Column, first: Column, last: Column) -> Column:
    """Lines of a name on an image: one for both, or one each."""
    return F.when(layout == "separate", F.array(first, last)).when(layout == "last_first", F.array(F.concat(last, F.lit(", "), first))).otherwise(F.array(F.concat(first, F.lit(" "), last)))


def unified(rules: dict[str, Column], frame: dict[str, Column]) -> dict[str, Column]:
    """The fields of the rule extractor if it found a name, birth date or case number, else those of the frame patterns (K3, K4)."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    signal = F.greatest(F.lit(False), *[some(rules[k]) for k in ("first_name", "last_name", "dob", "casenumber") if k in rules])
    return {k: F.when(signal, rules.get(k, F.lit(None))).otherwise(frame.get(k, F.lit(None))) for k in dict.fromkeys([*rules, *frame])}


def first_valid(candidates: DataFrame, group: str, rank: str, valid: Column, budget: int = 2) -> DataFrame:
    """The first valid one of each group's best ``budget`` candidates (K5)."""
    tried = candidates.withColumn("__n", F.row_number().over(W.partitionBy(group).orderBy(rank))).where(F.col("__n") <= budget)
    names = [c for c in candidates.columns if c != group]
    return tried.where(valid).groupBy(group).agg(F.min_by(F.struct(*names), "__n").alias("__r")).select(group, "__r.*")


def final_text(best: Column, known: Column, representative: Column) -> Column:
    """A video's text: the best reading, else the text it has, else the representative one (K7)."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(best), some(known), some(representative))


def payload(c: Column, fields: str) -> Column:
    """A metadata record from JSON: the nested ``llm_extracted`` if it is an object, null for what is no object (K9)."""
    nested = F.get_json_object(c, "$.llm_extracted")
    whole = F.when(nested.startswith("{"), nested).otherwise(c)
    return F.when(whole.startswith("{"), F.from_json(whole, fields))


def assembled(record: Column, meta: Column, metrics: Column) -> Column:
    """A report's output: its record, what was extracted where the record has nothing, and its metrics; maps of text."""
    blank = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    out = blank(metrics)
    for m in (meta, record):
        out = over(out, blank(m))
    return out


def with_fallback(custom: DataFrame, detected: DataFrame, readings: DataFrame, page: str) -> DataFrame:
    """Regions of the custom detector and of the text detector, those of the plain reader on pages where the latter has none."""
    lacking = readings.join(detected.select(page).distinct(), page, "left_anti")
    return custom.unionByName(detected).unionByName(lacking).distinct()


def removal_plan(frames: DataFrame, video: str, frame: str, sensitive: Column) -> DataFrame:
    """(video, total, removed, copy): frames to drop of each video, and whether it is copied as it is."""
    n = F.count_if(sensitive)
    return frames.groupBy(video).agg(F.count("*").alias("total"), n.alias("removed"), (n == 0).alias("copy"))


def fill_plan(b: G.Box, width: Column, height: Column) -> Column:
    """The box cut to the image, for filling; an error for one that lies outside (SP21)."""
    c = G.clamp(b, width, height)
    return F.when(c.x1.isNotNull(), c.struct()).otherwise(F.raise_error(F.lit("box outside the image")).cast("struct<x1:int,y1:int,x2:int,y2:int>"))


def mask_config(roi: Column, width: Column, height: Column, default: tuple[int, int] = (1920, 1080)) -> Column:
    """struct(x, y, width, height, image_width, image_height) with default sizes."""
    w, h = F.coalesce(width, F.lit(default[0])), F.coalesce(height, F.lit(default[1]))
    part = lambda k, d: F.coalesce(roi[k], d).alias(k)
    return F.struct(part("x", F.lit(0)), part("y", F.lit(0)), part("width", w), part("height", h), w.alias("image_width"), h.alias("image_height"))
