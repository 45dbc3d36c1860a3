"""Frames in order: ranges, changes, accumulated records, sampling, and what a video or report amounts to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .evaluation import ratio

FIELDS = tuple("first_name last_name dob casenumber examination_date".split())
SIGNAL = (*FIELDS, *"endoscope_sn endoscope_type examiner_last_name examiner_first_name examination_time gender".split())


def frame_ranges(frames: DataFrame, video: str, frame: str) -> DataFrame:
    """(video, start, end) of each run of consecutive indices; repeats count once, a negative index is an error."""
    at = F.when(F.col(frame) < 0, F.raise_error(F.lit("frame indices must not be negative")).cast("bigint")).otherwise(F.col(frame).cast("bigint"))
    rows = frames.select(video, at.alias("f")).distinct()
    run = F.col("f") - F.row_number().over(W.partitionBy(video).orderBy("f"))
    return rows.withColumn("run", run).groupBy(video, "run").agg(F.min("f").alias("start"), F.max("f").alias("end")).select(video, "start", "end")


def seconds_text(frame: Column, fps: float) -> Column:
    """A frame's time with nine decimals at most (M7)."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", frame / F.lit(float(fps))), "0+$", ""), r"\.$", "")


def drop_filters(frames: DataFrame, video: str, frame: str, fps: float, enumerate_up_to: int = 64) -> DataFrame:
    """(video, video_filter, audio_filter) that drop frames and the matching sound."""
    if not 0 < fps < float("inf"):
        raise ValueError("the frame rate must be positive")
    ranges = frame_ranges(frames, video, frame)
    s = lambda c: c.cast("string")
    both = F.struct("start", "end")
    out = ranges.groupBy(video).agg(F.array_sort(F.collect_list(both)).alias("r"), F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    single = lambda i: F.concat(F.lit("eq(n\\,"), s(i), F.lit(")"))
    span = lambda k, a, b: F.concat(F.lit(f"between({k}\\,"), a, F.lit("\\,"), b, F.lit(")"))
    each = F.flatten(F.transform("r", lambda x: F.transform(F.sequence(x["start"], x["end"]), single)))
    short = F.transform("r", lambda x: F.when(x["start"] == x["end"], single(x["start"])).otherwise(span("n", s(x["start"]), s(x["end"]))))
    sound = F.transform("r", lambda x: span("t", seconds_text(x["start"], fps), seconds_text(x["end"] + 1, fps)))
    picture = F.when(F.col("n") <= enumerate_up_to, F.array_join(each, "+")).otherwise(F.array_join(short, "+"))
    return out.select(
        video, F.concat(F.lit("select='not("), picture, F.lit(")',setpts=N/FRAME_RATE/TB")).alias("video_filter"), F.concat(F.lit("aselect='not("), F.array_join(sound, "+"), F.lit(")',asetpts=N/SR/TB")).alias("audio_filter")
    )


def change_points(frames: DataFrame, video: str, frame: str, text: str, limit: float = 0.3) -> DataFrame:
    """(video, frame, similarity) where the first 50 characters share few words with the frame before."""
    c = F.col(text)
    snippet = F.when(F.length(c) > 50, F.concat(F.left(c, F.lit(50)), F.lit("..."))).otherwise(c)
    rows = frames.where((c != "") & c.isNotNull()).select(video, frame, snippet.alias("s"))
    rows = rows.withColumn("before", F.lag("s").over(W.partitionBy(video).orderBy(frame))).where("before is not null")
    return rows.select(video, frame, X.jaccard(F.col("s"), F.col("before")).alias("similarity")).where(F.col("similarity") < limit)


def frame_type(patient: Column, ui: Column, conf: Column, endoscopy: Column) -> Column:
    """What a frame shows."""
    return F.when(patient, "patient_info").when(ui, "ui_frame").when(conf > 0.7, "text_frame").when(endoscopy, "endoscopy").otherwise("unknown")


def temporal(frames: DataFrame, video: str, ts: str, text: str, conf: str, extracted: Column) -> DataFrame:
    """Density and duration of text, and the weighted confidence of a video."""
    has = F.coalesce(F.col(text) != "", F.lit(False))
    rows = frames.withColumns({"__has": has, "__m": extracted})
    out = rows.groupBy(video).agg(
        F.count("*").alias("frames"), F.count_if(has | (F.col(conf) > 0.5)).alias("text_frames"), F.count_if("__has").alias("n"), (F.max(F.when(has, F.col(ts))) - F.min(F.when(has, F.col(ts)))).alias("covered_duration"),
        F.coalesce(F.avg(conf), F.lit(0.0)).alias("q"), F.coalesce(F.avg(F.when(has, F.col(conf))), F.lit(0.0)).alias("s"), F.max("__m").alias("m"),
    )
    r = lambda c: F.round(c, 6)
    q, s, m = F.col("q"), F.col("s"), F.col("m")
    return out.select(
        video, "frames", "text_frames", r(ratio(F.col("n"), F.col("frames"))).alias("temporal_density"), "covered_duration", r(m).alias("llm_confidence"), r(q).alias("frame_quality_confidence"),
        r(s).alias("temporal_stability_confidence"), r(m * 0.5 + q * 0.2 + s * 0.3).alias("overall_confidence"),
    )


def running_best(frames: DataFrame, video: str, frame: str, text: str, conf: str) -> DataFrame:
    """(video, frame, best_text): the best text so far by confidence, then length, then the earlier."""
    t = X.strip(F.col(text))
    row = F.when((t != "") & t.isNotNull(), F.struct(F.col(conf), F.length(t).alias("n"), (-F.col(frame)).alias("first"), t.alias("t")))
    w = W.partitionBy(video).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    return frames.select(video, frame, F.max(row).over(w)["t"].alias("best_text"))


def complete(has: dict[str, Column]) -> Column:
    """Enough identifiers to stop (F8)."""
    f, n, d, c, e = (has[k] for k in FIELDS)
    return (f & n & d) | (f & n & c & e) | ((f | n) & d & c)


def is_sensitive(m: dict[str, Column], regions: Column | None = None) -> Column:
    """An identifier or the gender is there, or a region was found."""
    out = F.lit(False)
    for k in ("first_name", "last_name", "casenumber", "dob", "gender"):
        out = out | X.nonblank(m[k].cast("string"))
    return out if regions is None else out | F.coalesce(F.size(regions) > 0, F.lit(False))


def has_signal(m: dict[str, Column]) -> Column:
    """Any field of a record isn't blank."""
    out = F.lit(False)
    for k in SIGNAL:
        if k in m:
            out = out | F.coalesce(F.trim(m[k].cast("string")) != "", F.lit(False))
    return out


def accumulate(frames: DataFrame, video: str, frame: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Each row's record so far: a value fills a blank and is never overwritten; an examination before the birth swaps with it.

    Adds ``complete``: whether the record so far suffices (F8).
    """
    w = W.partitionBy(video).orderBy(frame).rowsBetween(W.unboundedPreceding, 0)
    first = lambda f: F.first(F.when(X.nonblank(F.col(f).cast("string")), F.col(f)), ignorenulls=True).over(w)
    rows = frames.select(video, frame, *[first(f).alias(f) for f in fields])
    if {"dob", "examination_date"} <= set(fields):
        swap = F.coalesce(F.col("examination_date") < F.col("dob"), F.lit(False))
        a, b = F.col("dob"), F.col("examination_date")
        rows = rows.withColumns({"dob": F.when(swap, b).otherwise(a), "examination_date": F.when(swap, a).otherwise(b)})
    return rows.withColumn("complete", complete({f: F.col(f).isNotNull() for f in FIELDS})) if set(FIELDS) <= set(fields) else rows


def early_stop(accumulated: DataFrame, video: str, frame: str) -> DataFrame:
    """Rows up to and with the first complete one."""
    w = W.partitionBy(video).orderBy(frame).rowsBetween(W.unboundedPreceding, -1)
    return accumulated.withColumn("__done", F.coalesce(F.max("complete").over(w), F.lit(False))).where("not __done").drop("__done")


def stride(total: Column, target: Column, fps: float) -> Column:
    """Every how many frames to look."""
    return F.greatest(F.lit(5), F.least(F.ceil(total / F.greatest(target, F.lit(1))).cast("int"), F.lit(int(2 * fps))))


def profile_target(profile: Column, configured: int) -> Column:
    """Frames that a quality profile looks at."""
    return F.when(profile == "fast", min(configured, 12)).when(profile == "quality", max(configured, 48)).otherwise(configured)


def stride_sample(frames: DataFrame, video: str, frame: str, target: int, fps: float = 30.0) -> DataFrame:
    """The frames at the stride, the first ``target`` of them."""
    rows = frames.withColumn("__n", F.count("*").over(W.partitionBy(video)))
    rows = rows.withColumn("__s", stride(F.col("__n"), F.least(F.lit(max(1, target)), F.col("__n")), fps)).where(F.pmod(F.col(frame), F.col("__s")) == 0)
    rows = rows.withColumn("__k", F.row_number().over(W.partitionBy(video).orderBy(frame))).where(F.col("__k") <= target)
    return rows.withColumnRenamed("__s", "stride").drop("__n", "__k")


def adaptive_sample(frames: DataFrame, video: str, frame: str, content: str) -> DataFrame:
    """Frames to process: five at each end, and of the others every 2nd, 5th or 10th whose content wasn't processed before (T9, ST5).

    A frame counts as seen if an earlier frame with its content was taken.  The frames that the
    position admits are known without state, and of those with one content the first is taken;
    only the ends are taken again.
    """
    f, n = F.col(frame), F.col("__n")
    rows = frames.withColumn("__n", F.count("*").over(W.partitionBy(video)))
    step = F.when(n <= 100, 2).when(n <= 500, 5).otherwise(10)
    ends = (f < 5) | (f >= n - 5)
    rows = rows.withColumn("__ends", ends).where(ends | (F.pmod(f, step) == 0))
    first = F.row_number().over(W.partitionBy(video, content).orderBy(frame)) == 1
    return rows.withColumn("__first", first).where("__ends or __first").drop("__n", "__ends", "__first")


def sampling_strategy(total: Column, most: int = 50) -> dict[str, Column]:
    """Strategy, factor and number of samples by length."""
    pick = lambda a, b, c, d: F.when(total <= 50, a).when(total <= 200, b).when(total <= 1000, c).otherwise(d)
    part = lambda k: F.floor(total / k).cast("int")
    return {
        "strategy": pick(F.lit("dense"), F.lit("moderate"), F.lit("sparse"), F.lit("minimal")),
        "skip_factor": pick(F.lit(1), F.lit(2), F.lit(5), F.lit(10)),
        "max_samples": pick(total.cast("int"), part(2), part(5), F.least(F.lit(most), part(10))),
    }


def source_tags(roi: Column, text: Column, signal: Column, regions: Column) -> Column:
    """Where an observation's content comes from."""
    return F.array_compact(
        F.array(F.when(roi.isNotNull(), "ocr_roi"), F.when(X.strip(text) != "", "east_ocr"), F.when(signal, "metadata_signal"), F.when(F.size(regions) > 0, "phi_detector"))
    )


def video_metrics(obs: DataFrame, video: str, seconds: Column) -> DataFrame:
    """Counts, regions, sources, confidences and rates of a video's observations."""
    conf = F.when(F.col("ocr_confidence").between(0.0, 1.0), F.col("ocr_confidence"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_tags"))))
    out = obs.groupBy(video).agg(
        F.count("*").alias("sampled_frame_count"), F.count_if("metadata_signal").alias("metadata_signal_frame_count"), F.count_if(X.nonblank(F.col("ocr_text"), X.PAPER_BLANK)).alias("ocr_text_frame_count"),
        F.count_if("is_sensitive").alias("sensitive_frame_count"), F.coalesce(F.sum(F.size("phi_regions")), F.lit(0)).cast("bigint").alias("phi_region_proposal_count"), F.array_join(tags, ",").alias("detector_sources"),
        F.round(F.avg(conf), 6).alias("mean_ocr_confidence"), F.max(conf).alias("max_ocr_confidence"),
    )
    return out.withColumn("sampled_frame_throughput_fps", F.when(seconds > 0, F.round(F.col("sampled_frame_count") / seconds, 6)))


def populated(m: dict[str, Column]) -> Column:
    """Names of the fields that aren't blank, in the order given."""
    return F.array_compact(F.array(*[F.when(X.nonblank(c.cast("string"), X.PAPER_BLANK), F.lit(k)) for k, c in m.items()]))


def distinct_lines(texts: DataFrame, key: str, text: str, most: int = 1500) -> DataFrame:
    """(key, lines): the first of each line, compared by letters and digits, joined and cut."""
    rows = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", X.strip(F.col("line")))
    rows = rows.withColumn("k", F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}]", "")).where((F.length("line") >= 4) & (F.col("k") != ""))
    # one exchange: rows of one key are together for both groupings
    rows = rows.repartition(key).groupBy(key, "k").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.left(F.array_join(lines, " | "), F.lit(most)).alias("lines"))


def llm_candidates(frames: DataFrame, video: str, frame: str, text: str, conf: str, least: int, most: int = 2) -> DataFrame:
    """(video, rank, text): distinct texts of enough length by confidence and length, the best ``most`` (T5, F11, ST7)."""
    c = X.strip(F.col(text))
    rows = frames.select(video, frame, c.alias("text"), F.col(conf).alias("conf"), X.dedup_key(c).alias("k")).where(F.length("k") >= max(1, least))
    order = [F.desc("conf"), F.desc(F.length("text")), F.col(frame)]
    rows = rows.withColumn("__same", F.row_number().over(W.partitionBy(video, "k").orderBy(*order))).where("__same = 1")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(video).orderBy(*order))).where(F.col("rank") <= most).select(video, "rank", "text")


def candidate_ok(m: dict[str, Column], source: Column) -> Column:
    """A model's record is borne out by its text (F10): names short, without titles, ages or narrative, each part in the text; the case number in it."""
    bad = rf"(?i)(?:\A|[^{X.WORD}])(?:herrn?|frau|fru|monsieur|madame|dr|prof|professor|ing|[0-9]{{1,3}}\s*jahre?|screening|beschwerden|befund|patient|gastroskopie|koloskopie)(?:[^{X.WORD}]|\z)"
    flat = F.regexp_replace(F.lower(source), "[^a-z0-9]", " ")

    def name(c: Column) -> Column:
        t = X.strip(c)
        return F.when(c.isNull(), True).when((t == "") | t.rlike(bad) | (F.length(t) > 40), False).otherwise(F.forall(X.tokens(F.lower(t)), lambda w: F.contains(flat, w)))

    tight = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    case = F.when(m["casenumber"].isNull(), True).otherwise((tight(m["casenumber"]) != "") & F.contains(tight(source), tight(m["casenumber"])))
    return has_signal(m) & name(m["first_name"]) & name(m["last_name"]) & case


def cache_stats(calls: DataFrame, key: str, order: str) -> DataFrame:
    """One row: calls whose content came before, and the others (A24, ST6)."""
    seen = F.row_number().over(W.partitionBy(F.md5(key)).orderBy(order)) > 1
    out = calls.select(seen.alias("hit")).agg(F.count_if("hit").alias("hit_count"), F.count_if(~F.col("hit")).alias("miss_count"))
    return out.withColumn("hit_rate", F.round(ratio(F.col("hit_count"), F.col("hit_count") + F.col("miss_count")), 6))


def top_texts(frames: DataFrame, group: str, order: str, text: str, conf: str, k: int = 5, min_conf: float = 0.6, min_len: int = 10, sensitive: Column | None = None) -> DataFrame:
    """(group, rank, order, score): the k best admitted texts of a group."""
    c = F.col(text)
    rows = frames.withColumn("score", F.round(X.quality_score(c, F.col(conf)), 6))
    admit = (F.col(conf) >= min_conf) & (F.length(c) >= min_len) & (F.col("score") >= 0.25)
    rows = rows.where((c != "") & (admit if sensitive is None else (admit | sensitive)))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), F.col(order)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "rank", order, "score")


def reservoir(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of n rows that is the same on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def candidate_rank(text: Column, conf: Column) -> Column:
    """Sort key of readings of one region, the least is the best (T4)."""
    gib = F.when((text != "") & X.is_gibberish(text), 1).otherwise(0)
    return F.struct(F.when(text == "", 1).otherwise(0).alias("empty"), gib.alias("gibberish"), F.round(X.gibberish_score(text), 9).alias("score"), (-conf).alias("conf"), (-F.length(text)).alias("len"))


def best_engine(readings: DataFrame, key: str, engine: str, text: str, score: str, percent: Sequence[str] = ("tesseract",), order: Sequence[str] = ("tesseract", "trocr", "donut"), short: int = 20) -> DataFrame:
    """(key, engine, text): the engine of the best normalised score, the first on ties; a text under ``short`` characters gives way to the longest lines of all engines.

    With ``short`` 0 the text is always the chosen engine's own.
    """
    s = F.least(F.lit(1.0), F.when(F.col(engine).isin(*percent), F.col(score) / 100.0).otherwise(F.col(score)))
    place = F.array_position(F.array(*[F.lit(e) for e in order]), F.col(engine))
    if short <= 0:
        best = readings.groupBy(key).agg(F.min_by(F.struct(F.col(engine).alias("engine"), F.col(text).alias("text")), F.struct((-s).alias("s"), place.alias("place"))).alias("r"))
        return best.select(key, "r.engine", "r.text")
    rows = readings.select(key, F.struct((-s).alias("s"), place.alias("place"), F.col(engine).alias("engine"), F.col(text).alias("text"), F.split(text, "\n").alias("lines")).alias("r"))
    best = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"))
    some = F.filter("r", lambda x: F.trim(x["text"]) != "")
    base = F.array_sort(F.transform(some, lambda x: F.struct((-F.size(x["lines"])).alias("n"), x["place"].alias("p"), x["lines"].alias("lines"))))
    lines = F.get(base, F.lit(0))["lines"]

    def pick(line: Column, i: Column) -> Column:
        same = F.transform(base, lambda x: F.coalesce(F.get(x["lines"], i), F.lit("")))
        return F.when(F.trim(line) == "", "").otherwise(F.aggregate(same, line, lambda a, b: F.when(F.length(F.trim(b)) > F.length(F.trim(a)), b).otherwise(a)))

    joined = F.coalesce(F.array_join(F.transform(lines, pick), "\n"), F.lit(""))
    top = F.get(F.col("r"), F.lit(0))
    chosen = F.when((F.length(F.trim(top["text"])) < short) & (F.length(F.trim(joined)) > F.length(F.trim(top["text"]))), joined).otherwise(top["text"])
    return best.select(key, top["engine"].alias("engine"), chosen.alias("text"))


def words_to_text(words: DataFrame, page: str, line: Sequence[str], least: float = 0.0) -> DataFrame:
    """(page, text, n_words, x1..y2, mean_conf): kept words joined by line, lines in the order of their first word."""
    conf = F.least(F.col("conf").try_cast("double"), F.lit(100.0))
    rows = words.withColumns({"text": F.trim("text"), "conf": conf}).where((F.col("text") != "") & (F.col("conf") >= max(0.0, least)))
    lines = rows.groupBy(page, *line).agg(
        F.min("pos").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("t"), F.count("*").alias("n"), F.sum(F.when(F.col("conf") > 0, F.col("conf"))).alias("c"),
        F.count_if(F.col("conf") > 0).alias("nc"), F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.greatest("w", F.lit(0))).alias("x2"), F.max(F.col("y") + F.greatest("h", F.lit(0))).alias("y2"),
    )
    return lines.groupBy(page).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda w: w["t"]), "\n").alias("text"), F.sum("n").alias("n_words"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.round(ratio(F.sum("c"), F.sum("nc")) / 100.0, 6).alias("mean_conf"),
    )


def merge_chunks(chunks: DataFrame, page: str) -> DataFrame:
    """(page, text) of overlapping tiles read top down: four words and more that an earlier tile has are cut from the head."""
    kind = dict(chunks.dtypes)[page]

    def join(texts) -> str:
        import re

        kept: list[str] = []
        for text in texts:
            if not text or not text.strip():
                continue
            for old in kept:
                words, low = text.split(), old.lower()
                n_old = len(old.split())
                if len(words) < 5 or n_old < 5:
                    continue
                same = max([k + 1 for k in range(min(15, len(words), n_old)) if " ".join(words[: k + 1]).lower() in low], default=0)
                if same > 3:
                    text = " ".join(words[same:])
            if text.strip():
                kept.append(text)
        return re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", "\n\n".join(kept)))

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[join([b["text"] for b in xs]) for xs in pdf["b"]])[[page, "text"]]

    lists = chunks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "text"))).alias("b"))
    return lists.mapInPandas(run, f"{page} {kind}, text string")
