"""Keyed state over streams of frames: fill-only records, early stop, caps, best texts.

Each processor keeps one small record a key, so state grows with the number of keys.  Rows of
a micro-batch are taken in order of the frame number; across batches they count in the order
of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.frames import FIELDS
from ..sources import shared

STATE = "record string, seen int, done boolean"


def _blank(v) -> bool:
    return v is None or v != v or str(v).strip().lower() in X.FRAME_BLANK


def fill(record: dict, row: dict) -> dict:
    """The record with the row's values in its blanks; the later of two dates is the examination."""
    out = {f: record.get(f) if not _blank(record.get(f)) else (None if _blank(row.get(f)) else row[f]) for f in FIELDS}
    return out


def ordered(record: dict) -> dict:
    a, b = record.get("dob"), record.get("examination_date")
    return {**record, "dob": b, "examination_date": a} if a and b and b < a else record


def is_complete(r: dict) -> bool:
    f, n, d, c, e = (not _blank(r.get(k)) for k in FIELDS)
    return (f and n and d) or (f and n and c and e) or ((f or n) and d and c)


def final_states(frames: DataFrame, key: str, order: str, cap: int = -1) -> DataFrame:
    """(key, fields.., frames_processed) after each micro-batch in which the key's record changed (ST3, W5, W6, ST7).

    Rows after the record is complete, or beyond ``cap`` (negative: no cap), don't count.
    """
    kind = dict(frames.dtypes)[key]
    schema = f"{key} {kind}, {', '.join(f'{f} string' for f in FIELDS)}, frames_processed int"

    def run(k, batches, state):
        text, seen, done = state.get if state.exists else ("{}", 0, False)
        record = json.loads(text)
        before = seen
        rows = pd.concat(list(batches))
        for row in rows.sort_values(order, kind="stable").to_dict("records"):
            if done or (0 <= cap <= seen):
                break
            record, seen = fill(record, row), seen + 1
            done = is_complete(record)
        state.update((json.dumps(record), seen, done))
        if seen != before:
            yield pd.DataFrame([{key: k[0], **ordered(record), "frames_processed": seen}])

    cols = [c for c in frames.columns if c in (key, order, *FIELDS)]
    return frames.select(*cols).groupBy(key).applyInPandasWithState(run, schema, STATE, "update", "NoTimeout")


def top_texts(frames: DataFrame, key: str, order: str, text: str, score: str, k: int = 5) -> DataFrame:
    """(key, best: array of texts) by falling score, the earlier first on ties, after each micro-batch (ST4)."""
    kind = dict(frames.dtypes)[key]

    def run(group, batches, state):
        kept = json.loads(state.get[0]) if state.exists else []
        for rows in batches:
            kept += [[-float(s), int(o), t] for s, o, t in zip(rows[score], rows[order], rows[text])]
        kept = sorted(kept)[:k]
        state.update((json.dumps(kept),))
        yield pd.DataFrame([{key: group[0], "best": [t for *_, t in kept]}])

    return frames.select(key, order, text, score).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, best array<string>", "kept string", "update", "NoTimeout")


def text_frames(frames: DataFrame, text: str) -> DataFrame:
    """Frames with text (ST2)."""
    return frames.where(F.trim(text) != "")


def strided(frames: DataFrame, frame: str, stride: int) -> DataFrame:
    """Every ``stride``-th frame (ST1)."""
    return frames.where(F.pmod(F.col(frame), F.lit(stride)) == 0)


def first_seen(frames: DataFrame, key: str, content: str, ts: str, keep: str = "1 day") -> DataFrame:
    """The first frame of each content of a key, remembered for ``keep`` of event time (ST5)."""
    return frames.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key, content])


def hourly(events: DataFrame, ts: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling hour; an extension, as the reference has no event-time windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """The last update of each key after streaming a batch table through ``build``.

    The table is written to the cluster's shared folder and read as a stream; each
    micro-batch of updates is appended there, and the last one of each key is returned.
    """
    spark = rows.sparkSession
    folder = shared.folder(spark)
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")

    def save(df: DataFrame, n: int) -> None:
        df.withColumn("__batch", F.lit(n).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/n={n}")

    q = build(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out").drop("n")
    cols = [c for c in out.columns if c != "__batch"]
    return out.groupBy(key).agg(F.max_by(F.struct(*cols), "__batch").alias("r")).select("r.*")
