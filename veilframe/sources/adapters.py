"""Seams for what isn't relational: readers, detectors, models, codecs.

An adapter turns rows with bytes or text into rows of a fixed schema.  The engine bundles no
models: a deployment passes a function from one item to its rows, and this module runs it over
batches, with errors as rows of status ``failed``.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame

#: What each kind of adapter returns for an item, besides its key.
WORDS = "page int, pos int, text string, conf double, x int, y int, w int, h int, block int, par int, line int"
REGIONS = "page int, x1 int, y1 int, x2 int, y2 int, score double, class_id int"
METADATA = "first_name string, last_name string, dob string, casenumber string, gender string, examination_date string, examination_time string, examiner_first_name string, examiner_last_name string"
PAGES = "page int, content binary, width int, height int"
TEXT = "page int, text string"
ELEMENTS = "path string, tag string, vr string, keyword string, is_private boolean, value string"
FRAMES = "frame int, ts double, content binary, width int, height int"
IMAGE = "content binary"
OUTPUT = "output string, ok boolean"
CONTRACTS = {"ocr": WORDS, "detector": REGIONS, "llm": METADATA, "pdf_pages": PAGES, "pdf_text": TEXT, "dicom": ELEMENTS, "video": FRAMES, "image": IMAGE, "ffmpeg": OUTPUT, "ner": "start int, stop int, label string, text string"}


def apply(rows: DataFrame, key: str, value: str, contract: str, make: Callable[[], Callable[[object], Iterable[tuple]]]) -> DataFrame:
    """(key, contract's columns.., status, error) of every row; an item without results has one row of nulls.

    ``make`` runs once a partition, on the executor: it loads the model and returns the function.
    """
    fields = CONTRACTS[contract]
    names = [f.split()[0] for f in fields.split(", ")]
    kind = dict(rows.dtypes)[key]
    whole = f"{key} {kind}, {fields}, status string, error string"

    def run(batches):
        f = make()
        for pdf in batches:
            out = []
            for k, v in zip(pdf[key], pdf[value]):
                try:
                    found = [tuple(x) for x in f(v)]
                    out += [(k, *x, "ok", None) for x in found] or [(k, *[None] * len(names), "ok", None)]
                except Exception:
                    out.append((k, *[None] * len(names), "failed", traceback.format_exc(limit=1)[-300:]))
            yield pd.DataFrame(out, columns=[key, *names, "status", "error"]).astype(object)

    return rows.select(key, value).mapInPandas(run, whole)
