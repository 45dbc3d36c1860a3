"""License scans against a brute-force Dice coefficient."""

import random
import re

import pyarrow as pa
import pytest

from veilframe.llm import licenses as L


def pairs(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return set(zip(w, w[1:])) if len(w) > 1 else {(x,) for x in w}


def score(parts, templates, limit):
    a = pairs(" ".join(parts))
    if not a:
        return None
    best = max((2 * len(a & pairs(t)) / (len(a) + len(pairs(t))), [-ord(c) for c in n], n)[::2] for n, t in sorted(templates.items()))
    return best[0] if best[0] >= limit else None


def brute(text, templates, limit):
    lines = text.split("\n")
    blocks = []
    for k, x in enumerate(lines):
        if pairs(x):
            if not (blocks and blocks[-1][-1][0] == k - 1):
                blocks.append([])
            blocks[-1].append((k, x))
        sentences = [y for y in re.split(r"[.!?][ \t\r]", x) if pairs(y)]
        for y in [x, *(sentences if len(sentences) > 1 else [])]:
            if (s := score([y], templates, limit)) is not None:
                yield (0 if y is x else 3), k, 1, s
    most, found = max((len(t.split()) for t in templates.values()), default=0) * (2 - limit) / limit, []
    for i in range(len(blocks)):
        for j in range(i, len(blocks)):
            parts = [x for b in blocks[i : j + 1] for _, x in b]
            if i == j or len(" ".join(re.findall(r"[^\W_]+", " ".join(parts))).split()) <= most:
                if (s := score(parts, templates, limit)) is not None:
                    found.append((-s, i, j))
                    if i == j and len(blocks[i]) > 1:
                        yield 1, blocks[i][0][0], len(blocks[i]), s
    found.sort()
    for k, (s, i, j) in enumerate(found):
        if i < j and not any(a <= j and i <= b for _, a, b in found[:k]):
            yield 2, blocks[i][0][0], blocks[j][-1][0] - blocks[i][0][0] + 1, -s


def test_equals_brute_force():
    r = random.Random(7)
    names = list(L.TEMPLATES)
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(r.randint(1, 8)):
            w = r.choice([L.TEMPLATES[r.choice(names)], "Plain words of no licence here.", "", ""]).split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = "changed"
            cut = r.randint(0, max(0, len(w) - 1)) if r.random() < 0.3 else len(w)
            lines += [" ".join(w[:cut]), " ".join(w[cut:])] if cut < len(w) else [" ".join(w)]
        texts.append("\n".join(lines))
    known = L.Templates(L.TEMPLATES)
    got = [(d, k, a, n, round(s, 6)) for d, k, a, n, _, s, _ in L.scan_texts(pa.array(texts), known, 0.75)]
    want = [(d, k, a, n, round(s, 6)) for d, t in enumerate(texts) for k, a, n, s in brute(t, L.TEMPLATES, 0.75)]
    assert sorted(got) == sorted(want)


def test_cases(spark):
    kind = "doc_id long, text string, unit string, dice int"
    docs = spark.createDataFrame([(1, "Text.\n\nReleased under the MIT License.", "", 0), (2, None, "", 0), (3, "", "", 0), (4, "...\n!!", "", 0), (None, "Licensed under CC BY 4.0.", "", 0)], kind)
    got = {(x.doc_id, x.unit, x.first_line, x.license, x.dice) for x in L.scan(docs).collect()}
    assert got == {(1, 0, 2, "MIT notice", 1.0), (None, 0, 0, "CC-BY-4.0 notice", 1.0)}
    assert L.scan(spark.createDataFrame([], kind)).count() == 0
    assert L.scan(docs, {}).count() == 0


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0 header"])
def test_long_licence_over_lines(spark, name):
    w = L.TEMPLATES[name].split()
    text = "Intro\n\n" + "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) + "\n\nCode"
    got = L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).where("unit = 1").collect()
    assert [(x.license, x.dice) for x in got] == [(name, 1.0)]


def rows_of(spark, text):
    return [(x.unit, x.license, round(x.dice, 2)) for x in L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]


def paragraphs(name, *starts):
    """A template with its paragraphs apart, each in lines."""
    t = L.TEMPLATES[name]
    at = [0, *(t.index(s) for s in starts), len(t)]
    w = [t[a:b].split() for a, b in zip(at, at[1:])]
    return "\n\n".join("\n".join(" ".join(x[k : k + 11]) for k in range(0, len(x), 11)) for x in w)


def test_real_layouts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Foo Bar\n\n" + paragraphs("MIT", "The above copyright", "THE SOFTWARE IS") + "\n"
    assert (2, "MIT", 1.0) in rows_of(spark, mit)
    apache = "Copyright 2020 Foo Bar\n\n" + paragraphs("Apache-2.0 header", "http://", "Unless required")
    gpl = paragraphs("GPL-3.0 header", "This program is distributed", "You should have")
    bsd = "Copyright (c) 2020, Foo\n\n" + paragraphs("BSD-3-Clause", "Redistributions of", "Redistributions in", "Neither the", "THIS SOFTWARE")
    for text, name in ((apache, "Apache-2.0 header"), (gpl, "GPL-3.0 header"), (bsd, "BSD-3-Clause")):
        for mark in ("", "# ", " * ", "// "):
            marked = "\n".join((mark + x).rstrip() for x in text.split("\n"))
            assert (2, name, 1.0) in rows_of(spark, marked), (name, mark)
    assert (3, "MIT notice", 1.0) in rows_of(spark, "Copyright (c) 2020 Foo Bar. Released under the MIT License.")
    assert rows_of(spark, "All rights reserved.") == [(0, "All rights reserved", 1.0)]


def test_very_long_text(spark):
    text = "\n\n".join(["Plain words of no licence here."] * 50_000 + [paragraphs("MIT", "The above copyright", "THE SOFTWARE IS")])
    assert (2, "MIT", 1.0) in rows_of(spark, text)
