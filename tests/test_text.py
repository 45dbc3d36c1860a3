"""Text functions on literal cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilframe.functions import extract as E
from veilframe.functions import fuzzy as Z
from veilframe.functions import text as X


def run(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_normal_form(spark):
    got = run(spark, ["Patient:::   Müller", "E 15702/2024  09:53:32", "abc....,,,:::", "äöüß -- ok", None, "", "(a)+[b]@"], X.normalize_overlay(F.col("t")))
    assert [x[0] for x in got] == ["Patient: Müller", "E 15702/2024 09:53:32", "abc.", "äöüß  ok".replace("  ", " "), None, "", "a[b]@"]


def test_noise(spark):
    values = ["##@@", "Patient Müller", "09:53:32", "E 15702/2024", "zzzx qwrty", "", None, "ab"]
    got = run(spark, values, X.is_gibberish(F.col("t")), X.structured_strict(F.col("t")), X.gibberish_score(F.col("t")))
    assert [g[0] for g in got] == [True, False, False, False, True, True, True, True]
    assert [g[1] for g in got] == [False, False, True, True, False, False, False, False]
    assert got[5][2] == got[6][2] == 1.0 and got[1][2] == 0.0


def test_repair():
    text = "A r z t : E v a K l e e\nD O B : 1 9 8 7 - 0 6 - 0 5\n@@@"
    assert Z.repair_text(text) == "Arzt: Eva Klee\nDOB: 1987-06-05"
    assert Z.repair_text("") == "" and Z.repair_text(None) is None


def test_similarities():
    assert Z.indel_ratio("abc", "abd") == pytest.approx(2 / 3)
    assert Z.indel_ratio("", "") == 1 and Z.indel_ratio("a", "") == 0
    assert Z.token_sort_ratio("doe john", "john doe") == 1
    assert Z.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert Z.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.8133, abs=1e-4)
    assert Z.jaro_winkler("Patient John Doe", "Patlent John Doe") > 0.5


def test_json_object():
    assert Z.first_object('<think>x {"no": 1}</think>```json\n{"a": {"b": "}"}} tail\n```') == '{"a": {"b": "}"}}'
    assert Z.first_object('<think> open {"a": 1}') == '{"a": 1}'
    assert Z.first_object("none") == "none" and Z.first_object(None) is None


ROLES = [
    ("09/11/2023 08:12:05 Muster, Max ID 7 05/06/1987", "1987-06-05", "2023-11-09"),
    ("DOB: 05.06.1987 Untersuchung: 09.11.2023", "1987-06-05", "2023-11-09"),
    ("Untersuchung: 09-11-2023 geboren: 05-06-1987", "1987-06-05", "2023-11-09"),
    ("09.11.2023 08:12:05", None, "2023-11-09"),
    ("Geburtsdatum: 05.06.1987", "1987-06-05", None),
    ("DOB: 05.06.1987 Date: 05.06.1987", "1987-06-05", None),
    ("09 11 2023 08:12:05 Muster, Max 05 06 1987", "1987-06-05", "2023-11-09"),
    ("no dates", None, None),
    ("99.99.2023", None, None),
]


def test_date_roles(spark):
    got = run(spark, [r[0] for r in ROLES], E.date_roles(F.col("t"))["dob"].cast("string"), E.date_roles(F.col("t"))["exam"].cast("string"))
    assert got == [r[1:] for r in ROLES]


def test_dates(spark):
    ok = ["2024-01-31", "31.01.2024", "31.01.24", "31/01/2024", "31-01-2024", "2024/01/31"]
    got = run(spark, [*ok, "01-31-2024", "", None, "x"], E.any_date(F.col("t")))
    assert [g[0] for g in got] == [dt.date(2024, 1, 31)] * 6 + [None] * 4
    assert run(spark, ["1.2.49", "1.2.50"], E.german_date(F.col("t"))) == [(dt.date(2049, 2, 1),), (dt.date(1950, 2, 1),)]
    assert run(spark, ["01021999", "1 2 70", "1.2.68"], E.report_date(F.col("t"))) == [(dt.date(1999, 2, 1),), (dt.date(1970, 2, 1),), (dt.date(2068, 2, 1),)]


def test_names_and_lines(spark):
    first, last = E.patient_name(F.col("t"))
    assert run(spark, ["Patient: Doe, Jane", "Name: Jane Doe", "nothing here"], first, last) == [("Jane", "Doe"), ("Jane", "Doe"), (None, None)]
    line = E.examination_line(F.col("t"))
    got = run(spark, ["1. Unters.: Dr. Meier, Eva U-datum: 01.02.2024 10:15", "Eingang am: 03.02.2024", "x"], line["examiner_last_name"], line["examiner_first_name"], line["examination_date"], line["examination_time"])
    assert got == [("Meier", "Eva", dt.date(2024, 2, 1), "10:15"), (None, None, dt.date(2024, 2, 3), None), (None, None, None, None)]
    f = E.patient_fallback(F.col("t"))
    assert run(spark, ["Patientin: Muster, Erika geb. 01.02.1960 bla Fallnr.: 77", "Pat.: Muster, Max", "x"], f["first_name"], f["last_name"], f["casenumber"], f["gender"]) == [("Erika", "Muster", "77", "female"), ("Max", "Muster", None, None), (None,) * 4]
    assert run(spark, ["- first_name: Jane\n- last_name: unknown\n- dob: 01.02.1960"], E.key_values(F.col("t"))) == [({"first_name": "Jane", "dob": "1960-02-01"},)]
    assert run(spark, ["30000/1001", "25", "0/0", "N/A", None], F.round(E.frame_rate(F.col("t")), 3)) == [(29.97,), (25.0,), (None,), (None,), (None,)]
    assert run(spark, ["Arzt: Schulze Meier x1", "Dr. - - -"], *E.examiner(F.col("t")))[1] == (None, None)


def test_word_edit_distance(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.word_edit_distance(F.col("a"), F.col("b"))).collect()] == [2, 1, 0]


def test_blank_words(spark):
    got = run(spark, ["n/a", " Unknown ", "NaN", "-", "x", None, ""], X.scalar(F.col("t")), X.nonblank(F.col("t")))
    assert [g[0] for g in got] == ["", "", "", "", "x", "", ""]
    assert [g[1] for g in got] == [False, False, True, False, True, False, False]


def test_cutoffs_chunks_and_names(spark):
    c = F.col("t")
    assert run(spark, ["head\nPatient: x\nbody\n____\nfoot"], X.cut_above(c, ["Patient: "]), X.cut_below(c, ["____"])) == [("Patient: x\nbody\n____\nfoot", "head\nPatient: x\nbody\n____")]
    assert run(spark, ["abcdefg", "", None], X.chunks(c, 3)) == [(["abc", "def", "g"],), ([],), ([],)]
    assert run(spark, ["a b/ü.png", "", None], X.safe_name(c)) == [("a_b_.png",), ("frame",), ("frame",)]
    assert run(spark, ["Dr. med. Anna-Lena Müller"], X.strip_titles(c), X.fold_umlauts(c), X.fold_ascii(c)) == [("anna lena müller", "Dr. med. Anna-Lena Mueller", "Dr. med. Anna-Lena Muller")]


def test_text_similarity_query_equals_brute_force(spark, tmp_path):
    import re

    from veilframe.plans import catalog

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = ["Hallo Welt, das ist ein Text.", "Hallo Welt das war ein längerer Text, der weit hinter achtzig Zeichen noch anders ist als zuvor!", "Hallo Welt das war ein längerer Text, der weit hinter achtzig Zeichen noch anders ist als danach!", "", "kurz"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.turn: x.similarity for x in catalog.QUERIES["text_similarity"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k in (1, 2):
        a, b = (" ".join(texts[i].split()) for i in (k, k - 1))
        aw, bw = (re.findall(r"\w+", x.lower()) for x in (a, b))
        want = 1 - (distance(a, b) / max(len(a), len(b)) + distance(aw, bw) / max(len(aw), len(bw))) / 2
        assert abs(got[k] - want) < 1e-5
    assert got[3] == 0 and got[4] == 0 and got[2] < 1


def test_edit_distance_of_long_texts(spark):
    import random
    import time

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcß", k=rng.randrange(40))) for _ in range(2))
        assert Z.edit_distance(a, b) == plain(a, b)
    # thousands of words: the distance of words was quadratic with a large factor, as each word read both texts again
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x1", "Ü"], k=4000)) for _ in range(8)]
    df = spark.createDataFrame(list(zip(texts[::2], texts[1::2])), "a string, b string").coalesce(1)
    start = time.time()
    got = df.select(X.text_similarity(F.col("a"), F.col("b"))).collect()
    assert time.time() - start < 30 and all(0 < r[0] < 1 for r in got)


def test_counts_by_pattern_equal_plain_counts(spark):
    import re

    values = ["", "a", "Der Aal, ein Tier! xyz zzz AAA aa", "äÖ§•—‚x 12:30  12345678", "b c dd ÄÄÄ\tfgh—ij", "zz\n\nq1w2 e r t", "日本 語 ñandú", "Patient: Müller… (ok)"]
    words = [re.findall(f"[^{X.SP}]+".replace(r"\p{Z}", " 　"), v) for v in values]
    latin = [re.findall(f"[{X.LATIN}]{{2,}}", v) for v in values]
    got = run(spark, values, X.count_of(F.col("t"), X.HARD_MARKS), X.count_hits(F.col("t"), X._WORDS), X.count_hits(F.col("t"), X._VOICED), X.count_hits(F.col("t"), X._LONE), X.count_hits(F.col("t"), X._READABLE), F.size(X._readable(X.latin_words(F.col("t")))))
    for v, w, lw, g in zip(values, words, latin, got):
        long = [x for x in w if len(x) > 1]
        lone = sum(map(len, re.findall(f"[{X.LATIN}]", v))) - sum(map(len, lw))
        assert g[:5] == (len(re.findall(f"[{X.HARD_MARKS}]", v)), len(long), sum(bool(re.search(X.VOWEL, x)) for x in long), lone, sum(len(x) > 2 and len(set(x)) > 1 for x in lw)) and g[5] == g[4], v
    # folding and file names, with runs at the cut
    names = ["x" * 179 + "  " * 9 + "y", "é" * 400, "--ä" * 300, "ok.txt"]
    want = [re.sub("[^A-Za-z0-9_.-]+", "_", v)[:180].strip("_") or "frame" for v in names]
    assert [r[0] for r in run(spark, names, X.safe_name(F.col("t")))] == want
    assert run(spark, ["Ärger à la ÿ†", "plain"], X.fold_ascii(F.col("t")), X.fold_umlauts(F.col("t"))) == [("Arger a la y", "AErger à la ÿ†"), ("plain", "plain")]


def test_classes_are_tables_for_java():
    import re

    for c in (X.HARD_MARKS, X.STANDARD, X.LATIN, r"\s.\-", r"A-Z\]x", "/-Äö"):
        a, b = (re.compile(f"[{x}]") for x in (c, X._members(c)))
        assert all(bool(a.match(chr(k))) == bool(b.match(chr(k))) for k in range(0x2100))
    assert X._members("•a-c!").startswith(r"\x21\x61\x62\x63")


def test_each_pattern_of_sensitive_spans_once(spark):
    from veilframe.functions import sensitive as N
    from veilframe.operators import redact

    df = spark.createDataFrame([("Frau Meier, Anna wohnt Lange Straße 5, Fallnr: 77 am 01.02.2024",), ("nichts",), (None,)], "t string")
    spans = df.select(N.spans(F.col("t")).alias("x"))
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= len(set(N.PATTERNS.values()))
    got = [{s.kind: s.found for s in r.x or []} for r in spans.collect()]
    assert got[0]["last_name"] == got[0]["first_name"] == ["Meier, Anna"] and got[0]["address"] == ["Anna wohnt Lange Straße 5"] and got[0]["casenumber"] == ["Fallnr: 77"] and got[1] == {"examiner_first_name": ["nichts"], "examiner_last_name": ["nichts"]} and got[2] == {}
    marks = df.select(redact.pii_redact(F.col("t")).alias("r"), *[c.alias(k) for k, c in redact.pii_counts(F.col("t")).items()]).collect()
    assert marks[0].n_sensitive == 4 and marks[0].r == "Frau Meier, [ADDRESS], [CASE] am [DATE]" and marks[1].r == "nichts" and marks[1].n_email == 0 and marks[2].r is None and marks[2].n_email is None
