"""Secret scans: held-out accuracy, brute force, whole texts, cases."""

import random
import re
import string
import uuid

import pyarrow as pa

from veilframe.llm import secrets as S

KIND = "doc_id long, text string, n_chars long, llr string"


def test_held_out_accuracy():
    table = S.train(S.labelled_samples(seed=11))
    held = [(s, y) for s, y in S.labelled_samples(1500, seed=99) if len(s) >= S.MIN_LENGTH]
    hit = {d for d, *_ in S.find(pa.array([s for s, _ in held]), table)}
    keys = [k for k, (_, y) in enumerate(held) if y]
    plain = [k for k, (_, y) in enumerate(held) if not y]
    assert sum(k in hit for k in keys) / len(keys) > 0.97
    assert sum(k in hit for k in plain) / len(plain) < 0.02


def test_best_stretch_equals_brute_force():
    r = random.Random(4)
    for _ in range(200):
        x = [r.choice([-2.0, -1.0, 0.5, 1.0, 1.5]) for _ in range(r.randint(5, 30))]
        best = max((sum(x[a:b]), -a, b) for a in range(len(x)) for b in range(a + 5, len(x) + 1))
        a, b, s = S.best_stretch(x, 5)
        assert abs(s - best[0]) < 1e-9 and b - a >= 5 and abs(sum(x[a:b]) - s) < 1e-9


def test_redaction(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    text = f'Größe: token = "{key}" and path /usr/share/documentation/examples/configuration_reference end'
    docs = spark.createDataFrame([(1, text, 3, "x"), (2, "An ordinary sentence about internationalization and responsibility.", 1, ""), (3, None, None, ""), (4, "", 0, ""), (None, key, 1, ""), (1, text, 3, "x"), (5, "word " * 30000 + key, 1, "")], KIND)
    got = S.redact(docs).collect()
    assert len(got) == 7
    by = {x.doc_id: x for x in got}
    assert by[1].text == text.replace(key, S.MARK) and by[1].n_chars == len(by[1].text)
    assert by[2].text.startswith("An ordinary") and by[3].text is None and by[4].text == ""
    assert by[None].text == S.MARK and by[5].text.endswith(S.MARK) and key not in by[5].text
    spans = {(x.doc_id, x.start_char, x.end_char) for x in S.scan(docs).collect()}
    at = text.index(key)
    assert (1, at, at + len(key)) in spans and not any(d in (2, 3, 4) for d, *_ in spans)
    assert S.scan(spark.createDataFrame([], KIND)).count() == 0


def test_every_key_of_one_run(spark):
    keys = ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "Zk3Qx81LpVb7RtY2", "X7QZP3LK9WV2MJ4T8RBN"]
    calm = "_configuration_reference_documentation_repository_environment_understanding_administration_password="
    runs = {2: keys[0] + calm + keys[1], 3: keys[1] + calm + keys[2] + calm + keys[0], 1: calm + keys[2]}
    docs = spark.createDataFrame([(n, f"Größe {t} end", 1, "") for n, t in runs.items()], KIND)
    got = {}
    for x in S.scan(docs).collect():
        got.setdefault(x.doc_id, []).append((x.start_char, x.end_char))
    for n, t in runs.items():
        text = f"Größe {t} end"
        places = sorted((text.index(k), text.index(k) + len(k)) for k in keys if k in text)
        assert len(got[n]) == len(places) and all(a <= i and j <= b for (a, b), (i, j) in zip(sorted(got[n]), places))
    for x in S.redact(docs).collect():
        assert x.text.count(S.MARK) == x.doc_id and not any(k in x.text for k in keys)


def brute(text, table, limit=S.LIMIT, least=S.MIN_LENGTH):
    """Spans of all secrets, trying every stretch of every run."""
    out = []
    for run in re.finditer(r"[A-Za-z0-9+/=_-]{%d,}" % least, text):
        raw = run.group().encode()
        llr = [float(table[([0, *raw])[k], c]) for k, c in enumerate(raw)]
        rest = [(0, len(raw))]
        while rest:
            lo, hi = rest.pop()
            best = None
            for b in range(lo + least, hi + 1):
                total = sum(llr[lo:b])
                for a in range(lo, b - least + 1):
                    if best is None or total > best[0] + 1e-9:
                        best = (total, a, b)
                    total -= llr[a]
            if best is None or best[0] < limit:
                continue
            _, a, b = best
            a = lo + re.search(rb"[A-Za-z0-9]*$", raw[lo:a]).start() if raw[lo:a] else a
            b += re.match(rb"[A-Za-z0-9]*", raw[b:hi]).end()
            if re.fullmatch(rb"[0-9A-Fa-f-]+", raw[a:b]):
                b += re.match(rb"(-[0-9A-Fa-f]{4,}(?![A-Za-z0-9]))*", raw[b:hi]).end()
                a = lo + re.search(rb"((?<![A-Za-z0-9])[0-9A-Fa-f]{4,}-)*$", raw[lo:a]).start()
            out.append((run.start() + a, run.start() + b))
            rest += [(lo, a), (b, hi)]
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(6)
    table = S.train(S.labelled_samples())
    key = lambda: "".join(r.choices(string.ascii_letters + string.digits, k=r.randint(16, 40)))
    calm = ["/second_production_database_password_value=", "/usr/share/doc/", "-", "_", "internationalization", "first=", "2024-01-31", "="]
    texts = ["first=" + key() + "/second_production_database_password_value=" + key(), key() + " " + key()]
    for _ in range(60):
        texts.append("".join(r.choice([key, lambda: r.choice(calm), lambda: " ", lambda: str(uuid.UUID(int=r.getrandbits(128)))])() for _ in range(r.randint(1, 7))))
    docs = spark.createDataFrame([(k, t, 0, "") for k, t in enumerate(texts)], KIND)
    got: dict = {k: [] for k in range(len(texts))}
    for x in S.scan(docs).collect():
        got[x.doc_id].append((x.start_char, x.end_char))
    assert sum(map(len, got.values())) > 60
    for k, t in enumerate(texts):
        assert sorted(got[k]) == brute(t, table), t


def test_keys_and_uuids_leave_nothing_behind(spark):
    r = random.Random(7)
    ids = [str(uuid.UUID(int=r.getrandbits(128))) for _ in range(60)]
    docs = spark.createDataFrame([(k, f"id {u} end", 0, "") for k, u in enumerate(ids)], KIND)
    texts = {x.doc_id: x.text for x in S.redact(docs).collect()}
    whole = [k for k in texts if texts[k] == f"id {S.MARK} end"]
    assert len(whole) >= 55 and all(texts[k] == f"id {ids[k]} end" for k in texts if k not in whole)
