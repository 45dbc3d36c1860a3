"""Secret scans: two character Markov models compared by log-likelihood ratio.

One first-order model is trained on labelled random strings (hex, base-62, base-64,
base-32 keys), one on labelled ordinary identifiers, words, numbers, dates and paths.
A candidate is a maximal run of at least ``MIN_LENGTH`` key characters; its first secret
is the stretch of greatest summed log-likelihood ratio, if that reaches ``LIMIT`` nats
over at least ``MIN_LENGTH`` characters, extended to whole alphanumeric pieces, and one of
hexadecimal digits and hyphens on to the hexadecimal pieces that hyphens join to it (the
groups of a UUID).  What is left of the run on either side is searched in the same way until
no stretch reaches the limit.  So each key inside a path or an assignment is found without
its ordinary surroundings.

Cases: null and empty texts have no secrets; rows without an id are scanned (id null);
of stretches with equal sums the one that ends first counts, and of those the longest; each
row is scanned alone, so repeated rows give repeated results; a very long text or run is
scanned whole; an empty table gives no rows; other columns pass through ``redact`` untouched,
whatever their names, but ``n_chars``, which follows the text.
"""

from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .decontaminate import cut_out, replace_text

MIN_LENGTH, LIMIT, MARK = 16, 12.0, "[SECRET]"
SCHEMA = "doc_id long, start_char int, end_char int, llr double"
_KEY = np.zeros(256, bool)
_KEY[list((string.ascii_letters + string.digits + "+/=_-").encode())] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list((string.ascii_letters + string.digits).encode())] = True

_WORDS = """access account action active address admin agent alert alias amount anchor android answer archive array article
assert async attach author available average background backup balance banner base batch before begin between binary block
body border bottom branch bridge browser bucket buffer build bundle button bytes cache callback cancel canvas capture catalog
category center change channel char check child choice class clean client clone close cluster code collect color column command
comment commit common compare compile complete component compress compute condition config confirm connect console constant
container content context control convert cookie copy core count country create current cursor customer daily data database date
debug decimal decode default define delete delivery deploy depth describe design detail device dialog digest direct directory
disable display distance document domain download draft driver during dynamic edge edit element email empty enable encode
encrypt endpoint engine entity entry enum environment error escape estimate event example exception execute exit expand expire
export expression extend external extract factory failure feature fetch field file filter final find first fixed flag float
folder follow font footer force foreign form format forward frame free function future gateway general generate global graph
grid group guide handle handler hash header health height helper hidden history home horizontal host hour icon identifier image
import include index info inherit initial inline input insert inside install instance integer interface internal interval invalid
invoice item iterator join journal json keyboard kind label language large last latest launch layer layout left length level
library license limit line link list listener load local locale location lock logger login loop machine main manager manifest
map margin mask master match material maximum measure media member memory menu merge message metadata method metric middle
minimum mobile mode model module monitor month mouse move multiple name namespace native navigate network next node normal
notification null number object observer offset online open operation operator option order organization origin output override
owner package padding page panel parameter parent parse partition password patch path pattern payment pending percent performance
permission person phone pipeline pixel plain platform player plugin pointer policy pool popup port position post prefix press
preview previous price primary print priority private process product profile program progress project promise property protocol
provider proxy public publish pull push query queue quick random range rate read ready reason receive record recover redirect
reduce reference refresh region register release reload remote remove render repeat replace report repository request require
reserve reset resize resolve resource response restore result resume retry return revision right role root rotate route router
row rule runtime sample save scale schedule schema scope score screen script scroll search second secret section secure security
segment select selector send sequence serial server service session setting setup shadow shape share sheet shift shop short
signal signature simple single size skip slice small snapshot socket sort source space spec speed split stack stage standard start
state static station statistics status step stock stop storage store stream string strip structure student style submit subscribe
success suffix summary support suspend switch symbol sync system table target task team template terminal test text theme thread
threshold ticket time timeout title token toggle tool top total trace track traffic transaction transfer transform transition
translate transport tree trigger type union unique unit unknown unlock update upgrade upload upper user utility valid validate
value variable vector vendor verify version vertical video view virtual visible visit volume wait warning watch weather week
weight widget width window wire word work worker workspace wrapper write year zone
the and that with from this which have were their would there been other more when will could about into than only some these
after over most also between under while where through because against without however something everything understanding
zwischen entwicklung verantwortung gesellschaft wissenschaft universitaet krankenversicherung schreiben berichte ueberpruefung
gouvernement developpement naturellement administration etablissement particulierement information responsabilidad desarrollo
naturalmente conocimiento universidad anteriormente posteriormente""".split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, bool]]:
    """(string, is random) pairs: ``n`` random keys and ``n`` ordinary strings, the same for each seed."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    weights = [3, 4, 2, 1, 2, 1, 1]
    out = [("".join(r.choices(r.choices(alphabets, weights)[0], k=r.randint(16, 64))), True) for _ in range(n)]
    for _ in range(n):
        w = r.choices(_WORDS, k=r.randint(1, 5))
        form = r.randrange(9)
        if form == 0:
            s = w[0] + "".join(x.title() for x in w[1:])
        elif form == 1:
            s = "".join(x.title() for x in w)
        elif form == 2:
            s = "_".join(w)
        elif form == 3:
            s = "_".join(w).upper()
        elif form == 4:
            s = "-".join(w)
        elif form == 5:
            s = "/".join(w) + r.choice(["", "/index", f"/v{r.randint(1, 9)}"])
        elif form == 6:
            s = "".join(w) + r.choice(["", "", str(r.randint(0, 99))])
        elif form == 7:
            s = r.choice([f"{r.randint(1970, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", str(r.randint(10**5, 10**18)), "=" * r.randint(4, 30), "-" * r.randint(4, 30), "_" * r.randint(4, 30)])
        else:
            s = r.choice(w) * r.randint(1, 3)
        out.append((s, False))
    return out


def train(samples: list[tuple[str, bool]], smooth: float = 0.3) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each pair of bytes; the row 0 is the start of a string."""
    counts = np.zeros((2, 128, 128))
    for s, is_random in samples:
        b = np.frombuffer(("\0" + s).encode("ascii"), np.uint8)
        np.add.at(counts[int(is_random)], (b[:-1], b[1:]), 1.0)
    letters = np.flatnonzero(_KEY[:128])
    p = counts[:, :, letters] + smooth
    p /= p.sum(axis=2, keepdims=True)
    out = np.zeros((256, 256), np.float32)
    out[:128, letters] = np.log(p[1]) - np.log(p[0])
    return out


def best_stretch(llr: np.ndarray, least: int = MIN_LENGTH) -> tuple[int, int, float]:
    """(start, end, sum) of the stretch of at least ``least`` values with the greatest sum."""
    s = np.concatenate([[0.0], np.cumsum(llr, dtype=np.float64)])
    n = len(s) - least
    low = np.minimum.accumulate(s[:n])
    gain = s[least:] - low
    end = int(np.flatnonzero(gain >= gain.max() - 1e-9)[0])
    start = int(np.flatnonzero(s[: end + 1] <= low[end] + 1e-9)[0])
    return start, end + least, float(gain[end])


def stretches(llr: np.ndarray, text: np.ndarray, limit: float, least: int = MIN_LENGTH) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all secrets of a run in reading order: the best stretch, extended to whole pieces, then those of the rest on its left and right."""
    out, rest = [], [(0, len(llr))]
    plain, hexa = _PLAIN[text], _HEX[text]
    while rest:
        lo, hi = rest.pop()
        if hi - lo < least:
            continue
        a, b, score = best_stretch(llr[lo:hi], least)
        if score < limit:
            continue
        a, b = lo + a, lo + b
        while a > lo and plain[a - 1]:
            a -= 1
        while b < hi and plain[b]:
            b += 1
        if (hexa[a:b] | (text[a:b] == 45)).all():
            while (at := _piece(text, hexa, plain, b, hi, 1)) != b:
                b = at
            while (at := _piece(text, hexa, plain, a - 1, lo - 1, -1) + 1) != a:
                a = at
        out.append((a, b, score))
        rest += [(lo, a), (b, hi)]
    return sorted(out)


def _piece(text, hexa, plain, at: int, stop: int, step: int) -> int:
    """Where a hyphen and a whole hexadecimal piece of four characters or more that follow end; ``at`` if none does."""
    if at == stop or text[at] != 45:
        return at
    end = at + step
    while end != stop and hexa[end]:
        end += step
    return end if abs(end - at) > 4 and (end == stop or not plain[end]) else at


def find(texts: pa.Array, table: np.ndarray, limit: float = LIMIT, least: int = MIN_LENGTH):
    """(document, first byte, end byte, ratio) of each secret."""
    off, data = W.buffers(W.fill(texts))
    if not len(data):
        return
    key = _KEY[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(key & (~np.concatenate([[False], key[:-1]]) | edge[:-1]))
    end = np.flatnonzero(key & (~np.concatenate([key[1:], [False]]) | edge[1:])) + 1
    long = end - start >= least
    start, end = start[long], end[long]
    if not len(start):
        return
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    before = np.where(np.isin(at, start), 0, data[np.maximum(at - 1, 0)])
    llr = table[before, data[at]]
    first = np.cumsum(size) - size
    hopeful = np.flatnonzero(np.add.reduceat(np.maximum(llr, 0), first) >= limit)
    doc = np.searchsorted(off, start, side="right") - 1
    for k in hopeful:
        for a, b, score in stretches(llr[first[k] : first[k] + size[k]], data[start[k] : end[k]], limit, least):
            yield int(doc[k]), int(start[k] + a - off[doc[k]]), int(start[k] + b - off[doc[k]]), score


def _spans(texts: pa.Array, table: np.ndarray, limit: float):
    """The same, in characters of each text."""
    for d, a, b, score in find(texts, table, limit):
        raw = texts[d].as_py().encode()
        lo = len(raw[:a].decode())
        yield d, lo, lo + b - a, score


def scan(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, limit: float = LIMIT) -> DataFrame:
    """(doc_id, start_char, end_char, llr) of each secret of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_samples() if samples is None else samples))

    def run(batches):
        for part in W.slices(batches):
            ids = part.column("doc_id")
            rows = [(ids[d].as_py(), a, b, s) for d, a, b, s in _spans(part.column("text"), shared.value, limit)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int32(), pa.float64()])], names=["doc_id", "start_char", "end_char", "llr"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, limit: float = LIMIT) -> DataFrame:
    """``docs``, all rows and columns, each secret in ``text`` replaced by ``MARK`` (and ``n_chars`` set to the new length)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_samples() if samples is None else samples))

    def run(batches):
        for part in W.slices(batches):
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, a, b, _ in _spans(part.column("text"), shared.value, limit):
                spans.setdefault(d, []).append((a, b))
            texts = part.column("text")
            yield replace_text(part, {d: cut_out(texts[d].as_py(), s, MARK) for d, s in spans.items()})

    return docs.mapInArrow(run, docs.schema)
