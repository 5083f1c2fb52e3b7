"""Importance resampling against plain Python, with the CRC of zlib and words by an expression."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import arrowtext, resampling
from granary.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [None, "", " \t\n", "one two", "One TWO three-four", "é漢字 ÄÖ x1\x7fy", "tail", "head of the next", "w" * 70_000 + " short", "a b " * 30, "\U0001f600 smile\U0001f600"]


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def runs(text, run):
    ws = words(text)
    return [" ".join(ws[k : k + n]) for n in range(1, run + 1) for k in range(len(ws) - n + 1)]


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize("few", [0, 64])
@pytest.mark.parametrize("step", [7, 1 << 22])
def test_features_are_runs_of_words(monkeypatch, run, few, step):
    monkeypatch.setattr(resampling, "FEW", few)
    monkeypatch.setattr(resampling, "STEP", step)
    texts = [t if t is None or few or len(t) < 1000 else t[:3000] for t in TEXTS]
    monkeypatch.setattr(resampling, "_WORDS", 5)
    data, offsets = arrowtext.text_bytes(pa.array(["skipped", *texts]).slice(1))
    got = [Counter() for _ in texts]
    for text, crc in resampling.features(data, offsets, run):
        for k, c in zip(text.tolist(), crc.tolist(), strict=True):
            got[k][c] += 1
    assert got == [Counter(zlib.crc32(r.encode()) for r in runs(t, run)) for t in texts]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    for step in (1, 10, 100, 1 << 20):
        parts = list(arrowtext.slices([batch, batch.slice(3, 2)], 0, step))
        assert [x for p in parts for x in p.column(0).to_pylist()] == TEXTS + TEXTS[3:5]
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= step for p in parts)


def brute(rows, target, least=20, percent=10, buckets=10_000):
    def counts(texts):
        return Counter(zlib.crc32(w.encode()) % buckets for t in texts for w in words(t))

    s, t = counts(x for _, x in rows), counts(target)
    S, Tt = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (Tt + buckets)))) for b in (zlib.crc32(w.encode()) % buckets for w in words(text)))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r) for r in out)


def test_query_matches_brute_force(spark, duck, sf):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    target = [t for (t,) in duck.execute("select text from benchmark").fetchall()]
    got = Counter(tuple(r) for r in QUERIES["op11_importance_resampling"](spark, sf).collect())
    assert got == brute(rows, target)


def test_edge_rows_and_clashing_names(spark):
    rows = [(k if k else None, t) for k, t in enumerate(TEXTS)] + [(3, "two rows " * 11)] * 2 + [(None, "no number " * 12)] * 3 + [(50 + k, "equal score words " * 9) for k in range(20)]
    table = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], "doc_id long, text string, rank string, weight int, _words string, able string")
    target = spark.createDataFrame([("one two",), (None,), ("equal words",)], "text string")
    got = Counter(tuple(r) for r in resampling.resample(table, target).collect())
    assert got == brute(rows, ["one two", None, "equal words"])
    assert resampling.draw(table.filter("doc_id >= 50"), target, percent=50).columns == table.columns
    assert resampling.draw(table.filter("doc_id >= 50"), target, percent=50).count() == 10


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).count() == 0
    assert resampling.resample(docs, none, percent=100).first()["rank"] == 1


def test_gains_favour_the_target():
    gains = resampling.bucket_gains(np.array([100, 0, 5]), np.array([0, 10, 5]))
    assert gains[1] > gains[2] > gains[0]
