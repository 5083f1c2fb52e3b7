"""Fingerprints against plain Python: entropies, votes, the order of documents, likeness."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import fingerprints as fp
from granary.llm.queries import QUERIES

W = fp.WINDOW


def level(window):
    total = sum(int(fp._SUM[c]) for c in Counter(window).values())
    return (fp._TOP - total) * fp.LEVELS // fp._TOP


def plain_features(data, ranks):
    """Places of the features of one text of at least a window."""
    n = len(data) - W + 1
    rank = [int(ranks[level(data[k : k + W])]) for k in range(n)]
    votes = Counter(min(range(k, min(k + W, n)), key=lambda j: (rank[j], j)) for k in range(n))
    most = max(votes.values())
    top = min(k for k, v in votes.items() if v == most)
    return sorted({k for k, v in votes.items() if v >= fp.VOTES} | {top})


def joined(texts):
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def some_texts():
    r = random.Random(4)
    words = "the of and entropy window rarest filter chain feature corpus".split()
    return [b"", b"short", b"a" * 31, b"b" * 32, b"c" * 33, b"", b"x" * 200, bytes(r.randrange(256) for _ in range(300)), " ".join(r.choice(words) for _ in range(200)).encode(), b"\x00" * 40, "é漢字".encode() * 30]


@pytest.mark.parametrize("block", [40, 1 << 17])
def test_features_are_the_voted_windows(monkeypatch, block):
    monkeypatch.setattr(fp, "_BLOCK", block)
    texts = some_texts()
    ranks = fp.level_ranks(np.random.default_rng(1).integers(0, 9, fp.LEVELS + 1))
    data, offsets = joined(texts)
    text, h = fp.features(data, offsets, ranks)
    for k, t in enumerate(texts):
        own = h[text == k].tolist()
        if not t:
            assert own == []
        elif len(t) < W:
            assert len(own) == 1
        else:
            windows = np.array([list(t[at : at + W]) for at in plain_features(t, ranks)], dtype=np.uint8)
            assert own == fp._mixed(windows).tolist()


def test_levels_are_entropies():
    for data in some_texts():
        if len(data) >= W:
            for k, got in enumerate(fp.window_levels(np.frombuffer(data, dtype=np.uint8)).tolist()):
                counts = Counter(data[k : k + W]).values()
                entropy = -sum(c / W * math.log2(c / W) for c in counts)
                assert got == level(data[k : k + W]) and abs(got - entropy / math.log2(W) * fp.LEVELS) <= 1.001


def test_counts_are_over_all_windows(spark):
    texts = [t.decode() for t in some_texts() if t.isascii()] + [None]
    counts = fp.level_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = Counter(level(t.encode()[k : k + W]) for t in texts if t for k in range(len(t) - W + 1))
    assert {k: n for k, n in enumerate(counts.tolist()) if n} == dict(want)


def test_chained_filters_hold_all_features():
    r = random.Random(9)
    data = bytes(r.randrange(256) for _ in range(20_000))
    ranks = fp.level_ranks(np.arange(fp.LEVELS + 1))
    found = fp.Fingerprints(*joined([b"first", data, data[:9000]]), ranks)
    filters, held = found.chain(1)
    assert len(filters) == math.ceil(held.sum() / fp.FILTER_FEATURES) > 2 and set(held[:-1]) == {fp.FILTER_FEATURES}
    again = fp.parsed(found.text(1))
    assert np.array_equal(again[0], filters) and np.array_equal(again[1], held)
    bits = np.unpackbits(filters, axis=1)
    text, h = fp.features(*joined([data]), ranks)
    seen = list(dict.fromkeys(h.tolist()))
    for k, x in enumerate(seen):
        assert all(bits[k // fp.FILTER_FEATURES, ((x >> (11 * j)) & 2047)] for j in range(fp.HASHES))


def test_likeness_follows_the_shared_part():
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    ranks = fp.level_ranks(np.bincount(fp.window_levels(np.frombuffer(prose(5000).encode(), dtype=np.uint8)), minlength=fp.LEVELS + 1))
    for n in (100, 400, 3000):
        a, b = prose(n), prose(n)
        mix = [a, b, *[a[: int(len(a) * share)] + b[int(len(a) * share) :] for share in (0.9, 0.75, 0.5, 0.25)]]
        found = fp.Fingerprints(*joined([t.encode() for t in mix]), ranks)
        got = [fp.likeness(found.chain(0), found.chain(k)) for k in range(len(mix))]
        assert got[0] == 1.0 and got[1] < 0.1 and got[2] > got[3] > got[4] > got[5] > got[1]
        assert all(abs(x - share) < 0.15 for x, share in zip(got[2:], (0.9, 0.75, 0.5, 0.25), strict=True))
        assert all(fp.likeness(found.chain(0), found.chain(k)) == fp.likeness(found.chain(k), found.chain(0)) for k in range(2, 6) if len(found.chain(k)[0]) != len(found.chain(0)[0]))
    none = fp.parsed("")
    assert fp.likeness(none, none) == 1.0 and fp.likeness(none, found.chain(0)) == fp.likeness(found.chain(0), none) == 0.0


def pairs(rows):
    """(id, n_chars, hash of the edited text) in the order of identifiers; ids are distinct."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    return Counter(out)


def test_query_edits_by_the_next_document(spark, duck, sf):
    rows = duck.execute("select doc_id, text from documents").fetchall()
    out = QUERIES["op12_improbable_digest"](spark, sf).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == pairs(rows)
    texts, order = dict(rows), sorted(i for i, _ in rows)
    by_text, by_id = {}, {r.doc_id: r for r in out}
    for r in out:
        assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
    for k, i in enumerate(order):
        follower = order[(k + 1) % len(order)]
        own, after = fp.parsed(by_id[i].fingerprint), fp.parsed(by_id[follower].fingerprint)
        assert by_id[i].near_next == fp.likeness(own, after)
        assert by_id[i].near_edited == fp.likeness(own, fp.parsed(by_id[i].edited_fingerprint))
    long = [r for r in out if r.n_chars >= 300]
    assert np.mean([r.near_edited for r in long]) > 0.45 > 0.1 > np.mean([r.near_next for r in long])


@pytest.mark.parametrize("count", [1, 2, 60])
def test_any_partitioning_and_slice(spark, monkeypatch, count):
    r = random.Random(count)
    rows = [(7 * k - 100, r.choice([None, "", "x", "漢字 \U0001f600" * 5, "word " * r.randrange(400)])) for k in range(count - 1)] + [(None, "last of all " * 20)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, part string, guest int").repartition(5)
    want = None
    for step in (1, 1 << 20):
        monkeypatch.setattr(fp, "STEP", step)
        out = fp.edited_likeness(df).collect()
        assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in out) == pairs(rows)
        want = want or sorted(map(str, out))
        assert sorted(map(str, out)) == want


def test_repeated_rows_and_hot_identifiers(spark):
    rows = [(1, "same row of words again and again"), *[(5, f"number {k} of the crowd") for k in range(400)], *[(5, "twin")] * 3, *[(None, f"null {k}") for k in range(300)], (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fp.edited_likeness(df).collect()
    assert Counter((x.doc_id, x.n_chars) for x in out) == Counter((i, len(t or "")) for i, t in rows)
    assert len(fp._ranged(df.selectExpr("doc_id id", "coalesce(text, '') text")).select("part").distinct().collect()) > 8


def test_empty_table_and_likeness_of_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_likeness(none).count() == 0
    df = spark.createDataFrame([(1, "some words " * 20, "old"), (2, None, "old")], "doc_id long, text string, fingerprint string")
    ranks = fp.level_ranks(fp.level_counts(df))
    marked = fp.add_fingerprint(df, ranks)
    assert marked.columns == ["doc_id", "text", "fingerprint"]
    got = {r.doc_id: r for r in marked.withColumn("alike", fp.likeness_of("fingerprint", "fingerprint")).collect()}
    assert got[2].fingerprint == "" and got[1].alike == got[2].alike == 1.0
