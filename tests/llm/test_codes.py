"""Vector codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from granary.llm import codes
from granary.llm.queries import QUERIES


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Rows (id, vector, label) to (id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    smallest = {}
    for i, v, _ in kept:
        if i is not None:
            smallest[i] = min(v, smallest.get(i, v))
    books = [[cut(smallest[i], p) for i in sorted(smallest)[:entries]] for p in range(parts)]

    def nearest(v, book):
        d = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(cut(v, p), book)[0]].append(cut(v, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if members[e] else old for e, old in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [(i, [nearest(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    sums = Counter()
    for _, near, label in found:
        sums[label] += sum(d for _, d in near)
    return [(i, "".join(f"{e:02x}" for e, _ in near), sum(d for _, d in near), sums[label], digest) for i, near, label in found]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, row string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "w") for i, v, label in rows], SCHEMA)


def result(df):
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_query_matches_plain_rounds(spark, duck, sf):
    rows = duck.execute("select vec_id, embedding, label from embeddings").fetchall()
    assert result(QUERIES["op13_hamerly_codes"](spark, sf)) == Counter(plain(rows))


@pytest.mark.parametrize("seed", range(3))
def test_many_ties(spark, seed):
    """Components of few values, so that distances are often equal."""
    random = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in random.integers(-2, 3, 16) / 4096], int(i) % 3 if i % 7 else None) for i in random.permutation(300)]
    assert result(codes.encode(table(spark, rows))[0]) == Counter(plain(rows))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [k / 7 - 1.0] * 8 + [k / 3] * 8, k % 2) for k in range(5)]
    rows = [*good, good[0], good[0], (None, good[1][1], None), (None, None, None), (9, [None, *good[0][1][1:]], 1), (10, [nan] * 16, 1), (11, [-inf] * 16, 1), (3, [0.5] * 16, 7), (3, [-0.5] * 16, None)]
    got = result(codes.encode(table(spark, rows))[0])
    assert got == Counter(plain(rows)) and sum(got.values()) == 10
    others = [(20, [], 1), (21, [1.0] * 3, 1), (22, [1.0] * 8, 1)]
    assert result(codes.encode(table(spark, rows + others))[0]) == got


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(None, [1.0] * 8, 1)]):
        out, books = codes.encode(table(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0 and books == []


def test_too_large_components_are_refused(spark):
    with pytest.raises(ValueError):
        codes.encode(table(spark, [(1, [1e9] * 8, 1)]))


def test_bounds_spare_scans_and_lose_nothing():
    random = np.random.default_rng(5)
    x = (random.normal(size=(2000, 4)) * 300 + random.integers(0, 8, 2000)[:, None] * 2000).astype(np.int64)
    book, scanned = x[:8].copy(), 0
    code, upper, lower = codes.scan(x, book)
    for _ in range(6):
        new = np.array([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(8)])
        move, book = codes.moved(book, new), new
        code, upper, lower, n = codes.reassign(x, move, code, upper, lower)
        scanned += n
        d = codes.squared(x, book)
        assert (code == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(x)), code].astype(float))
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(axis=1).astype(float))).all()
    assert 0 < scanned < 3 * len(x)


def test_one_entry(spark):
    rows = [(k, [float(k)] * 8, 0) for k in range(4)]
    assert result(codes.encode(table(spark, rows), entries=1)[0]) == Counter(plain(rows, entries=1))


def test_decoded_vectors_have_the_stated_error(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    coded, books = codes.encode(df)
    joined = codes.decode(coded, books).join(codes.whole_vectors(df), "vec_id").select("vector", "v", "error").collect()
    for r in joined:
        assert sum((round(4096 * a) - b) ** 2 for a, b in zip(r.vector, r.v, strict=True)) == r.error


def test_many_labels_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(codes, "MOST_LABELS", 1)
    rows = [(k, [float(k % 11)] * 8, None if k % 3 == 0 else k % 5) for k in range(200)]
    assert result(codes.encode(table(spark, rows))[0]) == Counter(plain(rows))
