"""Similar rows against plain Python over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import comparable
from granary.operators import fuzzy, graphs, inverted, search, vectors
from granary.plans import similar  # noqa: F401
from granary.plans.queries import ORACLES, QUERIES

NAMES = ["fuzzy_names", "service_replay", "events_stored_once", "bm25_kept_index", "index_states", "vector_lists_exact", "vector_recall", "hybrid_search", "answers_extracted"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf, name):
    assert comparable(QUERIES[name](spark, sf).toPandas()) == comparable(duck.execute(ORACLES[name]).fetchdf())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def score(a, b):
    """Token-set ratio by its definition."""
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    one, two = (f"{shared} {' '.join(sorted(x))}".strip() for x in (left - right, right - left))
    ratio = lambda s, t: 200 * lcs(s, t) / (len(s) + len(t))
    return max([ratio(one, two), *([ratio(shared, one), ratio(shared, two)] if shared else [])])


def test_common_length():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(90))) for _ in "12")
        assert fuzzy.common_length(a, b) == lcs(a, b)


def people(seed, n):
    r = random.Random(seed)
    family, first = ["smirnova", "kuznetsov", "ivanov", "li", "petrova", "o"], ["anna", "oleg", "ivan", "bo", "maria", "a", "anna maria"]

    def typo(s):
        for _ in range(r.randrange(3)):
            k = r.randrange(len(s) + 1)
            s = r.choice([s[:k] + r.choice("abx ") + s[k:], s[:k] + s[k + 1 :], s[:k] + r.choice("qz") + s[k + 1 :]])
        return s

    made = [typo(" ".join(r.sample([r.choice(family), r.choice(first), *([f"no {r.randrange(40):03d}"] if r.random() < 0.4 else [])], k=2))) for _ in range(n)]
    return [*made, "", None, " - ", "Smirnova", "anna", "hot anna oleg ivan maria", *made[:5]]


@pytest.mark.parametrize("threshold, block", [(75, 3), (90, 512), (100, 3)])
def test_all_pairs_are_found(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(fuzzy, "BLOCK", block)
    names = people(threshold, 120)
    df = spark.createDataFrame(list(enumerate(names)), "o long, name string").repartition(3)
    keys = df.select(fuzzy.token_key([df.name]).alias("key")).filter("key is not null").distinct()
    got = {(r.a, r.b) for r in fuzzy.similar_keys(keys, threshold).collect()}
    known = sorted(r.key for r in keys.collect())
    assert got == {(a, b) for k, a in enumerate(known) for b in known[k + 1 :] if score(a, b) >= threshold - 1e-9}

    # Groups of rows, and the row of each that stays.
    key_of = {r.o: r.key for r in df.select("o", fuzzy.token_key([df.name]).alias("key")).collect()}
    group = {k: k for k in known}
    for a, b in sorted(got):
        one, two = group[a], group[b]
        group = {k: one if g == two else g for k, g in group.items()}
    members = {}
    for o, k in key_of.items():
        members.setdefault(group[k] if k else ("alone", o), []).append(o)
    rows = fuzzy.fuzzy_groups(df, ["name"], "o", threshold).collect()
    assert {r.o: (r.fuzzy_group, r.fuzzy_rows) for r in rows} == {o: (min(m), len(m)) for m in members.values() for o in m}
    links = Counter(k for pair in got for k in pair)
    assert {r.o: r.fuzzy_links for r in rows} == {o: links[k] for o, k in key_of.items()}
    kept, removed = fuzzy.drop_fuzzy(df, ["name"], "o", threshold)
    assert {r.o for r in kept.collect()} == {min(m) for m in members.values()}
    assert {(r.o, r.kept_row) for r in removed.collect()} == {(o, min(m)) for m in members.values() for o in m if o != min(m)}


def test_key_of_several_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Smirnova", "O."), (2, "O", "Smirnova"), (3, None, None)], "o long, family string, first string")
    assert {r.o: r.fuzzy_group for r in fuzzy.fuzzy_groups(df, ["family", "first"], "o").collect()} == {1: 1, 2: 1, 3: 3}
    assert fuzzy.fuzzy_groups(df.limit(0), ["family"], "o").count() == 0
    with pytest.raises(ValueError):
        fuzzy.similar_keys(df.select("family"), 60)


def test_components(spark):
    r = random.Random(8)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(70)] + [(5000, 5000), (None, 7)]
    reach = {}
    for a, b in links:
        if a is not None:
            one, two = reach.get(a, {a}), reach.get(b, {b})
            for v in one | two:
                reach[v] = one | two
    got = {x.vertex: x.component for x in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: min(s) for v, s in reach.items()}


def ranked(df):
    return sorted((r.query, r.doc, round(r.score, 9), round(r.coverage, 9)) for r in df.collect())


def test_kept_index_equals_a_rebuild(spark, tmp_path):
    r, path = random.Random(1), str(tmp_path / "index")
    words = "door window price delivery repair paint wall 7 42".split()
    queries = spark.createDataFrame([(1, "door", "door", 1.0), (1, "window", "window", 1.0), (2, "price", "price", 2.0), (2, "price", "delivery", 2.0), (3, "none", "none", 1.0)], "query long, group string, term string, weight double")
    text = lambda: r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))])
    docs, states = {}, None
    for step in range(4):
        for k in range(40):
            if r.random() < 0.4:
                docs[k] = text()
            elif r.random() < 0.2:
                docs.pop(k, None)
        rows = spark.createDataFrame(list(docs.items()), "id long, text string")
        states = {x.doc: x.state for x in inverted.update(rows, path, "id", "text").collect()}
        assert {k for k, s in states.items() if s != "removed"} == set(docs)
        want = ranked(search.bm25(rows, queries, "id", "text"))
        assert ranked(inverted.search(spark, path, queries)) == want and want
        # An update that was cut off before its commit leaves the version as it is.
        inverted._store(spark.createDataFrame([(0, "door", 99)], "doc long, term string, tf long"), path, inverted.version(spark, path) + 1)
        assert ranked(inverted.search(spark, path, queries)) == want
    again = inverted.update(rows, path, "id", "text")
    assert {x.state for x in again.collect()} == {"unchanged"}
    assert spark.read.schema("doc long, term string").parquet(f"{path}/postings/segment={inverted.version(spark, path)}").count() == 0
    inverted.compact(spark, path)
    assert ranked(inverted.search(spark, path, queries)) == want
    inverted.update(rows.limit(0), path, "id", "text")
    assert inverted.search(spark, path, queries).count() == 0


def test_index_reads_only_the_buckets_it_needs(spark, tmp_path):
    path = str(tmp_path / "index")
    inverted.update(spark.range(50).select("id", F.concat(F.lit("door w"), "id").alias("text")), path, "id", "text")
    plan = inverted.postings(spark, path, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_vector_lists(spark, tmp_path):
    r = np.random.default_rng(4)
    centers = r.normal(size=(12, 8))
    rows = [(k, [float(x) for x in centers[k % 12] + r.normal(size=8) * 0.2]) for k in range(600)] + [(600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.5] * 6), (603, [float("nan")] * 8), (604, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    index = vectors.build(df, "id", "v", path=str(tmp_path / "lists"))
    assert sorted(x.doc for x in index.rows.collect()) == list(range(605))
    asked = df.filter("id < 600 and id % 20 = 0")
    exact = search.similar(df.filter("id < 602"), asked, "id", "v", 5)
    clean = vectors.build(df.filter("id < 602"), "id", "v")
    flat = lambda d: sorted((x.query, x.doc, x["rank"]) for x in d.collect())
    assert flat(vectors.search(clean, asked, "id", "v", 5)) == flat(exact)
    probes, got = vectors.enough_probes(clean, asked, "id", "v", 5)
    assert got >= 0.9 and probes < len(clean.centroids)
    found = set(flat(vectors.search(clean, asked, "id", "v", 5, probes)))
    assert len({x[:2] for x in found} & {x[:2] for x in flat(exact)}) >= 0.9 * len(flat(exact))
    plan = vectors.search(clean, asked, "id", "v", 5, probes)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    again = vectors.stored(spark, str(tmp_path / "lists"), index.centroids)
    assert again.rows.count() == 605
    assert vectors.search(vectors.build(df.limit(0), "id", "v"), asked, "id", "v", 5).count() == 0


def test_extracted_answers(spark):
    long = "Filler words about nothing at all. " * 9 + "The rare battery lasts a week! More filler"
    rows = [(1, 1, "nothing here"), (1, 2, "delivery is free\n\n  battery and delivery  \nprice\ndelivery again"), (1, 3, long), (2, 1, None), (3, 1, long)]
    terms = [(1, "delivery", "delivery"), (1, "battery", "battery"), (1, "battery", "accumulator"), (2, "x", "x"), (3, "battery", "battery")]
    out = search.extracted_answers(spark.createDataFrame(rows, "query long, rank int, text string"), spark.createDataFrame(terms, "query long, group string, term string"))
    assert {(r.query, r["rank"]): r.answer for r in out.collect()} == {(1, 2): "battery and delivery.", (3, 1): "The rare battery lasts a week!"}


def test_short_keys_meet_in_what_is_left():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("ab1") for _ in range(draw.randint(1, 7)))
    for threshold in (75, 85, 90):
        keys = {" ".join(sorted({word() for _ in range(draw.randint(1, 3))})) for _ in range(400)}
        keys = sorted(k for k in keys if len(k) <= fuzzy._short(threshold))
        lengths = sorted({len(k) for k in keys})
        left = {k: set(fuzzy.remainders(k, lengths, threshold)) for k in keys}
        for a in keys:
            for b in keys:
                one, two = set(a.split(" ")), set(b.split(" "))
                if a < b and one - two and two - one and fuzzy.whole_key_matches(a, b, threshold):
                    assert left[a] & left[b], (a, b)


def test_numbered_names_do_not_all_meet():
    met = {}
    for k in range(20_000):
        for x in fuzzy.remainders(f"{k:09d} customer", [18], 90):
            met[x] = met.get(x, 0) + 1
    assert max(met.values()) <= 100


def test_nearest_by_blocks(spark, monkeypatch):
    draw = random.Random(2)
    point = lambda: [float(draw.randint(-3, 3)) for _ in range(4)]
    rows = [(k, point()) for k in range(60)] + [(60, None), (61, [1.0, None, 1.0, 1.0]), (62, [1.0, 2.0]), (63, [0.0] * 4), (64, [])] + [(k, [1.0, 2.0, 0.0, 1.0]) for k in range(70, 80)]
    table = spark.createDataFrame(rows, "id int, v array<float>")
    pairs = table.select(F.col("id").alias("query"), F.col("v").alias("q")).crossJoin(table.select(F.col("id").alias("doc"), F.col("v").alias("w")))
    want = search.top_k(pairs.select("query", "doc", search.cosine(F.col("q"), F.col("w")).alias("score")), 7).collect()
    want = sorted((r.query, r["rank"], r.doc, round(r.score, 9) + 0.0) for r in want)
    monkeypatch.delattr(search, "cosine")  # pairs are no rows
    for queries, vectors_ in ((4096, 16_384), (10, 7)):
        monkeypatch.setattr(search, "QUERY_BLOCK", queries)
        monkeypatch.setattr(search, "VECTOR_BLOCK", vectors_)
        got = search.similar(table, table, "id", "v", 7)
        assert sorted((r.query, r["rank"], r.doc, round(r.score, 9) + 0.0) for r in got.collect()) == want
    assert search.similar(table.limit(0), table, "id", "v", 7).count() == 0


def test_frequencies_once_for_equal_groups(spark, monkeypatch):
    docs = [(k, " ".join(w for n, w in enumerate(("aa", "bb", "cc", "dd")) if (k + 1) % (n + 1) == 0)) for k in range(12)] + [(12, None)]
    asked = [(q, g, t, w) for q in range(20) for g, t, w in (("aa", "aa", 1.0), ("x", "bb", 0.5), ("x", "cc", 1.0), ("dd", "dd", 2.0))]
    stored, kept = [], search.settled
    monkeypatch.setattr(search, "settled", lambda df: stored.append(kept(df)) or stored[-1])
    got = {(r.query, r.doc): (round(r.score, 9), round(r.coverage, 9)) for r in search.bm25(spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(asked, "query int, group string, term string, weight double"), "id", "t").collect()}
    assert [df.count() for df in stored if "df" in df.columns and "weight" not in df.columns] == [3]
    words = {k: (t or "").split() for k, t in docs}
    mean, groups = sum(map(len, words.values())) / 13, {"aa": [("aa", 1.0)], "x": [("bb", 0.5), ("cc", 1.0)], "dd": [("dd", 2.0)]}
    want = {}
    for k, have in words.items():
        score = hit = 0.0
        for terms in groups.values():
            df = sum(any(t in w for t, _ in terms) for w in words.values())
            met = [(w, have.count(t)) for t, w in terms if t in have]
            if met:
                score += max(np.log(1 + (13 - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(have) / mean)) * w for w, n in met)
                hit += max(w for w, _ in met)
        if hit:
            want.update({(q, k): (round(score, 9), round(hit / 4.0, 9)) for q in range(20)})
    assert got == want
