"""Numbered names have hundreds of partners each: their links are counted where they meet."""

from pyspark.sql import functions as F

from granary.operators import fuzzy


def test_numbered_names_store_no_table_of_pairs(spark, monkeypatch):
    names = [f"Customer#{k:06d}" for k in [*range(600), 10_101, 101_010, 110_100]] + ["Supplier#000001", "Supplier#000010"]
    stored, kept = [], fuzzy.settled
    monkeypatch.setattr(fuzzy, "settled", lambda df: stored.append(kept(df)) or stored[-1])
    monkeypatch.setattr(fuzzy, "PAIR_BLOCK", 50)  # runs are cut
    df = spark.createDataFrame(list(enumerate(names)), "o long, name string")
    rows = fuzzy.fuzzy_groups(df, ["name"], "o", 88).collect()
    cut = lambda x: {x[:k] + x[k + 1 :] for k in range(9, 15)}
    cuts = [(x[:8], cut(x)) for x in names]
    links = {i: {j for j, (kind, c) in enumerate(cuts) if j != i and kind == cuts[i][0] and c & cuts[i][1]} for i in range(len(names))}
    group = {}
    for i in links:
        if i not in group:
            reach, new = {i}, {i}
            while new:
                new = {j for k in new for j in links[k]} - reach
                reach |= new
            group.update({k: reach for k in reach})
    assert {r.o: (r.fuzzy_group, r.fuzzy_rows, r.fuzzy_links) for r in rows} == {i: (min(g), len(g), len(links[i])) for i, g in group.items()}
    assert sum(map(len, links.values())) > 20 * len(names)
    # Two keys that differ in neighbouring characters meet twice and count once.
    assert len(cuts[1][1] & cuts[10][1]) == 2
    assert [df.count() for df in stored if df.columns == ["a", "b"]] == [0]


def test_pairs_with_an_end_in_common_tokens(spark):
    names = ["ab cd ef", "ab cd eg", "abx cd ef", "cd", "ab", "aaaaaaaaaaaaaaaaa b", "aaaaaaaaaaaaaaaaa c", "b aaaaaaaaaaaaaaaax", "|1 ab", "|2 ab", "11|a b", "11|b a"]
    keys = spark.createDataFrame([(n,) for n in names], "name string").select(fuzzy.token_key([F.col("name")]).alias("key")).filter("key is not null").distinct()
    known = [r.key for r in keys.collect()]
    got = [(r.a, r.b) for r in fuzzy.similar_keys(keys, 76).collect()]
    near = lambda a, b: fuzzy.whole_key_matches(a, b, 76) or any(
        200 * len(s) >= 76 * (len(s) + len(x)) for s in [" ".join(sorted(set(a.split()) & set(b.split())))] if s for x in (a, b)
    )
    assert sorted(got) == sorted((a, b) for a in known for b in known if a < b and near(a, b))
