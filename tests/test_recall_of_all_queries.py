"""The recall that chooses the number of lists is measured on all queries."""

import random

from granary.operators import vectors


def test_recall_counts_every_query(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(700)], "id long, v array<double>")
    index, asked, k = vectors.build(df, "id", "v", lists=16), df.filter("id % 2 = 0"), 4
    probes, got = vectors.enough_probes(index, asked, "id", "v", k, goal=0.7)
    pairs = lambda n: {(x.query, x.doc) for x in vectors.search(index, asked, "id", "v", k, n).collect()}
    exact = pairs(None)
    assert len(exact) == 350 * k and probes < 16
    assert got == len(exact & pairs(probes)) / len(exact) == vectors.recall(index, asked, "id", "v", k, probes) < 1
