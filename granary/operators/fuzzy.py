"""Groups of similar rows: a self-join by the token-set ratio that loses no pair, and components.

The ratio of two keys is the best of three: their shared tokens against all tokens of
either key, and all tokens of one against the other, shared ones first. ``ratio(s, t)``
is 200 times the longest common subsequence over the summed lengths.

Candidates come from two rules; each finds every pair over the threshold of its kind:

- shared tokens: what one key has alone must be short, so of its rarest tokens, taken until
  they are longer than that, at least one is shared;
- whole keys: with at most k characters put in or left out, of the longer key's disjoint
  pieces at most k are broken, so of its k + 1 rarest pieces one stands in the other key.
  Two short keys have at most three characters left out in all, so they meet in what
  remains of each; pieces of numbered names would make candidates of nearly all pairs.
  Where the tokens set apart have none in common, what they share there is the proof.

Short keys that lose one character each can have hundreds of partners. Their pairs are made,
each in one place only, in sorted runs inside tasks; groups need their number and one row
for each key of a run, so that no table of pairs is stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_key
from ..sources.scratch import settled, spread
from .graphs import components

BLOCK = 512  # keys of a hot feature that meet in one group, on either side
LEAST = 75  # below this threshold single letters no longer find all pairs
_MARKS = 16  # counters of characters
LONGEST_SHORT, MOST_TOKENS = 24, 3  # characters and tokens of short keys
PAIR_BLOCK = 200_000  # pairs of short keys that are held at once


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of ``row`` for each character of ``a``."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def whole_key_matches(a: str, b: str, threshold: int) -> bool:
    """Whether all tokens of two keys, shared ones first, reach the threshold."""
    left, right = set(a.split(" ")), set(b.split(" "))
    one, two = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    apart = len(one) + len(two) - 2 * common_length(one, two)
    return 100 * (len(a) + len(b) - apart) >= threshold * (len(a) + len(b))


def _short(threshold: int) -> int:
    """The longest key of which two can differ by no more than three characters."""
    near = 100 - threshold
    return min(LONGEST_SHORT, -(-200 // near) - 1) if near else LONGEST_SHORT


def _cuts(text: str, n: int) -> set[str]:
    """The different texts without ``n`` of the characters."""
    if n == 1:
        return {text[:k] + text[k + 1 :] for k in range(len(text))}
    return {"".join(c) for c in combinations(text, len(text) - n)} if n <= len(text) else set()


def _remains(key: str, lengths: list[int], threshold: int) -> Iterator[tuple[bool, str, str]]:
    """(even, feature, apart) of a short key: see ``remainders``; the tokens set apart, and whether two keys lose one character each."""
    tokens, near = key.split(" "), 100 - threshold
    ways = []
    for own in range(4):
        for other in range(4 - own):
            length = len(key) - own + other
            if own + other and length in lengths and 100 * (own + other) <= near * (len(key) + length):
                ways.append((own, other))
    for n in range(1, len(tokens) + 1):
        for apart in combinations(range(len(tokens)), n):
            rest = " ".join(tokens[k] for k in apart)
            shared = " ".join(t for k, t in enumerate(tokens) if k not in apart)
            for own, other in ways:
                cuts = _cuts(rest, own)
                head = f"{max(own, other)}{min(own, other)}{len(shared)}|{shared}|"
                for c in cuts:
                    yield own == other, head + c, rest


def remainders(key: str, lengths: list[int], threshold: int) -> list[str]:
    """What is left of a short key, once some tokens are set apart as shared, without up to three characters of the others.

    Two short keys that match whole have one of these in common. ``lengths``: those of all keys,
    as the number of characters that the other key loses follows from its length.
    """
    return list({feature for _, feature, _ in _remains(key, lengths, threshold)})


def token_key(columns: list[Column]) -> Column:
    """The distinct tokens of the normalised columns, sorted, between single spaces; null without any."""
    text = F.concat_ws(" ", *[F.coalesce(norm_key(c.cast("string")), F.lit("")) for c in columns])
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(text, " +"), lambda w: w != "")))
    return F.nullif(F.array_join(tokens, " "), F.lit(""))


def _pieces(tokens: Column, size: int) -> Column:
    """Disjoint pieces of ``size`` characters of each token."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.floor(F.length(w) / size).cast("int")), lambda k: F.substring(w, (k - 1) * size + 1, F.lit(size)))
    return F.flatten(F.transform(F.filter(tokens, lambda w: F.length(w) >= size), cut))


def _grams(tokens: Column, size: int) -> Column:
    """All runs of ``size`` characters of each token."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (size - 1)), lambda k: F.substring(w, k, F.lit(size)))
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda w: F.length(w) >= size), cut)))


def _rare(keys: DataFrame, features: Column, held: DataFrame) -> DataFrame:
    """``keys`` with ``found``: the features of each with how many keys hold them, rarest first."""
    each = keys.select("*", F.explode(features).alias("feature")).join(held, "feature", "left")
    found = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "feature")))
    return each.groupBy("id").agg(*[F.first(c).alias(c) for c in keys.columns if c != "id"], found.alias("found"))


def _meet(asks: DataFrame, holds: DataFrame) -> DataFrame:
    """(a, b): keys that ask for a feature and other keys that hold it, as structs of the other columns, ``id`` among them.

    A hot feature is dealt over groups of at most some BLOCK keys on each side.
    """
    counts = asks.groupBy("feature").agg(F.count(F.lit(1)).alias("asked")).join(holds.groupBy("feature").agg(F.count(F.lit(1)).alias("held")), "feature")
    counts = counts.select("feature", F.ceil(F.col("asked") / BLOCK).cast("int").alias("pa"), F.ceil(F.col("held") / BLOCK).cast("int").alias("pb"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    of = lambda df: F.struct(*[c for c in df.columns if c != "feature"])
    left = asks.join(counts, "feature").select(of(asks).alias("a"), "feature", own("pa").alias("i"), every("pb").alias("j"))
    right = holds.join(counts, "feature").select(of(holds).alias("b"), "feature", own("pb").alias("j"), every("pa").alias("i"))
    # Few rows become many pairs, so partitions must not be merged by the size of the rows.
    n, by = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["feature", "i", "j"]
    return left.repartition(n, *by).join(right.repartition(n, *by).hint("shuffle_hash"), by).filter("a.id != b.id").select("a", "b")


def _codes(texts: list[str]) -> np.ndarray:
    """A row of code points for each text, filled up with zeros."""
    made = np.array(texts, dtype=np.str_)
    return made.view(np.uint32).reshape(len(texts), -1) if made.dtype.itemsize else np.zeros((len(texts), 1), np.uint32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal features, of batches sorted by feature."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch])
        feature = rows.column("feature")
        other = np.flatnonzero(pc.not_equal(feature, feature[-1]).to_numpy())
        at = int(other[-1]) + 1 if len(other) else 0
        if at or (kept and kept[-1].column("feature")[-1] != feature[0]):
            yield pa.concat_tables([*kept, rows.slice(0, at)]).combine_chunks()
            kept = []
        kept.append(rows.slice(at))
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def _even_pairs(rows: pa.Table, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, links, first) by places in ``rows``: keys of one feature that lose a character each and match.

    ``first``: the pair counts here. A pair of two such features counts in the one that lacks the character
    where a, of the smaller id, first differs; a pair that matches by its shared tokens counts there.
    """
    feature = pc.dictionary_encode(rows.column("feature").combine_chunks()).indices.to_numpy()  # sorted, so in order
    size = np.bincount(feature)[feature]
    rows, feature = rows.filter(pa.array(size > 1)).combine_chunks(), feature[size > 1]
    if not len(rows):
        return
    place = np.flatnonzero(size > 1)
    ends = np.searchsorted(feature, feature, side="right")
    partners = ends - np.arange(len(rows)) - 1
    done = np.cumsum(partners)
    rest = rows.column("apart").combine_chunks()
    words = pc.split_pattern(rest, " ")
    count = pc.list_value_length(words).to_numpy()
    token = np.full((len(rows), MOST_TOKENS), -1)
    token[np.repeat(np.arange(len(rows)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = pc.dictionary_encode(pc.list_flatten(words)).indices.to_numpy()
    known = rest.to_pylist()
    # A feature ends with the tokens set apart without one character.
    cut, apart = _codes([x[len(x) - len(r) + 1 :] for x, r in zip(rows.column("feature").to_pylist(), known, strict=True)]), _codes(known)
    length = rows.column("size").to_numpy().astype(np.int64)
    shared = length - pc.utf8_length(rest).to_numpy() - 1  # -1: none
    by_tokens = 200 * shared >= threshold * (shared + length)
    k = np.arange(apart.shape[1] - 1)
    cut = np.pad(cut, ((0, 0), (0, max(0, len(k) - cut.shape[1]))))[:, : len(k)]
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + PAIR_BLOCK, side="right")))
        n = partners[begin:end]
        a = np.repeat(np.arange(begin, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        links = np.ones(len(a), bool)
        for i in range(MOST_TOKENS):
            for j in range(MOST_TOKENS):
                links &= (token[a, i] != token[b, j]) | (token[a, i] < 0)
        first = links & ~by_tokens[a]
        at = np.flatnonzero(first)
        if len(at) and len(k):
            x, y, c = apart[a[at]], apart[b[at]], cut[a[at]]
            differ = x != y
            low, high = differ.argmax(axis=1), differ.shape[1] - 1 - differ[:, ::-1].argmax(axis=1)
            out = (k < low[:, None]) | (k >= high[:, None])
            both = (low < high) & (out | (x[:, 1:] == y[:, :-1])).all(axis=1) & (out | (x[:, :-1] == y[:, 1:])).all(axis=1)
            first[at[both & ~(out | (c == x[:, 1:])).all(axis=1)]] = False
        yield place[a], place[b], links, first
        begin = end


def _even(features: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """(a, b, n) of the keys that lose a character each. ``pairs``: all pairs a < b that count, once.

    Else the number n of pairs that count for each key a, b being null, to be added up, and pairs of n 0, enough to connect what the pairs connect.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            ids = rows.column("id").to_numpy()
            feature = pc.dictionary_encode(rows.column("feature").combine_chunks()).indices.to_numpy()
            heads, size = np.searchsorted(feature, feature), np.bincount(feature)[feature]
            n, met = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for a, b, links, first in _even_pairs(rows, threshold):
                if pairs:
                    yield made(ids[a[first]], pa.array(ids[b[first]]), np.ones(first.sum(), np.int64))
                    continue
                n += np.bincount(a[first], minlength=len(rows)) + np.bincount(b[first], minlength=len(rows))
                # Where the first key of a run matches all others, one row for each of them connects the run.
                head = links & (heads[a] == a)
                met += np.bincount(a[head], minlength=len(rows))
                use = head | links & (met[heads[a]] < size[a] - 1)
                yield made(ids[a[use]], pa.array(ids[b[use]]), np.zeros(use.sum(), np.int64))
            if pairs:
                continue
            own, place = np.unique(ids, return_inverse=True)
            sums = np.bincount(place, weights=n, minlength=len(own)).astype(np.int64)
            yield made(own[sums > 0], pa.nulls(int((sums > 0).sum()), pa.int64()), sums[sums > 0])

    def made(a: np.ndarray, b: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(n, pa.int64())], names=["a", "b", "n"])

    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sorted by hash first, as long strings of one beginning are slow to compare.
    dealt = features.withColumn("h", F.xxhash64("feature")).repartition(parts, "feature").sortWithinPartitions("h", "feature", "id")
    return dealt.select("id", "size", "feature", "apart").mapInArrow(summed, "a long, b long, n long")


def _found(keys: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of ``keys`` (id, key) that match, each once, and the features of ``_even`` for all other pairs."""
    tokens = F.split("key", " ")
    near = 100 - threshold
    length = lambda c: F.length(f"{c}.key")

    # Shared tokens against all tokens of the key that asks.
    words = settled(keys.select("id", "key", F.explode(tokens).alias("feature")))
    held = words.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    alone = F.length("key") * (2 * near) / (200 - threshold)  # longest that a key may have alone, spaces counted
    used = lambda x: F.length(x["feature"]) + 1
    state = F.aggregate(
        "found",
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<string>").alias("take")),
        lambda s, x: F.struct((s["sum"] + used(x)).alias("sum"), F.when(s["sum"] <= alone, F.array_append(s["take"], x["feature"])).otherwise(s["take"]).alias("take")),
    )
    asks = settled(_rare(keys, tokens, held).select("id", "key", F.explode(state["take"]).alias("feature")))
    shared = F.array_intersect(F.split("a.key", " "), F.split("b.key", " "))
    size = F.aggregate(shared, F.lit(-1), lambda s, w: s + F.length(w) + 1)
    by_tokens = _meet(asks, words).filter(200 * size >= threshold * (size + length("a")))
    pair = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")]
    out = by_tokens.select(*pair)

    # Whole keys. Two short keys meet in what is left of them, all others by pieces of the longer one.
    short = lambda c: (F.length(c) <= _short(threshold)) & (F.size(F.split(c, " ")) <= MOST_TOKENS)
    lengths = [r[0] for r in keys.filter(short("key")).select(F.length("key")).distinct().collect()]  # at most LONGEST_SHORT rows
    plain = keys.filter(~short("key"))
    if not plain.isEmpty():
        out = out.unionByName(_by_pieces(keys, plain, keys.filter(short("key")), threshold).select(*pair))

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x, len(x), *r) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in _remains(x, lengths, threshold)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["id", "key", "size", "even", "feature", "apart"])

    left = spread(keys.filter(short("key")).select("id", "key")).mapInArrow(left_over, "id long, key string, size int, even boolean, feature string, apart string")
    left = settled(left.withColumn("key", F.when(~F.col("even"), F.col("key"))))
    odd = left.filter("not even").select("id", "size", "apart", "feature")
    if not odd.isEmpty():
        apart = ~F.arrays_overlap(F.split("a.apart", " "), F.split("b.apart", " "))
        out = out.unionByName(_meet(odd, odd).filter("a.id < b.id and a.size != b.size").filter(apart).select(*pair))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, "a", "b").distinct(), left.filter("even").select("id", "size", "feature", "apart")


def _by_pieces(keys: DataFrame, plain: DataFrame, brief: DataFrame, threshold: int) -> DataFrame:
    """(a, b) structs: pairs of ``plain`` and all keys that match whole; ``brief`` are the other keys."""
    tokens, near = F.split("key", " "), 100 - threshold
    # How often characters occur, by their hash, up to 15 in four bits each: each character put in or left out moves one count by one.
    chars = F.transform(F.split("key", ""), lambda c: F.pmod(F.xxhash64(c), F.lit(_MARKS)).cast("int"))
    packed = F.lit(0).cast("long")
    for m in range(_MARKS):
        packed = packed.bitwiseOR(F.shiftleft(F.least(F.size(F.filter("chars", F.lit(m).__eq__)), F.lit(15)).cast("long"), 4 * m))
    marked = lambda df: df.select("id", "key", chars.alias("chars")).select("id", "key", packed.alias("marks"))
    budget = F.floor(F.length("key") * (2 * near) / 100).cast("int")
    pieces = F.array_distinct(_pieces(tokens, 1))
    for s in (2, 3):
        pieces = F.when(F.size(_pieces(tokens, s)) > budget, F.array_distinct(_pieces(tokens, s))).otherwise(pieces)

    def met(asking: DataFrame, holding: DataFrame) -> DataFrame:
        grams = settled(marked(holding).select("*", F.explode(F.concat(*[_grams(tokens, s) for s in (3, 2, 1)])).alias("feature")))
        held = grams.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
        asks = settled(_rare(marked(asking), pieces, held).select("id", "key", "marks", F.explode(F.slice("found", 1, budget + 1)["feature"]).alias("feature")))
        return _meet(asks, grams)

    # A short key can be the longer one only of keys of many tokens.
    tokened = plain.filter(F.length("key") <= _short(threshold))
    out = met(plain, keys)
    if not tokened.isEmpty():
        out = out.unionByName(met(brief, tokened))
    nibble = lambda c, m: F.shiftright(c, 4 * m).bitwiseAND(F.lit(15))
    gap = sum(F.abs(nibble(F.col("a.marks"), m) - nibble(F.col("b.marks"), m)) for m in range(_MARKS))
    la, lb = F.length("a.key"), F.length("b.key")
    allowed = (la + lb) * near
    out = out.filter((lb <= la) & (100 * (la - lb) <= allowed) & (100 * gap <= allowed))
    once = out.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a.id", "b.id").dropDuplicates()

    @F.pandas_udf(T.BooleanType())
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([whole_key_matches(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype=bool)

    return once.filter(matches("a.key", "b.key"))


def _numbered(keys: DataFrame) -> DataFrame:
    return settled(keys.withColumn("id", F.monotonically_increasing_id()))


def similar_keys(keys: DataFrame, threshold: int = 90) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``key`` whose token-set ratio reaches the threshold."""
    if threshold < LEAST:
        raise ValueError(f"a threshold below {LEAST} is not supported")
    keys = _numbered(keys.select("key"))
    pairs, features = _found(keys, threshold)
    ids = pairs.unionByName(_even(features, threshold, pairs=True).select("a", "b"))
    name = lambda c: keys.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}"))
    named = ids.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))


def fuzzy_groups(df: DataFrame, key: list[str], order: str, threshold: int = 90) -> DataFrame:
    """``df`` with ``fuzzy_group`` (smallest ``order`` of the rows that are alike, over any number of
    steps), ``fuzzy_rows`` (their number) and ``fuzzy_links`` (keys that the row's own is like).

    Rows without any token in their key are alone. Rows with the same tokens are alike.
    Rows meet only as distinct keys, so repeated rows cost nothing but their own group.
    """
    if threshold < LEAST:
        raise ValueError(f"a threshold below {LEAST} is not supported")
    keyed = df.withColumn("_key", token_key([F.col(c) for c in key]))
    keys = _numbered(keyed.filter("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")))
    pairs, features = _found(keys.select("id", "key"), threshold)
    pairs, even = settled(pairs), settled(_even(features, threshold, pairs=False))
    ends = even.filter("b is null").select(F.col("a").alias("id"), "n")
    for c in ("a", "b"):
        ends = ends.unionByName(pairs.select(F.col(c).alias("id"), F.lit(1).cast("long").alias("n")))
    degree = ends.groupBy("id").agg(F.sum("n").alias("_links"))
    links = pairs.unionByName(even.filter("b is not null").select("a", "b"))
    of = keys.join(components(links).select(F.col("vertex").alias("id"), "component"), "id", "left").join(degree, "id", "left")
    named = settled(of.select("key", "_first", "_rows", F.coalesce("component", "id").alias("component"), F.coalesce("_links", F.lit(0)).alias("fuzzy_links")))
    least = named.groupBy("component").agg(F.min("_first").alias("fuzzy_group"), F.sum("_rows").alias("fuzzy_rows"))
    known = named.join(least, "component").select(F.col("key").alias("_key"), "fuzzy_group", "fuzzy_rows", "fuzzy_links")
    out = keyed.join(known, "_key", "left")
    out = out.withColumns({"fuzzy_group": F.coalesce("fuzzy_group", F.col(order)), "fuzzy_rows": F.coalesce("fuzzy_rows", F.lit(1)), "fuzzy_links": F.coalesce("fuzzy_links", F.lit(0))})
    return out.select(*df.columns, "fuzzy_group", "fuzzy_rows", "fuzzy_links")


def drop_fuzzy(df: DataFrame, key: list[str], order: str, threshold: int = 90) -> tuple[DataFrame, DataFrame]:
    """The first row of each group by ``order`` (unique), and the removed rows with the one that stays (``kept_row``)."""
    grouped = settled(fuzzy_groups(df, key, order, threshold))
    stays = F.col(order) == F.col("fuzzy_group")
    return grouped.filter(stays).select(*df.columns), grouped.filter(~stays).select(*df.columns, F.col("fuzzy_group").alias("kept_row"))
