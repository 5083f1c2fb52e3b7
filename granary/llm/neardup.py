"""MinHash near-dedup by a multi-index Hamming join (operator 4).

A text is the set of its 5-word shingles. Its signature has 72 min-hashes of 14
bits. Two sets of similarity 0.85 differ in a signature place with probability
0.15, so all but a vanishing share of the pairs to be linked differ in at most 23
of the 72 places. Split into 12 chunks of 6, such a pair has a chunk with at most
one differing place (23 < 12 * 2); enumerating the place that may differ, six masks
for each of 12 chunks, turns that into 72 equality keys. Every pair within the
signature distance shares a key, and candidates are confirmed on the full sets.

Texts with one and the same set are one class. Within the rows of a key only links
between different components matter, so pairs are not enumerated: first each row is
held against the most widely shared member of its keys. A pair within the signature
distance that is still in different components then lies in an open key, one whose rows
are not yet all in one component. All rows of open keys are held against each other, and
of their pairs only those are left out that their shingle counts rule out for certain:
so every pair under the signature distance is either in one component, impossible, or
confirmed on the full sets. Full sets are sets of 64-bit hashes of whole shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, heavy_values, let, new_folder, remove, spread_join, text_of, words

SHINGLE = 5
CHUNKS, CHUNK, ERRORS = 12, 6, 1  # ERRORS: differing places enumerated in a chunk
PLACES = CHUNKS * CHUNK
DISTANCE = CHUNKS * (ERRORS + 1) - 1
BITS = 14
LANES = 4  # places in one integer of a signature
LEAST = 85  # similarity in hundredths, of the contract
BLOCK = 256  # rows of one shingle that meet in a task

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
_A = _random.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, PLACES, dtype=np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Codes(dict):
    """Word to its hash, for the words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def shingle_hashes(text: str, codes: _Codes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (A-Z lower-cased)."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    code = np.fromiter(map(codes.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(SHINGLE, len(code))
    out = np.full(len(code) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _scramble(out * _MIX + code[i : len(code) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Min-hash signature, packed: LANES places of BITS bits and a spare bit in each integer."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _A[None, :] + _B[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    places = (_scramble(least) >> np.uint64(64 - BITS)).reshape(-1, LANES)
    shifts = np.arange(LANES, dtype=np.uint64) * np.uint64(BITS + 1)
    return (places << shifts).sum(axis=1, dtype=np.uint64).astype(np.int64)


_SIGNED = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.StringType()), T.StructField("sig", T.ArrayType(T.LongType()))]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in batches:
        sizes, names, sigs = [], [], []
        for text in batch.column(1):
            s = shingle_hashes(text.as_py() or "", codes)
            sizes.append(len(s))
            names.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(sigs, pa.list_(pa.int64()))], names=_SIGNED.names)


_KEYED = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.LongType())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each row: for each chunk and each place left out of it, a hash of the others."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            packed = part.column(1).flatten().to_numpy().reshape(len(ids), -1).astype(np.uint64)
            places = np.stack([(packed >> np.uint64(i * (BITS + 1))) & np.uint64(2**BITS - 1) for i in range(LANES)], axis=2).reshape(len(ids), PLACES)
            keys = np.empty((len(ids), PLACES), dtype=np.uint64)
            for c in range(CHUNKS):
                for out in range(CHUNK):
                    h = np.full(len(ids), c * CHUNK + out, dtype=np.uint64)
                    for i in range(CHUNK):
                        if i != out:
                            h = _scramble(h * _MIX + places[:, c * CHUNK + i])
                    keys[:, c * CHUNK + out] = h
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(ids, PLACES))], names=_KEYED.names)


def distance(a: Column, b: Column) -> Column:
    """Number of differing places of two packed signatures."""
    ones = sum((2**BITS - 1) << (i * (BITS + 1)) for i in range(LANES))
    tops = sum(1 << (i * (BITS + 1) + BITS) for i in range(LANES))
    total = F.lit(0)
    for i in range(PLACES // LANES):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        total = total + F.bit_count((x + F.lit(ones)).bitwiseAND(F.lit(tops)))
    return total


def shingle_set(text: Column) -> Column:
    """Distinct shingle hashes of a text, as the confirmation of links compares them."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def of(w: Column) -> Column:
        body = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
        return F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(F.array_distinct(body))

    return let(words(lower), of)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, root) for every node of the undirected edges (a, b): the smallest node it reaches.

    Large-star and small-star steps in turn until the edges form stars; each step
    joins an edge table with one row per node, and is written to ``folder``.
    """
    spark, step = edges.sparkSession, 0
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{folder}/0")
    seen = None
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        seen, step = mark, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(small.distinct(), f"{folder}/{step}")
        remove(spark, f"{folder}/{step - 1}")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are within the distance."""
    one = classes.select(F.col("id").alias("a"), F.col("sig").alias("_sa"))
    two = classes.select(F.col("id").alias("b"), F.col("sig").alias("_sb"))
    joined = pairs.join(one, "a")
    return joined.join(two, (joined["b"] == two["b"]) & (distance(F.col("_sa"), F.col("_sb")) <= DISTANCE)).select("a", joined["b"])


def shingle_sets(ids: DataFrame, df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, set) of the rows of ``df`` named in ``ids`` (id), as a table in ``path``."""
    wanted = ids.select(F.col("id").alias("_n")).distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("_text"))
    return cut(texts.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("_n"), "left_semi").select("id", shingle_set(F.col("_text")).alias("set")), path)


def confirm(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the table of pairs (a, b) whose full shingle sets are similar enough."""
    # One row may be in many pairs, on either side: they are dealt over tasks, each with its set.
    found = spread_join(pairs, sets.select(F.col("id").alias("b"), F.col("set").alias("_y")), "b", F.col("a"))
    found = spread_join(found, sets.select(F.col("id").alias("a"), F.col("set").alias("_x")), "a", F.col("b"), found=heavy_values(pairs, "a"))
    both = F.size(F.array_intersect("_x", "_y"))
    return found.filter(100 * both >= least * (F.size("_x") + F.size("_y") - both)).select("a", "b").distinct()


def open_pairs(rest: DataFrame, sets: DataFrame, least: int, folder: str) -> DataFrame:
    """Pairs (a, b), a < b, of ``rest`` (id, root) in different components that can be
    similar enough. Only pairs that cannot be are left out; ``confirm`` decides the others.

    Two sets that are share one of their rarest shingles: of a set of n, one of the
    n - ceil(n * least / 100) + 1 rarest. The texts of a large group of loose copies
    differ in shingles of their own, so most of them meet nobody here. Where two sets
    meet in a shingle, they share at most that one, as many rarer ones as the lesser
    has that others hold too, and as many commoner ones as the lesser has. Of two sets
    with more than (100 - least) / (100 + least) of their shingles to themselves, none
    is similar enough; so one of each pair is ``light``, with fewer. The rows of a shingle
    that many hold are cut into blocks, and two blocks at a time meet in a task.
    """
    each = sets.join(rest.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", F.explode("set").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(common, "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    size = F.size("all")
    rare = ranked.select("id", size.alias("size"), F.slice("all", F.lit(1), (size - F.ceil(size * least / 100) + 1).cast("int")).alias("rare"))
    rare = rare.withColumn("own", F.size(F.filter("rare", lambda r: r["n"] == 1)))
    # A shingle of one text, or of one component, makes no pair.
    places = rare.select("id", "size", "own", F.posexplode("rare").alias("at", "r")).filter("r.n > 1")
    light = (100 + least) * F.col("own") <= (100 - least) * F.col("size")
    places = places.select("id", "size", light.alias("light"), F.col("r.shingle").alias("shingle"), (F.col("at") - F.col("own")).alias("rarer"), (F.col("size") - F.col("at") - 1).alias("commoner"))
    places = cut(places.join(rest, "id"), f"{folder}/places")
    mixed = places.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.max("light").alias("any")).filter("lo < hi and any")
    mixed = cut(mixed.select("shingle", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), f"{folder}/mixed")
    placed = spread_join(places, mixed, "shingle", F.col("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    turn = F.sequence(F.lit(0), F.col("blocks") - 1)
    named = lambda mark: [F.col("id").alias("a" if mark == "a" else "b"), *[F.col(c).alias(f"{c}_{mark}") for c in ("root", "size", "light", "rarer", "commoner")]]
    one = placed.filter("light").select("shingle", F.col("block").alias("i"), F.explode(turn).alias("j"), *named("a"))
    two = placed.select(F.col("shingle").alias("_shingle"), F.explode(turn).alias("_i"), F.col("block").alias("_j"), *named("b"))
    both = F.least("rarer_a", "rarer_b") + 1 + F.least("commoner_a", "commoner_b")
    enough = (100 + least) * both >= least * (F.col("size_a") + F.col("size_b"))
    once = (F.col("root_a") < F.col("root_b")) | ((F.col("root_a") > F.col("root_b")) & ~F.col("light_b"))
    met = (F.col("shingle") == F.col("_shingle")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & once & enough
    return one.join(two, met).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``df``.

    Linked are texts with ``100 * shared >= least * union`` of their shingle sets;
    ``least`` may be 80 or more: there, a pair shares no key about 3 times in a million.
    A text with fewer than five words is one shingle; without words, or null, it has
    none and is linked with nothing. ``component_id`` is the smallest identifier
    reached over links. Rows with one identifier are one document and stay or go
    together; a null identifier is in no component and stays. An empty table gives an
    empty result. Further columns of ``df`` are not used.
    """
    if least < 80:
        raise ValueError("similarity must be 80 hundredths or more")
    spark = df.sparkSession
    folder = new_folder(spark, "neardup")
    signed = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_sign, _SIGNED), f"{folder}/signed")
    classes = cut(signed.filter("set_id is not null and id is not null").groupBy("set_id").agg(F.min("id").alias("id"), F.first("sig").alias("sig")), f"{folder}/classes")
    keys = classes.select("id", "sig").mapInArrow(_keys, _KEYED)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(keys.join(shared, "key"), f"{folder}/members")

    width = members.groupBy("id").agg(F.sum("n").alias("width"))
    hubs = members.join(width, "id").groupBy("key").agg(F.max(F.struct("width", (-F.col("id")).alias("m"))).alias("h"))
    tried = members.join(hubs, "key").select(F.col("id").alias("a"), (-F.col("h.m")).alias("b")).filter("a <> b").distinct()
    tried = cut(_near(tried, classes), f"{folder}/tried")
    sets = shingle_sets(members.select("id"), df, id_col, text_col, f"{folder}/sets")  # once, for both confirmations: the texts are shuffled for it
    links = cut(confirm(tried, sets, least), f"{folder}/links")
    roots = components(links, f"{folder}/stars")

    placed = members.select("key", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    rest = cut(placed.join(open_keys, "key", "left_semi").select("id", "root").distinct(), f"{folder}/rest")
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(open_pairs(rest, sets, least, folder).join(done, ["a", "b"], "left_anti"), f"{folder}/more")
    further = cut(confirm(more, sets, least), f"{folder}/further")
    if not further.isEmpty():
        roots = components(links.unionByName(further), f"{folder}/stars-2")
    for name in ("members", "tried", "sets", "rest", "places", "mixed", "more"):
        remove(spark, f"{folder}/{name}")

    named = classes.select("set_id", "id").join(roots, "id", "left").select("set_id", F.coalesce("root", "id").alias("component_id"))
    out = spread_join(signed, named, "set_id", F.col("id"), "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
