"""Quality by weak supervision (operator 3).

Rules look at a few counts of a text and vote good, bad, or abstain. Nobody says
which rule is right: expectation-maximisation over the counts of vote patterns
estimates how often each rule agrees with the hidden quality, and the posterior
probability of good quality takes the place of all-must-pass filtering.

Counts come from native array functions over the whole text, in one pass and in
n log n time. There are at most 3**rules vote patterns, so what the driver fits
on is bounded whatever the size of the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, text_of, words

THRESHOLD = 0.5


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _repeat_words(ws: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the array ``ws``.

    A window's hash and position share one integer, so that sorting plain integers
    brings equal windows together; neighbours confirm by the full hash.
    """

    def covered(hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(hashes)))
        tagged = F.transform(hashes, lambda h, i: _left(_right(h, bits), bits).bitwiseOR(i.cast("long")))

        def spans(s: Column) -> Column:
            at = lambda x: (x.bitwiseAND(_left(F.lit(1).cast("long"), bits) - 1)).cast("int")
            same = lambda x, y: F.coalesce((_right(x, bits) == _right(y, bits)) & (F.get(hashes, at(x)) == F.get(hashes, at(y))), F.lit(False))
            twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
            starts = F.array_sort(F.transform(twice, at))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        return let(F.sort_array(tagged), spans)

    windows = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    # Most texts repeat nothing: the sort is for those whose hashes are fewer than their windows.
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts of its texts (null: none) as columns ``q_*`` (long)."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measured = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"), F.size(F.filter(x, lambda y: y.rlike("[.!?:;\"')]" + SPACE + "*$"))).alias("p")))
    out = df.withColumns({"_w": measured, "_l": counts})
    return out.withColumns(
        {
            "q_words": F.col("_w.n").cast("long"),
            "q_repeat_words": F.col("_w.r").cast("long"),
            "q_word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "q_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "q_symbol_ends": F.regexp_count(text, F.lit("[#*$%&|<>](?=[\\x20\\x09-\\x0D]|\\z)")).cast("long"),
            "q_not_letters": F.length(F.regexp_replace(text, "[\\p{L}\\x20\\x09-\\x0D]+", "")).cast("long"),
            "q_capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
            "q_marks": (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long"),
            "q_lines": F.col("_l.n").cast("long"),
            "q_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("long"),
            "q_ended_lines": F.col("_l.p").cast("long"),
        }
    ).drop("_w", "_l")


def votes() -> dict[str, Column]:
    """Name of each rule and its vote over the ``q_*`` columns: 1 good, -1 bad, 0 abstain."""
    n, chars, lines = F.col("q_words"), F.col("q_word_chars"), F.col("q_lines")
    say = lambda good, bad: F.when(n == 0, -1).when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": say(n >= 80, n < 30),
        "symbol_ends": say(F.col("q_symbol_ends") * 50 <= n, F.col("q_symbol_ends") * 10 > n),
        "letters": say(F.col("q_not_letters") * 10 <= chars, F.col("q_not_letters") * 20 > chars * 3),
        "symbols": say(F.col("q_symbols") * 100 <= n, F.col("q_symbols") * 10 > n),
        "repeats": say(F.col("q_repeat_words") * 10 <= n, F.col("q_repeat_words") * 3 > n),
        "lines": say(F.col("q_dup_lines") * 10 <= lines, F.col("q_dup_lines") * 3 > lines),
        "word_size": say(chars.between(n * 3, n * 9), ~chars.between(n * 2, n * 12)),
        "capitals": say(F.col("q_capitals") * 10 <= chars, F.col("q_capitals") * 3 > chars),
        "marks": say(F.col("q_marks") * 20 <= n, F.col("q_marks") * 5 > n),
        "ended": say(F.col("q_ended_lines") * 2 >= lines, F.col("q_ended_lines") * 10 < lines),
    }


@dataclass(frozen=True)
class LabelModel:
    """Prior of good quality and, by rule, the chance to be right on good and on bad texts."""

    prior: float
    right: dict[str, tuple[float, float]]
    rounds: int


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200, prior_share: float = 0.05) -> LabelModel:
    """Expectation-maximisation over (votes, rows).

    Texts are good or bad; given that, rules vote independently when they do not
    abstain. A rule that looks at one kind of fault passes most bad texts, so its
    chance to be right on bad ones starts low and is free; on good ones it starts
    high and stays over 0.8, which keeps the two classes from changing places. The
    starting values weigh as much as ``prior_share`` of the rows. Without rows they
    are the answer.
    """
    start_good, start_bad, start_prior = 0.97, 0.4, 0.85
    vote = np.array([v for v, _ in patterns], dtype=np.int8).reshape(len(patterns), len(names))
    rows = np.array([n for _, n in patterns], dtype=np.float64)
    yes, no, total = vote > 0, vote < 0, rows.sum()
    weight = max(1.0, prior_share * total)
    prior, good, bad = start_prior, np.full(len(names), start_good), np.full(len(names), start_bad)
    done = 0
    for done in range(1, rounds + 1):  # noqa: B007
        odds = math.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
        mass = rows / (1 + np.exp(-odds))
        new_prior = (mass.sum() + weight * start_prior) / (total + weight)
        a = (mass @ yes + start_good * weight) / (mass @ (yes | no) + weight)
        b = ((rows - mass) @ no + start_bad * weight / 5) / ((rows - mass) @ (yes | no) + weight / 5)
        a = np.clip(a, 0.8, 0.9995)
        b = np.clip(b, 1.01 - a, 0.99)
        moved = max(abs(new_prior - prior), np.abs(a - good).max(), np.abs(b - bad).max())
        prior, good, bad = float(new_prior), a, b
        if moved < 1e-6:
            break
    return LabelModel(prior, {k: (float(x), float(y)) for k, x, y in zip(names, good, bad, strict=True)}, done)


def posterior(vote: tuple[int, ...], names: list[str], prior: float, right: dict[str, tuple[float, float]]) -> float:
    """Probability of good quality given the votes."""
    odds = math.log(prior / (1 - prior))
    for v, name in zip(vote, names, strict=True):
        a, b = right[name]
        odds += math.log(a / (1 - b)) if v > 0 else math.log((1 - a) / b) if v < 0 else 0.0
    return 1 / (1 + math.exp(-odds))


def judge(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> tuple[DataFrame, LabelModel]:
    """All rows of ``df``, its columns (or those in ``keep``) with counts ``q_*``, votes ``v_*``, ``q_quality``
    (posterior) and ``q_kept`` (posterior at or over the threshold), and the model.

    The counts are written once to the shared folder. A null text counts as empty:
    it has no words, every count-based rule calls it bad. Equal texts get equal
    verdicts; an empty table gives an empty result and the starting model. Columns
    of ``df`` with the added names are replaced.
    """
    rules = votes()
    counted = features(df, text_col).withColumns({f"v_{k}": v.cast("int") for k, v in rules.items()})
    if keep is not None:
        counted = counted.select(*keep, *[c for c in counted.columns if c.startswith(("q_", "v_")) and c not in keep])
    counted = cut(counted)
    names = list(rules)
    patterns = counted.groupBy(*[f"v_{k}" for k in names]).count().collect()  # at most 3 ** len(names) rows
    model = fit(sorted((tuple(r[:-1]), r[-1]) for r in patterns), names)
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for k in names:
        a, b = model.right[k]
        odds = odds + F.when(F.col(f"v_{k}") > 0, math.log(a / (1 - b))).when(F.col(f"v_{k}") < 0, math.log((1 - a) / b)).otherwise(0.0)
    out = counted.withColumn("q_quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("q_kept", F.col("q_quality") >= threshold), model
