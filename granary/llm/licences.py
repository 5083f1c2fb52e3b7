"""Licence scan by diagonal voting (operator 8).

Templates are whole licence texts, short notices and licence passages. Every word k-gram
of a text is joined by hash to the places of the same k-gram in the templates; a match
votes for the diagonal (place in the text minus place in the template). Neighbouring
diagonals of one template are one occurrence with words put in or left out. Its span is
verified: enough of the template's words must stand there, compared as words, and few
others between them; short templates must stand there whole, and longer ones with the
words that name their licence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

GRAM = 3
GAP = 2  # diagonals up to this far apart are neighbours
COVERAGE = 0.6  # share of the words of a template, or of the span where that is longer
SHORT = 10  # templates of fewer words must be found whole
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``names``: words of the text that name the licence; an occurrence without one of them is none."""

    label: str
    text: str
    base: bool = False
    names: str = ""

    def needed(self) -> list[int]:
        """Places of the words that an occurrence must hold."""
        ws = self.text.split(" ")
        return [k for k, w in enumerate(ws) if len(ws) < SHORT or w in self.names.split(" ")]


# The base phrases of the contract.
BASE = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

# Public licence notices and opening passages.
NOTICES = (
    Template("mit-notice", "released under the mit license"),
    Template("mit-notice", "licensed under the mit license"),
    Template("apache-notice", "licensed under the apache license version 2 0"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3", names="gnu general public"),
    Template("cc-notice", "licensed under cc by nc 4 0"),
    Template("cc-notice", "this work is licensed under a creative commons attribution 4 0 international license", names="creative commons"),
    Template("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0", names="mozilla"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", names="apache"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", names="gnu general public"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
)


# Whole texts of short public licences, without names and years.
LICENCES = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "bsd-2-clause-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
    ),
    Template(
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ),
)


def licence_words(text: Column) -> Column:
    """Words of the A-Z lower-cased text: runs of ASCII letters, digits and non-ASCII characters."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, _SPLIT), lambda w: w != "")


def template_places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, words, size, gram, at): a row for each k-gram of each template.

    A template shorter than GRAM is one gram of its own size. The table is as large
    as the list of templates, a fixed bound.
    """
    rows = []
    for number, t in enumerate(templates):
        ws = t.text.split(" ")
        k = min(GRAM, len(ws))
        rows += [(number, t.label, t.base, len(ws), k, " ".join(ws[i : i + k]), i) for i in range(len(ws) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, words int, size int, gram string, at int")


def word_grams(ws: Column, sizes: list[int]) -> Column:
    """(at, gram) of every rolling k-gram of the word array, for each k of ``sizes``."""

    def of_size(w: Column, k: int) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.struct(i.alias("at"), F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, k)]).alias("gram")))

    return let(ws, lambda w: F.concat(*[of_size(w, k) for k in sizes]))


def occurrences(df: DataFrame, templates: tuple[Template, ...], text: Column, keys: list[str], gap: int = GAP, coverage: float = COVERAGE) -> DataFrame:
    """Verified occurrences (keys, label, base, first, last, score) in the texts of ``df``;
    first and last are places of words, the score is the number of the template's words found,
    over its words or over those of the span, whichever are more.

    The grams of a text stay in its task: the join is against the table of templates,
    which is broadcast, and only matches are shuffled. Base phrases count place by place.
    """
    places = template_places(df.sparkSession, templates)
    sizes = sorted({min(GRAM, len(t.text.split(" "))) for t in templates})
    grams = df.select(*keys, F.explode(word_grams(licence_words(text), sizes)).alias("_g")).select(*keys, F.col("_g.at").alias("place"), F.col("_g.gram").alias("gram"))
    places = places.select("template", "label", "base", "words", "size", "at", F.xxhash64("gram").alias("_hash"), F.col("gram").alias("_gram"))
    same = (F.xxhash64("gram") == F.col("_hash")) & (F.col("gram") == F.col("_gram"))  # by hash, then as words
    votes = grams.join(F.broadcast(places), same).withColumn("diagonal", F.col("place") - F.col("at"))
    by = [*keys, "template", "label", "base", "words", "size", "diagonal"]
    # Repeated rows vote once: places are distinct on a diagonal.
    lines = votes.groupBy(*by).agg(F.collect_set("at").alias("seen"), F.min("place").alias("first"), F.max("place").alias("last"))
    order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    near = F.when(F.col("base") | (F.col("words") <= GRAM), F.lit(1)).otherwise(F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1)))
    runs = lines.withColumn("_new", near).withColumn("_run", F.sum("_new").over(order))
    whole = runs.groupBy(*keys, "template", "label", "base", "words", "size", "_run").agg(F.flatten(F.collect_list("seen")).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.array_distinct(F.flatten(F.transform("seen", lambda at: F.sequence(at, at + F.col("size") - 1))))
    last = F.col("last") + F.col("size") - 1
    needed = df.sparkSession.createDataFrame([(k, t.needed()) for k, t in enumerate(templates)], "template int, needed array<int>")
    whole = whole.withColumn("covered", covered).join(F.broadcast(needed), "template").filter(F.size(F.array_except("needed", "covered")) == 0)
    found = whole.select(*keys, "label", "base", "first", last.alias("last"), (F.size("covered") / F.greatest(F.col("words"), last - F.col("first") + 1)).alias("score"))
    return found.filter(F.col("score") >= coverage)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES + LICENCES) -> DataFrame:
    """One row for each row of ``df``: identifier, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (their smallest and largest start),
    ``base_labels``, ``labels`` (with those of other templates), ``score`` (largest
    score of an occurrence, 0 without any) and ``spans`` (label, first, last).

    A null text counts as empty: no words, no labels, null places, score 0. Repeated
    rows get the result of their text each. Overlapping occurrences all count. Texts are
    read whole; an empty table gives an empty result. Other columns are not used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.select(F.col(id_col), F.xxhash64(text).alias("_text"), text.alias("_t"))
    spans = occurrences(keyed, templates, F.col("_t"), [id_col, "_text"])
    per = spans.groupBy(F.col(id_col).alias("_i"), F.col("_text").alias("_k")).agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label"))).alias("spans"),
    )
    counted = keyed.select(id_col, "_text", F.size(licence_words(F.col("_t"))).cast("long").alias("n_words"))
    out = counted.join(per, counted[id_col].eqNullSafe(per["_i"]) & (counted["_text"] == per["_k"]), "left")
    return out.select(
        counted[id_col],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"),
        F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
