"""License scans: an exact set-similarity join of text blocks with license templates, built-in functions only.

A block is a window of words; a template is found in it when enough of the template's distinct words
stand there (containment). Words are ordered by their document frequency over the whole table,
rarest first. A block can only hold ``need`` of a template's ``m`` words if one of the template's
first ``m - need + 1`` words stands in it (prefix filter), so only blocks around such words are
built; they meet the templates on equal prefix words, under the length and the positional filter,
and what is left is counted exactly. Nothing is approximate and nothing is capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import settle

# Phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: What separates words of a lower-cased text: all of ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_WORDS = 8
#: Templates with no more prefix words than this are broadcast to the blocks.
BROADCAST_WORDS = 100_000


@dataclass(frozen=True)
class Template:
    """A license notice, and the share of its distinct words that a block must hold."""

    label: str
    text: str
    containment: float = 0.8

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(BREAK, self.text.lower()) if w]

    @property
    def need(self) -> int:
        return max(1, math.ceil(round(self.containment * len(set(self.words)), 9)))

    @property
    def step(self) -> int:
        """Blocks start every ``step`` words and are twice as long, so that one holds any whole notice."""
        return 1 << (max(LEAST_WORDS, len(self.words)) - 1).bit_length()


# One-line statements (all words needed) and the notices that the licenses ask for.
TEMPLATES: tuple[Template, ...] = (
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", 1.0),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", 1.0),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", 1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", 1.0),
    Template("mit-notice", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software."""),
    Template("apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    Template("gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    Template("mpl-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    Template("bsd-notice", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution."""),
    Template("isc-notice", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
)


@dataclass(frozen=True)
class Compiled:
    """A template whose distinct words are ranks in the global order (0 is the rarest), ascending."""

    label: str
    step: int
    need: int
    ranks: tuple[int, ...]

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[: len(self.ranks) - self.need + 1]


def license_words(text: Column) -> Column:
    """Words of a text, lower-cased. A null text has none.

    The Kelvin sign is the one character outside ASCII that lower-cases to an ASCII letter; it becomes
    another letter first, so that no word with it equals a template's word.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ķ")))
    return F.array_remove(F.split(plain, BREAK), "")


def word_order(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> list[str]:
    """The templates' words by the number of documents that hold them, rarest first, ties by word.

    Counted over all documents. Only the templates' own words leave Spark.
    """
    known = sorted({w for t in templates for w in t.words})
    if not known:
        return []
    found = docs.select(F.explode(F.array_distinct(F.filter(license_words(F.col(text)), lambda w: w.isin(*known)))).alias("word"))
    count = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def compile_templates(templates: Sequence[Template], order: Sequence[str]) -> list[Compiled]:
    rank = {w: i for i, w in enumerate(order)}
    return [Compiled(t.label, t.step, t.need, tuple(sorted(rank[w] for w in set(t.words)))) for t in templates if t.words]


def _template_rows(spark: SparkSession, compiled: Sequence[Compiled]) -> DataFrame:
    """label, step, need, ranks: literals of the plan, as the templates are the caller's own list."""
    rows = [F.struct(F.lit(c.label).alias("label"), F.lit(c.step).alias("step"), F.lit(c.need).alias("need"), F.array(*[F.lit(r) for r in c.ranks]).alias("ranks")) for c in compiled]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _put(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", *[c.alias(name) for name, c in columns.items()])


def measure(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> tuple[DataFrame, list[Compiled]]:
    """doc_id, text_md5, n_words, phrase counts and the blocks that may hold a template, one row per document.

    A block is (step, block, ranks): its words that any template of that step has, as ascending ranks.
    """
    order = word_order(docs, templates, text)
    compiled = compile_templates(templates, order)
    steps = sorted({c.step for c in compiled})
    marks = {s: sorted({order[r] for c in compiled if c.step == s for r in c.prefix}) for s in steps}
    known = {s: sorted({order[r] for c in compiled if c.step == s for r in c.ranks}) for s in steps}
    openers = {p.split()[0] for p in PHRASES}
    asked = sorted(openers.union(*marks.values()))

    words = F.col("words")
    rows = _put(docs.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_md5"), F.col(text).alias("body")), words=license_words(F.col("body")))
    rows = _put(rows, at=F.filter(F.transform(words, lambda w, i: F.when(w.isin(*asked), i)), lambda i: i.isNotNull()))
    places = [_phrase_places(phrase.split()) for phrase in PHRASES]
    rows = rows.select("doc_id", "text_md5", "words", "at", F.struct(*[c.alias(f"p{k}") for k, c in enumerate(places)]).alias("places"))
    blocks = [_blocks(s, marks[s], known[s], order) for s in steps]
    shape = "array<struct<step:int,block:int,ranks:array<int>>>"
    held = F.concat(*blocks) if blocks else F.array()
    return rows.select("doc_id", "text_md5", F.size(words).alias("n_words"), "places", held.cast(shape).alias("blocks")), compiled


def _phrase_places(parts: Sequence[str]) -> Column:
    """Of the places ``at``, those where the parts stand one after the other."""
    def stands(i: Column) -> Column:
        out = F.lit(True)
        for k, part in enumerate(parts):
            out = out & F.coalesce(F.get("words", i + k) == part, F.lit(False))
        return out

    return F.filter("at", stands)


def _blocks(step: int, marks: Sequence[str], known: Sequence[str], order: Sequence[str]) -> Column:
    """The blocks around prefix words: numbered by ``step`` words, twice as long, the known words as ranks."""
    vocabulary = F.array(*[F.lit(w) for w in order])
    near = F.filter("at", lambda i: F.get("words", i).isin(*marks))
    numbers = F.array_distinct(F.flatten(F.transform(near, lambda i: F.array(F.floor(i / step).cast("int"), F.floor(i / step).cast("int") - 1))))

    def block(k: Column) -> Column:
        inside = F.array_distinct(F.filter(F.slice("words", k * step + 1, 2 * step), lambda w: w.isin(*known)))
        ranks = F.sort_array(F.transform(inside, lambda w: F.array_position(vocabulary, w).cast("int") - 1))
        return F.struct(F.lit(step).alias("step"), k.alias("block"), ranks.alias("ranks"))

    return F.transform(F.filter(numbers, lambda k: k >= 0), block)


def join_blocks(measured: DataFrame, compiled: Sequence[Compiled]) -> DataFrame:
    """doc_id, text_md5, label, first_word, n_block_words, overlap, containment: every block that meets a template.

    Documents that repeat id and text have the same blocks; their rows are repeated.
    """
    spark = measured.sparkSession
    shape = "doc_id, text_md5, label, first_word, n_block_words, overlap, containment"
    blocks = measured.select("doc_id", "text_md5", "n_words", F.inline("blocks"))
    templates = _template_rows(spark, compiled) if compiled else spark.range(0).selectExpr("'' AS label", "0 AS step", "0 AS need", "array(0) AS ranks")
    least = {}
    for c in compiled:
        least[c.step] = min(least.get(c.step, c.need), c.need)
    need = F.coalesce(*[F.when(F.col("step") == s, n) for s, n in least.items()], F.lit(1))
    size = F.size("ranks")
    # Prefix of a block: beyond it, a first common word would leave too few words behind it.
    probes = blocks.where(size >= need).select("*", F.posexplode(F.slice("ranks", 1, size - need + 1)).alias("j", "rank"))
    prefix = templates.select(
        "label", F.col("step").alias("t_step"), "need", F.col("ranks").alias("t_ranks"),
        F.posexplode(F.slice("ranks", 1, F.size("ranks") - F.col("need") + 1)).alias("i", "t_rank"),
    )
    if sum(len(c.ranks) for c in compiled) <= BROADCAST_WORDS:
        prefix = F.broadcast(prefix)
    pairs = probes.join(prefix, (F.col("step") == F.col("t_step")) & (F.col("rank") == F.col("t_rank"))).where(
        (size >= F.col("need"))  # length
        & (F.least(F.size("t_ranks") - F.col("i"), size - F.col("j")) >= F.col("need"))  # position
    )
    counted = pairs.select(
        "doc_id", "text_md5", "label", (F.col("block") * F.col("step")).cast("long").alias("first_word"),
        F.least(2 * F.col("step"), F.col("n_words") - F.col("block") * F.col("step")).cast("long").alias("n_block_words"),
        F.size(F.array_intersect("ranks", "t_ranks")).cast("long").alias("overlap"), F.size("t_ranks").alias("m"), "need", "rank",
        F.array_min(F.array_intersect("ranks", "t_ranks")).alias("least_common"),
    )
    # A pair that shares several prefix words is told once: at its rarest.
    return counted.where((F.col("rank") == F.col("least_common")) & (F.col("overlap") >= F.col("need"))).withColumn(
        "containment", F.col("overlap") / F.col("m")
    ).select(*shape.split(", "))


def find_blocks(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text") -> DataFrame:
    """Every text block of ``docs`` (doc_id, text) that holds enough of a template's words.

    Null and empty texts have no block. Documents that repeat id and text repeat their rows.
    """
    measured, compiled = measure(docs, templates, text)
    return join_blocks(settle(measured), compiled)


def license_report(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places of :data:`PHRASES`. ``labels`` adds those of the templates found. ``score`` is 1 where
    a phrase stands, else the greatest containment of a found template, else 0. Rows that repeat a
    doc_id, null ones too, are judged by their own text. A null text is empty; an empty table gives no rows.
    """
    measured, compiled = measure(docs, templates)
    rows = settle(measured)
    found = join_blocks(rows, compiled).groupBy(F.col("doc_id").alias("f_id"), F.col("text_md5").alias("f_md5")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best")
    )
    same = F.col("text_md5") == F.col("f_md5")
    joined = rows.drop("blocks").join(found, same & F.col("doc_id").eqNullSafe(F.col("f_id")), "left")
    lists = [F.col(f"places.p{k}") for k in range(len(PHRASES))]
    everywhere = F.concat(*lists)
    base = F.array_compact(F.array(*[F.when(F.size(x) > 0, label) for x, label in zip(lists, PHRASES.values())]))
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"), F.array_max(everywhere).cast("long").alias("last_word"),
        text_of(base).alias("base_labels"), text_of(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.when(F.size(everywhere) > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
