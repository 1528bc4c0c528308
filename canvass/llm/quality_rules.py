"""Quality rules: a threshold table compiled into one projection, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import settle, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he",
    "this", "are", "or", "his", "from", "at", "which", "but", "have", "an", "had", "they", "you", "were", "their",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "en", "que", "qui", "dans", "pour", "pas", "au",
    "par", "sur", "ce", "il", "plus", "ne", "se", "aux", "avec",
    "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "dem", "nicht", "ein", "eine", "sich", "auf", "für",
    "als", "auch", "es", "im", "er", "sie",
    "el", "los", "las", "y", "con", "del", "al", "por", "para", "su", "una", "lo", "como", "no", "más",
)


@dataclass(frozen=True)
class Rule:
    """A metric must lie in [low, high]; an open side is None. Metrics are null-free."""

    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value, tests = F.col(self.metric), []
        if self.low is not None:
            tests.append(value >= self.low)
        if self.high is not None:
            tests.append(value <= self.high)
        out = F.lit(True)
        for test in tests:
            out = out & test
        return out


#: The table. Ratios are per word or per line with a word.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.03),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _repeat_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more. ``grams`` is sorted by window, then position."""
    same = lambda j, k: F.coalesce(F.get(grams, j)["g"] == F.get(grams, k)["g"], F.lit(False))
    found = F.filter(
        F.when(F.size(grams) > 1, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>")),
        lambda j: same(j, j - 1) | same(j, j + 1),
    )
    at = F.transform(found, lambda j: F.get(grams, j)["i"])
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus one struct column ``quality`` with counts and ratios.

    A null or empty text has no words and no lines: its counts and ratios are 0. The work
    is one projection per row (no shuffle), so copies, hot sources and ties do not matter.
    Columns of ``docs`` keep their names; inner columns live in a struct under a name that
    is made free of clashes.
    """
    own = "quality"
    while any(name.startswith(own) for name in docs.columns):
        own += "_"
    # Plain columns, not struct fields: the optimizer copies a struct's fields into every use.
    c = lambda name: F.col(f"{own}__{name}")
    put = lambda df, **cols: df.select("*", *[e.alias(f"{own}__{k}") for k, e in cols.items()])
    split = put(
        put(docs, t=F.coalesce(F.col(text), F.lit(""))),
        w=words_of(F.col(text)),
        l=F.filter(F.split(c("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    n = F.size(c("w"))
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: [F.get(c("w"), i + k) for k in range(3)]
    # Equal windows have equal hashes: a text whose hashes all differ repeats none, and only
    # the others pay for comparing the windows themselves.
    hashed = put(split, g=F.transform(starts, lambda i: F.xxhash64(*window(i))))
    repeats = put(hashed, s=F.when(
        F.size(F.array_distinct(c("g"))) < F.size(c("g")),
        F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i")))),
    ))
    counts = {
        # True for every row, but not known to be: a filter on what follows is not moved below this projection,
        # where it would copy the lists above into its lambdas and build them again for each element.
        "n_words": F.when(F.spark_partition_id() >= 0, n),
        "word_chars": F.length(F.array_join(c("w"), "")),
        "n_symbols": F.length(F.regexp_replace(c("t"), r"[^#*$%&|<>]+", "")),
        "n_lines": F.size(c("l")),
        "n_dup_lines": F.size(c("l")) - F.size(F.array_distinct(c("l"))),
        "n_stop_words": F.size(F.filter(c("w"), lambda w: w.isin(*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS]))),
        "n_bullet_lines": F.size(F.filter(c("l"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(c("l"), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "n_repeat_words": F.when(c("s").isNull(), 0).otherwise(_repeat_words(c("s"))),
    }
    counted = repeats.select(*[F.col(f"`{x}`") for x in docs.columns], *[e.cast("long").alias(f"{own}__{k}") for k, e in counts.items()])
    ratio = lambda a, b: F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(0.0))
    return counted.select(*[F.col(f"`{x}`") for x in docs.columns], F.struct(
        *[c(name).alias(name) for name in counts],
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
    ).alias(own))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` plus the struct of :func:`quality_metrics`, extended by ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows.
    ``kept``: not ``base_failed`` and every rule of the table holds.
    """
    measured = quality_metrics(docs, text)
    own = measured.columns[-1]
    c = lambda name: F.col(f"{own}.{name}")
    failed = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    kept = ~failed
    for rule in rules:
        kept = kept & Rule(f"{own}.{rule.metric}", rule.low, rule.high).holds()
    fields = [f.name for f in measured.schema[own].dataType.fields]
    return measured.withColumn(own, F.struct(*[c(f).alias(f) for f in fields], failed.alias("base_failed"), kept.alias("kept")))


def rule_report(docs: DataFrame) -> DataFrame:
    """The digest of every document."""
    ruled = apply_rules(docs)
    own = ruled.columns[-1]
    return ruled.select("doc_id", *[
        F.col(f"{own}.{name}").alias(name)
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                     "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")
    ])


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    The verdicts are written first: a filter pushed below the projection would copy its expressions
    into each other.
    """
    ruled = settle(apply_rules(docs, rules))
    return ruled.where(F.col(f"{ruled.columns[-1]}.kept")).drop(ruled.columns[-1])
