"""Source divergence audit: which terms set a source of a language apart, and how far sources differ.

Terms are counted per (lang, source) in the tasks that read the texts, then added up by Spark. A
source's leading terms come from a dominance skyband: partitions of a source's terms keep those that
fewer than k others dominate (higher count in the group, lower count in the language, earlier in
UTF-8), skybands are merged, and what is left is ranked exactly. The value of a term rises with the
first count and falls with the second, so a term that k others dominate cannot be among the first k.
Distances between sources are summed over dense lots of terms, block of sources by block of sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import settle, small_batches

TOP_TERMS = 200
LEAST_DOCS = 3
SCALE = 1_000_000_000  # fixed value: probabilities are whole billionths
HELD_TERMS = 400_000  # entries a counting task holds before it passes them on
LOT_ROWS = 200_000  # facts of one task of the distance sums
BAND_ROWS = 20_000  # terms of one task of the skyband
SOURCE_BLOCK = 64
CELLS = 1 << 21

# Letters of ASCII in lower case and all bytes beyond ASCII stay; the rest separates terms.
_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs: one row per term of a group. Nulls read as ''.

    Tasks add up what they read before anything is shuffled, and hold a bounded number of entries.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Counter]] = {}
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), (seen, in_docs) in held.items():
                n = len(seen)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(seen), pa.binary()),
                    pa.array(list(seen.values()), pa.int64()), pa.array([in_docs[t] for t in seen], pa.int64()),
                ], names=["lang", "source", "term", "n", "n_docs"])
            held.clear()

        for batch in small_batches(batches):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
                seen, in_docs = held.setdefault((lang, source), [Counter(), Counter()])
                before = len(seen)
                here = Counter(terms_of(text))
                seen.update(here)
                in_docs.update(here.keys())
                size += len(seen) - before
                if size > HELD_TERMS:
                    yield from emptied()
                    size = 0
        yield from emptied()

    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(run, "lang string, source string, term binary, n long, n_docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any count of a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1), wide(total))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): p and q stay near SCALE at most, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(group: np.ndarray, lang: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Rows that fewer than k others dominate: group count not lower, lang count not higher, place not later.

    Rows are unlike in ``place``. Whoever dominates a row comes before it in the order below, and of
    the rows that dominate a dropped one at least k are kept: counting against kept rows is enough.
    """
    order = np.lexsort((place, lang, -group))
    lang_kept, place_kept = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    n, kept = 0, []
    for at in range(0, len(order), 256):
        rows = order[at : at + 256]
        by = ((lang_kept[None, :n] <= lang[rows, None]) & (place_kept[None, :n] <= place[rows, None])).sum(axis=1)
        rows, by = rows[by < k], by[by < k]
        # Among the lot itself: earlier rows of it, whether kept or not, change nothing below k.
        inner = np.tril((lang[rows][None, :] <= lang[rows][:, None]) & (place[rows][None, :] <= place[rows][:, None]), -1).sum(axis=1)
        stay = rows[by + inner < k]
        lang_kept[n : n + len(stay)], place_kept[n : n + len(stay)] = lang[stay], place[stay]
        n += len(stay)
        kept.append(stay)
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def _bands(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["term"].to_numpy()
        place = np.empty(len(names), np.int64)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        return pdf.iloc[skyband(pdf["n"].to_numpy(np.int64), pdf["lang_n"].to_numpy(np.int64), place, k)]

    return run


def leading_terms(facts: DataFrame, k: int = TOP_TERMS) -> DataFrame:
    """The first k terms of every (lang, source) by value, ties by UTF-8: facts plus value and rank.

    ``facts`` has lang, source, term, n, lang_n, p, q and a distinct term per group. Only terms with p > q count.
    """
    rows = settle(facts.where("p > q").select("lang", "source", "term", "n", "lang_n", "p", "q"))
    schema, group = rows.schema, ["lang", "source"]
    while True:
        sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BAND_ROWS).cast("int").alias("bands"))
        most = sizes.agg(F.max("bands")).first()[0] or 0
        salted = rows.join(sizes, group).withColumn("band", F.pmod(F.xxhash64("term"), F.col("bands")))
        kept = settle(salted.groupBy(*group, "band").applyInPandas(lambda pdf: _bands(k)(pdf)[schema.names], schema))
        shrunk = most > 1 and kept.count() < 0.7 * rows.count()
        rows = kept
        if not shrunk:  # one band a group, or bands that hardly thin out any more: the ranking takes the rest
            break
    ranked = rows.withColumn("value", divergence(F.col("p"), F.col("q")))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distances(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: divergence of every source from every other of its lang, over all kept terms.

    ``groups`` has lang, source, p0 (share of a term that the group lacks) and v (kept terms of the
    lang, 0 if none). Sums run over the terms that occur in either source, less what they would
    add were they absent; the absent share is added once for all v terms.
    """
    order = Window.partitionBy("lang").orderBy("source")
    listed = settle(groups.withColumn("place", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("place") / SOURCE_BLOCK).cast("int")))
    blocks = listed.groupBy("lang").agg(F.max("block").alias("last"))
    sized = facts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / LOT_ROWS).cast("int").alias("lots"))
    plan = blocks.join(sized, "lang", "left").withColumn("lots", F.coalesce("lots", F.lit(1)))
    tiles = lambda own, last: F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.least(b, own).alias("one"), F.greatest(b, own).alias("other")))
    placed = facts.select("lang", "source", "term", "p").join(listed.select("lang", "source", "place", "block"), ["lang", "source"]).join(plan, "lang")
    cells = placed.select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), F.col("lots")).cast("int").alias("lot"), F.inline(tiles(F.col("block"), F.col("last"))))
    lists = listed.join(plan, "lang").select("lang", "place", "p0", "v", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "block", "last")
    # Written, so that the two sides of the grouping below do not share columns.
    lists = settle(lists.select("lang", "place", "p0", "v", "lot", F.inline(tiles(F.col("block"), F.col("last")))))
    block_size = SOURCE_BLOCK

    def lot(cell: pd.DataFrame, listing: pd.DataFrame) -> pd.DataFrame:
        lang, number, one, other = listing[["lang", "lot", "one", "other"]].iloc[0]
        listing = listing.sort_values("place")
        place, p0, v = listing["place"].to_numpy(np.int64), listing["p0"].to_numpy(np.int64), int(listing["v"].iloc[0])
        # Rows are sources of either block; both directions of a pair come from the same tile.
        side = place // block_size
        left, right = np.flatnonzero(side == one), np.flatnonzero(side == other)
        ways = [(left, right)] if one == other else [(left, right), (right, left)]
        sums = [np.zeros((len(a), len(b)), np.int64) for a, b in ways]
        absent = [_cell(p0[a][:, None], p0[b][None, :]) for a, b in ways]
        term = cell["term"].factorize()[0]
        by = np.argsort(term, kind="stable")
        term, at, p = term[by], np.searchsorted(place, cell["place"].to_numpy(np.int64))[by], cell["p"].to_numpy(np.int64)[by]
        n_terms = int(term[-1]) + 1 if len(term) else 0
        lot_terms = max(1, CELLS // max(1, len(left) * len(right)))
        for first in range(0, n_terms, lot_terms):
            lo, hi = np.searchsorted(term, [first, first + lot_terms])
            dense = np.repeat(p0[None, :], min(lot_terms, n_terms - first), axis=0)
            dense[term[lo:hi] - first, at[lo:hi]] = p[lo:hi]
            for total, base, (a, b) in zip(sums, absent, ways):
                total += (_cell(dense[:, a, None], dense[:, None, b]) - base).sum(axis=0)
        out = []
        for total, base, (a, b) in zip(sums, absent, ways):
            value = total + (v * base if number == 0 else 0)
            i, j = np.meshgrid(place[a], place[b], indexing="ij")
            out.append(pd.DataFrame({"lang": lang, "a": i.ravel(), "b": j.ravel(), "value": value.ravel()}))
        out = pd.concat(out)
        return out[out["a"] != out["b"]]

    parts = cells.groupBy("lang", "lot", "one", "other").cogroup(lists.groupBy("lang", "lot", "one", "other")).applyInPandas(lot, "lang string, a long, b long, value long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda key, out: listed.select("lang", F.col("place").cast("long").alias(key), F.col("source").alias(out))
    named = summed.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    return named.select("lang", "source", "item", "value")


def _cell(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(q, 1)


def divergence_report(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: distances (part ``pair``) and leading terms (part ``term``).

    ``docs`` has text, lang, source; nulls read as '', an empty table gives no rows, repeated rows
    count as often as they stand, other columns are not read. A lang without kept terms has
    distances of 0; a source without terms has distances, but no terms of its own.
    """
    counts = settle(count_terms(docs))
    kept = settle(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("in_docs")).where(F.col("in_docs") >= LEAST_DOCS).drop("in_docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    found = settle(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    whole = F.col("total") + F.col("v")
    groups = settle(
        named.join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), whole)).otherwise(0))
    )
    facts = settle(
        found.join(groups.select("lang", "source", "v", "total", "lang_total"), ["lang", "source"]).select(
            "lang", "source", "term", "n", "lang_n", share(F.col("n"), whole).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q")
        )
    )
    terms = leading_terms(facts).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(facts, groups.select("lang", "source", "p0", "v")).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)
