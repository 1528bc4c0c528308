"""Temperature mixing of sources, with DataFrame functions only.

Token shares p become q = p^a / sum p^a. One exponent a in [0, 1] is bisected to meet a target entropy
or a limit on repetition; the weights are then realised as passes over each source, every pass a
permutation of the source's blocks, the last one cut where the source's budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.llm.common import WORD_BREAK, settle


@dataclass(frozen=True)
class Target:
    """What the exponent must meet.

    ``entropy``: at least this fraction of the log of the number of sources, as far as the limit allows.
    ``max_repeat``: no source is passed over more often than this, per pass of the largest need.
    ``budget``: tokens to realise; None is the least budget that passes every source once at least.
    """

    entropy: float | None = None
    max_repeat: float | None = None
    budget: int | None = None


def n_tokens(text: Column) -> Column:
    """Words, and one more for the end of the document, so that empty texts count too."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, " "))
    return (F.length(plain) - F.length(F.translate(plain, " ", "")) + F.when(plain == "", 1).otherwise(2)).cast("long")


def _source(source: str) -> Column:
    """A key that keeps a null source apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def find_exponent(shares: DataFrame, target: Target, steps: int = 10, points: int = 15) -> tuple[float, float]:
    """The exponent, and the budget. ``shares``: tokens per source. Each step is one small job that
    evaluates ``points`` exponents at once, so it narrows the bracket as four bisections do."""
    total, n = shares.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n or not total:
        return 1.0, 0.0
    p = F.col("tokens") / F.lit(float(total))

    def judge(exponents: list[float]) -> list[tuple[bool, float]]:
        """Whether an exponent is high enough for the limit and low enough for the entropy; its budget."""
        aggs = []
        for a in exponents:
            aggs += [F.sum(F.pow(p, a)), F.sum(F.pow(p, a) * F.log(p)), F.max(F.pow(p, a - 1)), F.min(F.pow(p, a - 1))]
        row, out = shares.agg(*[x.alias(f"c{i}") for i, x in enumerate(aggs)]).first(), []
        for i, a in enumerate(exponents):
            z, h, most, least = row[4 * i : 4 * i + 4]
            budget = float(target.budget) if target.budget is not None else total * z / least
            within = target.max_repeat is None or budget / total * most / z <= target.max_repeat + 1e-12
            even = target.entropy is None or math.log(z) - a * h / z >= target.entropy * math.log(n) - 1e-12
            out.append((within, even, budget))
        return out

    def least(good) -> float:
        """The least exponent at which ``good`` holds; ``good`` never turns false as it grows. 1 if none."""
        low, high = 0.0, 1.0
        if good(judge([0.0])[0]):
            return 0.0
        for _ in range(steps):
            inner = [low + (high - low) * (i + 1) / (points + 1) for i in range(points)]
            held = [good(x) for x in judge(inner)]
            first = held.index(True) if True in held else points
            low, high = (inner[first - 1] if first else low), (inner[first] if first < points else high)
        return high

    a = least(lambda x: x[0]) if target.max_repeat is not None else 0.0
    if target.entropy is not None:
        # The most natural weights (largest exponent) that are still even enough; the limit goes first.
        a = max(a, least(lambda x: not x[1]))
    elif target.max_repeat is None:
        a = 1.0
    return a, judge([a])[0][2]


def schedule(sized: DataFrame, target: Target, seed: int) -> DataFrame:
    """Blocks to pass over: key, block, pass, rank, whole, room (tokens left for a block that is cut).

    ``sized`` has key, block and tokens per document. Windows only see block totals.
    """
    blocks = settle(sized.groupBy("key", "block").agg(F.sum("tokens").alias("tokens")))
    shares = settle(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")))
    a, budget = find_exponent(shares, target)
    z = shares.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z)
    # An aim within rounding of whole passes is whole passes: the last document must not fall to an ulp.
    times = F.lit(budget) * weight / F.col("tokens")
    exact = F.when(F.abs(times - F.round(times)) < 1e-9, F.round(times)).otherwise(times)
    aim = shares.select("key", weight.alias("weight"), (exact * F.col("tokens")).alias("aim"), F.col("tokens").alias("of_source"))
    passes = F.ceil(F.col("aim") / F.col("of_source")).cast("long")
    planned = blocks.join(aim, "key").where("aim > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(passes - 1, F.lit(0)))).alias("pass")
    )
    order = Window.partitionBy("key", "pass").orderBy(_hash(seed, F.col("key"), F.col("pass"), F.col("block")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("aim") - F.col("pass") * F.col("of_source") - F.col("before")
    return (
        planned.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("before", before)
        .withColumn("room", room).where("room > 0")
        .select("key", "block", "pass", "rank", "weight", "room", (F.col("tokens") <= F.col("room")).alias("whole"))
    )


def mix(docs: DataFrame, target: Target, source: str = "source", text: str = "text", seed: int = 17, block_docs: int = 1024) -> DataFrame:
    """Rows of ``docs``, each as often as its source's weight asks, with a struct column ``mix``.

    ``mix`` holds weight, pass (from 0), block, rank (place of the block in the pass) and tokens. A
    source gets at most its share of the budget: blocks in permuted order, and of the block in which
    the budget ends the documents in hash order that still fit. Null sources form one source; null
    texts count one token; repeated rows are rows of their own. No rows give no rows.

    Documents fall into blocks by a hash, about ``block_docs`` each, so a source with a third of
    all rows is many blocks; the window over documents only sees blocks that are cut, one per source.
    """
    own = "mix"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    name = lambda c: f"{own}__{c}"
    keyed = docs.select("*", _source(source).alias(name("key")), n_tokens(F.col(text)).alias(name("tokens")), F.xxhash64("doc_id", text).alias(name("h")))
    counts = settle(keyed.groupBy(name("key")).count())
    blocked = keyed.join(counts.withColumnRenamed("count", name("count")), name("key")).withColumn(
        name("block"), F.pmod(F.col(name("h")), F.greatest(F.lit(1), F.ceil(F.col(name("count")) / block_docs)).cast("long"))
    )
    sized = blocked.select(F.col(name("key")).alias("key"), F.col(name("block")).alias("block"), F.col(name("tokens")).alias("tokens"))
    plan = settle(schedule(sized, target, seed))
    plan = plan.select(*[F.col(c).alias(name("p_" + c)) for c in plan.columns])
    met = blocked.join(plan, (F.col(name("key")) == F.col(name("p_key"))) & (F.col(name("block")) == F.col(name("p_block"))))
    detail = F.struct(
        F.col(name("p_weight")).alias("weight"), F.col(name("p_pass")).alias("pass"), F.col(name("block")).alias("block"),
        F.col(name("p_rank")).alias("rank"), F.col(name("tokens")).alias("tokens"),
    ).alias(own)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = met.where(F.col(name("p_whole"))).select(*columns, detail)
    cut = Window.partitionBy(name("key"), name("p_pass"), name("block")).orderBy(_hash(seed, F.col(name("p_pass")), F.col(name("h"))), "doc_id")
    part = met.where(~F.col(name("p_whole"))).withColumn(name("sum"), F.sum(name("tokens")).over(cut.rowsBetween(Window.unboundedPreceding, 0)))
    return whole.unionByName(part.where(F.col(name("sum")) <= F.col(name("p_room"))).select(*columns, detail))
