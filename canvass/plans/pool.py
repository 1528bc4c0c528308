"""Candidate pools: request tables, one sampling plan, routing filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.parsing import valid_score
from canvass.functions.slots import cell_answered, cell_answered_option, cell_eligible
from canvass.plans import copula, requests
from canvass.plans.allocation import weighted_requests
from canvass.plans.domains import refuse_unsupported, valid_time
from canvass.plans.vectors import (
    ConditionalTarget, CountTarget, MeanTarget, ShareTarget, Target, membership,
)
from canvass.scale import explode_count
from canvass.session import materialise


@dataclass(frozen=True)
class RoutingRule:
    """When ``column`` holds ``option_key``: forbidden columns stay empty, required ones are answered.

    Columns are (name, "ordinal" | "answer_slot").
    """

    column: str
    option_key: str
    forbidden: tuple[tuple[str, str], ...] = ()
    required: tuple[tuple[str, str], ...] = ()


def _answered(column: tuple[str, str]) -> Column:
    name, kind = column
    return F.col(name).try_cast("double").isNotNull() if kind == "ordinal" else cell_answered(F.col(name))


def misrouted(rules: Sequence[RoutingRule]) -> Column:
    def broken(rule: RoutingRule) -> Column:
        wrong = [_answered(x) for x in rule.forbidden] + [~_answered(x) for x in rule.required]
        return cell_answered_option(F.col(rule.column), rule.option_key) & reduce(
            lambda a, b: a | b, wrong, F.lit(False)
        )

    return reduce(lambda a, b: a | b, [broken(r) for r in rules], F.lit(False))


def drop_misrouted(candidates: DataFrame, rules: Sequence[RoutingRule]) -> DataFrame:
    """Candidates that break no rule. The outer explode keeps Spark from pushing the rules below the projection
    that makes the cells, where every use of a cell in a rule would make it again."""
    if not rules:
        return candidates
    flag = f"__misrouted{len(candidates.columns)}"
    return candidates.select("*", F.explode_outer(F.array(misrouted(rules))).alias(flag)).where(~F.col(flag)).drop(flag)


@dataclass(frozen=True)
class Job:
    """One augmentation: a flat source table, targets, and the final number of rows.

    The first mean is the primary one: the pool is directed by its scores.
    """

    final_count: int
    means: tuple[MeanTarget, ...] = ()
    shares: tuple[ShareTarget, ...] = ()
    counts: tuple[CountTarget, ...] = ()
    conditionals: tuple[ConditionalTarget, ...] = ()
    categorical: tuple[str, ...] = ()
    time_column: str | None = "submitted_at"
    seed: int = 1
    pool_size: int | None = None
    rules: tuple[RoutingRule, ...] = ()

    @property
    def targets(self) -> tuple[Target, ...]:
        return (*self.means, *self.shares, *self.counts, *self.conditionals)

    @property
    def scores(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(m.column for m in self.means))

    def default_pool_size(self, additions: int) -> int:
        floor = 800 if self.conditionals else 500 if self.shares or self.counts else 200
        return self.pool_size or max(additions * 20, floor)


def _scores(source: DataFrame, mean: MeanTarget | None, plan: dict[int, int], additions: int) -> DataFrame:
    """(key, score, required) of one mean; without a mean one request row without a score."""
    spark = source.sparkSession
    if mean is None:
        return spark.range(1).select(
            F.lit("run").alias("key"), F.lit(None).cast("double").alias("score"), F.lit(additions).cast("long").alias("required")
        )
    planned = spark.createDataFrame(
        [("run", float(s), int(n)) for s, n in plan.items()], "key string, score double, required long"
    )
    observed = source.where(valid_score(F.col(mean.column), F.lit(mean.minimum), F.lit(mean.maximum))).select(
        F.lit("run").alias("key"), F.col(mean.column).cast("double").alias("score")
    )
    return requests.expanded_scores(planned, observed)


def request_table(
    source: DataFrame, job: Job, additions: int, pool_size: int, plans: dict[str, dict]
) -> tuple[DataFrame, list[tuple[str, ...]]]:
    """All requests of a job, and the sets of columns they fix.

    ``plans`` per target id: ``scores`` of means, ``members`` of shares and counts.
    """
    primary = job.means[0] if job.means else None
    base = _scores(source, primary, plans[primary.id]["scores"] if primary else {}, additions)
    none = F.create_map().cast("map<string,string>")

    def given(*pairs: tuple[str, Column]) -> Column:
        entries = list(pairs)
        if primary:
            entries.append((primary.column, F.col("score").cast("string")))
        parts = [x for name, value in entries for x in (F.lit(name), value)]
        return F.create_map(*parts).cast("map<string,string>") if parts else none

    def request(df: DataFrame, kind: str, fixed: Column, inject: Column = none) -> DataFrame:
        # The id is the content of the request; equal requests of different targets differ by kind.
        name = F.concat_ws("|", F.lit(kind), F.to_json(fixed), F.to_json(inject))
        return df.select(name.alias("request_id"), fixed.alias("given"), inject.alias("inject"), "amount")

    size = F.lit(pool_size)
    own = (primary.column,) if primary else ()
    patterns = [own]
    parts = [request(requests.score_requests(base, size), "score", given())]
    for mean in job.means[1:]:
        extra = _scores(source, mean, plans[mean.id]["scores"], additions)
        rows = requests.extra_mean_requests(base, extra, size)
        parts.append(
            request(rows, f"mean:{mean.id}", given(), F.create_map(F.lit(mean.column), F.col("extra_score").cast("string")))
        )
    for target in (*job.shares, *job.counts):
        needed = plans[target.id]["members"]
        spark = source.sparkSession
        support = spark.createDataFrame(
            [("run", target.id, needed, max(additions - needed, 0))],
            "key string, target_id string, members_needed long, others_needed long",
        )
        counts = source.groupBy(F.col(target.column).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("run").alias("key"), F.lit(target.id).alias("target_id"), "value",
            (membership("value", target.members) == 1).alias("is_member"), "n",
        )
        rows = requests.share_requests(base, support, counts)
        parts.append(request(rows, f"share:{target.id}", given((target.column, F.col("value")))))
        patterns.append((*own, target.column))
        unseen = spark.createDataFrame(
            [("run", target.id, v, needed) for v in sorted(target.members) if v.startswith("{")],
            "key string, target_id string, value string, needed long",
        ).join(counts.select("value"), "value", "left_anti").where("needed > 0")
        rows = requests.schema_requests(base, unseen, requests.SHARE_FACTOR, requests.SHARE_FLOOR)
        parts.append(
            request(rows, f"unseen:{target.id}", given(), F.create_map(F.lit(target.column), F.col("value")))
        )
    for target in job.conditionals:
        spark = source.sparkSession
        support = spark.createDataFrame(
            [("run", target.id, float(target.value))], "key string, target_id string, value double"
        )
        population = source.where(membership(target.population_column, target.population_members) == 1)
        counts = population.where(cell_eligible(F.col(target.option_column))).groupBy(
            F.col(target.population_column).alias("left"), F.col(target.option_column).alias("right")
        ).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("run").alias("key"), F.lit(target.id).alias("target_id"), "left", "right",
            (membership("right", target.option_members) == 1).alias("has_option"), "n",
        )
        rows = requests.conditional_requests(base, support, counts)
        parts.append(
            request(
                rows, f"conditional:{target.id}",
                given((target.population_column, F.col("left")), (target.option_column, F.col("right"))),
            )
        )
        patterns.append((*own, target.population_column, target.option_column))
        if target.schema_members and target.value > 0:
            unseen = spark.createDataFrame(
                [("run", target.id, v, 1 << 40) for v in sorted(target.schema_members)],
                "key string, target_id string, value string, needed long",
            )
            rows = requests.schema_requests(base, unseen, requests.CONDITIONAL_FACTOR, requests.CONDITIONAL_FLOOR)
            by_value = population.groupBy(F.col(target.population_column).alias("left")).agg(F.count(F.lit(1)).alias("n"))
            spread = weighted_requests(
                rows.withColumnRenamed("amount", "requested").join(by_value.withColumn("key", F.lit("run")), "key"),
                ["key", "target_id", "score", "value"], [F.col("left")],
            )
            parts.append(
                request(
                    spread, f"unseen-option:{target.id}", given((target.population_column, F.col("left"))),
                    F.create_map(F.lit(target.option_column), F.col("value")),
                )
            )
            patterns.append((*own, target.population_column))
    return reduce(DataFrame.unionByName, parts), list(dict.fromkeys(tuple(sorted(p)) for p in patterns))


class CandidateShortage(RuntimeError):
    """The pool holds fewer valid rows than were asked for."""


def generate_pool(
    source: DataFrame, job: Job, additions: int, pool_size: int, plans: dict[str, dict], model: copula.Copula | None = None
) -> DataFrame:
    """Candidate rows with ``cand_id`` and the columns of the flat table, written out once.

    Retries, selection and evaluation all read the same stored rows. Rows whose score or time
    leaves its domain are dropped; a request left short fails the attempt.
    """
    refuse_unsupported(source, job)
    model = model or copula.fit(source, job.scores, job.categorical, job.time_column)
    table, patterns = request_table(source, job, additions, pool_size, plans)
    table = materialise(table)
    modelled = (*job.scores, *job.categorical)
    wanted = explode_count(table, F.col("amount"), "copy").select(
        "request_id", "copy", "given", *[F.element_at("inject", F.lit(x)).alias(f"inject_{x}") for x in modelled]
    )
    rows = copula.sample(
        model, wanted, patterns, job.seed, ["request_id", "copy"], [f"inject_{x}" for x in modelled]
    )
    for name in modelled:
        injected = F.col(f"inject_{name}")
        rows = rows.withColumn(
            name, F.coalesce(injected.cast("double") if name in job.scores else injected, F.col(name))
        )
    valid = F.lit(True)
    for mean in job.means:
        score = F.col(mean.column)
        rows = rows.withColumn(
            mean.column,
            F.when(score.isNotNull(), requests.normalised_score(score, F.lit(mean.minimum), F.lit(mean.maximum)).cast("double")),
        )
        valid = valid & (score.isNull() | valid_score(F.col(mean.column), F.lit(mean.minimum), F.lit(mean.maximum)))
    if job.time_column:
        # Quantiles are observed times, so the first and last bound what the source covers.
        first, last = (F.timestamp_micros(F.lit(model.time_grid[i])).cast("timestamp_ntz") for i in (0, -1))
        valid = valid & valid_time(F.col(job.time_column), first, last)
    columns = [*job.scores, *job.categorical, *([job.time_column] if job.time_column else [])]
    pool = materialise(
        rows.where(valid).select(F.concat_ws("#", "request_id", "copy").alias("cand_id"), "request_id", *columns)
    )
    made = pool.groupBy("request_id").agg(F.count(F.lit(1)).alias("made"))
    short = table.groupBy("request_id").agg(F.sum("amount").alias("amount")).join(made, "request_id", "left").where(
        F.coalesce("made", F.lit(0)) < F.col("amount")
    )
    if short.take(1):
        raise CandidateShortage("a request produced too few valid candidates")
    return pool
