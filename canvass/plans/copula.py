"""A joint model of a flat table: empirical marginals tied by a Gaussian copula.

Fitting is two aggregates (level counts, correlation matrix); sampling is a narrow projection
of hashed normals. Values are only ever drawn from what the source holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.operators.evaluate import epoch_micros
from canvass.scale import hash_uniform, prefix_sums
from canvass.session import materialise

SMALL_COLUMN = 256  # columns with more levels are looked up by join, not from literals
#: Quantiles that stand for the times: 32 stretches of 32, so that a drawn time is off by 1/1024 of the rows at most.
TIME_STRETCH = 32
TIME_GRID = TIME_STRETCH * TIME_STRETCH + 1


@dataclass(frozen=True)
class Copula:
    """``columns``: discrete columns then, if any, the time column. ``levels``: column, value, n,
    lo, hi, z. ``small``: columns whose levels fit in literals."""

    columns: tuple[str, ...]
    numeric: frozenset[str]
    time_column: str | None
    rows: int
    levels: DataFrame
    small: dict[str, list[tuple[str | None, int, float]]]
    large: dict[str, int]
    time_grid: tuple[int, ...]
    correlation: np.ndarray


# Coefficients of the rational approximations of the normal quantile (relative error below 1.2e-9),
# highest power first: middle numerator and denominator, tail numerator and denominator, and where the tails begin.
_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
_TAIL_BELOW = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def inverse_normal(u: Column) -> Column:
    """Standard normal quantile as a plain column; probabilities are kept off 0 and 1."""
    p = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    q = p - F.lit(0.5)
    low = F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))
    tail = _polynomial(_TAIL[0], low) / _polynomial(_TAIL[1], low)
    middle = q * _polynomial(_MIDDLE[0], q * q) / _polynomial(_MIDDLE[1], q * q)
    return F.when(p < _TAIL_BELOW, tail).when(p > 1 - _TAIL_BELOW, -tail).otherwise(middle)


def hashed_normal(seed: int, index: int, *key: str) -> Column:
    """Standard normal that depends only on the seed, the draw and the row key."""
    u, v = (hash_uniform(seed, F.lit(index), F.lit(side), *key) for side in ("u", "v"))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


def level_table(source: DataFrame, columns: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """column, value, n, hi (running count), lo, z at the middle of the level's interval.

    Scores are ordered by value, categories by frequency; a missing score is a level of its own.
    """
    cells = F.array(*[
        F.struct(F.lit(x).alias("column"), F.col(x).cast("string").alias("value")) for x in columns
    ])
    counts = source.select(F.explode(cells).alias("cell")).groupBy("cell.column", "cell.value").agg(
        F.count(F.lit(1)).alias("n")
    )
    is_number = F.col("column").isin(*numeric) if numeric else F.lit(False)
    number = F.when(is_number, F.coalesce(F.col("value").try_cast("double"), F.lit(-1e300)))
    ordered = counts.withColumn("rank", F.coalesce(number, -F.col("n").cast("double")))
    cum = prefix_sums(ordered, ["rank", "value"], {"hi": "n"}, keys=["column"])
    total = source.agg(F.count(F.lit(1)).alias("total"))
    # One row of totals.
    return cum.join(F.broadcast(total)).select(
        "column", "value", "n", "hi", (F.col("hi") - F.col("n")).alias("lo"),
        inverse_normal((F.col("hi") - F.col("n") / 2) / F.col("total")).alias("z"),
    )


def _time_score(column: str, grid: Sequence[int]) -> Column:
    """Normal score of an instant by linear interpolation on the quantile grid.

    The stretch is found first, then the place in it; times before the first and after the last
    quantile get the scores of the ends.
    """
    zs, at = _grid_z(len(grid)), epoch_micros(F.col(column))
    stretch = F.lit(len(grid) - 1 - TIME_STRETCH)
    for start in range(len(grid) - 1 - 2 * TIME_STRETCH, -1, -TIME_STRETCH):
        stretch = F.when(at <= F.lit(grid[start + TIME_STRETCH]), F.lit(start)).otherwise(stretch)
    times, scores = F.array(*[F.lit(int(x)) for x in grid]), F.array(*[F.lit(z) for z in zs])
    inside = F.size(F.filter(F.slice(times, stretch + 2, TIME_STRETCH - 1), lambda x: x < at))
    place = stretch + inside
    lo, hi = F.get(times, place), F.get(times, place + 1)
    share = F.least(F.greatest((at - lo) / F.greatest(hi - lo, F.lit(1)).cast("double"), F.lit(0.0)), F.lit(1.0))
    return F.get(scores, place) + share * (F.get(scores, place + 1) - F.get(scores, place))


def _grid_z(points: int) -> list[float]:
    inv = NormalDist().inv_cdf
    return [inv(min(max(i / (points - 1), 0.0005), 0.9995)) for i in range(points)]


def fit(
    source: DataFrame, numeric: Sequence[str], categorical: Sequence[str], time_column: str | None = None
) -> Copula:
    discrete = [*numeric, *categorical]
    levels = materialise(level_table(source, discrete, numeric))
    sizes = {r["column"]: r["count"] for r in levels.groupBy("column").count().collect()}
    small_names = [x for x in discrete if sizes.get(x, 0) <= SMALL_COLUMN]
    small: dict[str, list] = {x: [] for x in small_names}
    for r in levels.where(F.col("column").isin(*small_names)).orderBy("column", "hi").collect():
        small[r["column"]].append((r["value"], r["hi"], r["z"]))
    grid: tuple[int, ...] = ()
    if time_column:
        cuts = [i / (TIME_GRID - 1) for i in range(TIME_GRID)]
        grid = tuple(source.agg(F.percentile_approx(epoch_micros(F.col(time_column)), cuts, 10000)).first()[0])
    columns = tuple(discrete) + ((time_column,) if time_column else ())
    scored = source
    for x in discrete:
        if x in small:
            pairs = [F.lit(v) for value, _, z in small[x] for v in (value if value is not None else "\0", z)]
            scored = scored.withColumn(
                f"__z_{x}", F.element_at(F.create_map(*pairs), F.coalesce(F.col(x).cast("string"), F.lit("\0")))
            )
        else:
            # A missing score is a level too; levels are text, as in the literals.
            own = levels.where(F.col("column") == x).select(F.col("value").alias("__level"), F.col("z").alias(f"__z_{x}"))
            scored = scored.join(own, F.col(x).cast("string").eqNullSafe(F.col("__level")), "left").drop("__level")
    if time_column:
        scored = scored.withColumn(f"__z_{time_column}", _time_score(time_column, grid))
    k = len(columns)
    z = [F.coalesce(F.col(f"__z_{x}"), F.lit(0.0)) for x in columns]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = scored.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(e).alias(f"m{i}") for i, e in enumerate(z)],
        *[F.avg(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs],
    ).first()
    mean = np.array([moments[f"m{i}"] for i in range(k)])
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = moments[f"p{i}_{j}"] - mean[i] * mean[j]
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = cov / np.outer(sd, sd)
    corr = corr * (np.diag(cov)[:, None] > 1e-9) * (np.diag(cov)[None, :] > 1e-9)
    np.fill_diagonal(corr, 1.0)
    corr = np.clip(corr, -0.999, 0.999) * (1 - 1e-4)
    np.fill_diagonal(corr, 1.0)
    large = {x: sizes[x] for x in discrete if x not in small}
    return Copula(columns, frozenset(numeric), time_column, int(moments["n"]), levels, small, large, grid, corr)


def _conditional(model: Copula, given: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Full-size coefficient matrices: z = A z_given + L e, with zero rows for given columns."""
    k = len(model.columns)
    s = [model.columns.index(x) for x in given]
    r = [i for i in range(k) if i not in s]
    a, low = np.zeros((k, k)), np.zeros((k, k))
    full = model.correlation
    cov = full[np.ix_(r, r)]
    if s and r:
        coef = np.linalg.solve(full[np.ix_(s, s)], full[np.ix_(s, r)]).T
        a[np.ix_(r, s)] = coef
        cov = cov - coef @ full[np.ix_(s, r)]
    if r:
        values, vecs = np.linalg.eigh(cov)
        root = vecs @ np.diag(np.sqrt(np.clip(values, 0, None)))
        low[np.ix_(r, r)] = root
    return a, low


def sample(
    model: Copula, rows: DataFrame, patterns: Sequence[tuple[str, ...]], seed: int, key: Sequence[str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Complete request rows to data rows; returns ``key``, ``carry`` and the model's columns.

    ``rows`` has the ``key`` columns and ``given``: map<column, value>. ``patterns`` lists the
    sets of given columns that occur. Given columns keep their value exactly; the others follow
    the conditional normal. The noise is hashed from the row key in Spark, so a batch is plain
    linear algebra and a sorted lookup, whatever partition it runs in.
    """
    discrete = [x for x in model.columns if x != model.time_column]
    k = len(model.columns)
    slim = rows.select(
        *key, *carry,
        *[F.element_at("given", F.lit(x)).alias(f"__v_{x}") for x in discrete],
        *[hashed_normal(seed, i, *key).alias(f"__e{i}") for i in range(k)],
    )
    for x in model.large:
        own = model.levels.where(F.col("column") == x).select(
            F.col("value").alias(f"__v_{x}"), F.col("z").alias(f"__g_{x}")
        )
        slim = slim.join(own, f"__v_{x}", "left")
    coefs = {frozenset(p): _conditional(model, p) for p in patterns}
    columns, small, large = model.columns, dict(model.small), tuple(model.large)
    total, grid, time_column = model.rows, model.time_grid, model.time_column

    def draw(batches):
        import numpy as np
        import pandas as pd

        his = {x: np.array([hi for _, hi, _ in levels]) for x, levels in small.items()}
        values = {x: np.array([v for v, _, _ in levels], dtype=object) for x, levels in small.items()}
        scores = {x: {v: z for v, _, z in levels} for x, levels in small.items()}
        for pdf in batches:
            n = len(pdf)
            noise = np.column_stack([pdf[f"__e{i}"].to_numpy(float) for i in range(k)])
            fixed, is_given = np.zeros((n, k)), np.zeros((n, k), dtype=bool)
            for j, x in enumerate(columns):
                if x == time_column:
                    continue
                is_given[:, j] = pdf[f"__v_{x}"].notna().to_numpy()
                z = pdf[f"__g_{x}"] if x in large else pdf[f"__v_{x}"].map(scores[x])
                fixed[:, j] = pd.to_numeric(z).fillna(0.0).to_numpy(float)
            drawn = np.zeros((n, k))
            for names, (a, low) in coefs.items():
                mask = (is_given == np.array([x in names for x in columns])).all(axis=1)
                drawn[mask] = fixed[mask] @ a.T + noise[mask] @ low.T
            # Normal distribution function, Abramowitz and Stegun 26.2.17. Its coefficients.
            t = 1.0 / (1.0 + 0.2316419 * np.abs(drawn))
            poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
            upper = np.exp(-drawn * drawn / 2) / np.sqrt(2 * np.pi) * poly
            u = np.where(drawn >= 0, 1.0 - upper, upper)
            out = {c: pdf[c] for c in (*key, *carry)}
            for j, x in enumerate(columns):
                if x == time_column:
                    out[x] = np.interp(u[:, j] * (len(grid) - 1), np.arange(len(grid)), np.array(grid, float)).astype("int64")
                    continue
                position = np.minimum((u[:, j] * total).astype("int64"), total - 1)
                if x in large:
                    out[f"__p_{x}"], out[f"__v_{x}"] = position, pdf[f"__v_{x}"]
                else:
                    picked = values[x][np.searchsorted(his[x], position, side="right")]
                    out[x] = np.where(is_given[:, j], pdf[f"__v_{x}"].to_numpy(object), picked)
            yield pd.DataFrame(out)

    types = dict(slim.dtypes)
    fields = [f"`{c}` {types[c]}" for c in (*key, *carry)]
    for x in columns:
        if x == time_column:
            fields.append(f"`{x}` bigint")
        elif x in large:
            fields += [f"`__p_{x}` bigint", f"`__v_{x}` string"]
        else:
            fields.append(f"`{x}` string")
    out = slim.mapInPandas(draw, ", ".join(fields))
    for x in large:
        out = _draw_large(model, out.withColumnRenamed(f"__p_{x}", "__pos"), x).withColumn(
            x, F.coalesce(f"__v_{x}", "__drawn")
        ).drop(f"__v_{x}", "__drawn")
    for x in model.numeric:
        out = out.withColumn(x, F.col(x).cast("double"))
    if time_column:
        out = out.withColumn(time_column, F.timestamp_micros(time_column).cast("timestamp_ntz"))
    return out


def _draw_large(model: Copula, rows: DataFrame, column: str) -> DataFrame:
    """Level at a position, by equi-join on position buckets (about one level per bucket)."""
    width = max(1, model.rows // max(model.large[column], 1))
    own = model.levels.where(F.col("column") == column).select(
        F.col("value").alias("__drawn"), "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("__b"),
    )
    return rows.withColumn("__b", F.floor(F.col("__pos") / width)).join(own, "__b").where(
        (F.col("__pos") >= F.col("lo")) & (F.col("__pos") < F.col("hi"))
    ).drop("__b", "__pos", "lo", "hi")
