"""Literal selection and replacement cases with known best answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.plans import copula
from canvass.plans import pipeline as PL
from canvass.plans import selection as SEL
from canvass.plans import vectors as V
from canvass.plans.pool import Job, RoutingRule, drop_misrouted
from canvass.queries import augmenting


def table(spark, scores, prefix, **columns):
    key = "response_id" if prefix == "r" else "cand_id"
    rows = [(f"{prefix}{i}", float(s), *[v[i] for v in columns.values()]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, f"{key} string, score double" + "".join(f", {c} string" for c in columns))


def outcome(source, chosen, job):
    cols = [c for c in source.columns if c != "response_id"]
    return {r["target_id"]: r for r in V.outcomes(source.select(*cols).unionByName(chosen.select(*cols)), job.targets).collect()}


@pytest.mark.parametrize(
    "source, pool, final, target, achieved",
    [([4, 5], [4, 5, 5], 4, 4.75, 4.75), ([4, 4], [4, 5], 3, 4.5, 13 / 3)],
)
def test_exact_and_nearest_mean(spark, source, pool, final, target, achieved):
    job = Job(final, means=(V.MeanTarget("m", "score", target, 1, 5),))
    src, cand = table(spark, source, "r"), table(spark, pool, "c")
    chosen = SEL.select_for_targets(src, cand, job)
    assert chosen.count() == final - len(source)
    assert outcome(src, chosen, job)["m"]["achieved"] == pytest.approx(achieved)


def test_shares_with_exact_count(spark):
    src = table(spark, [4, 5], "r", g=["M", "F"])
    cand = table(spark, [4, 5, 4, 5], "c", g=["M", "M", "F", "F"])
    job = Job(
        4, means=(V.MeanTarget("m", "score", 4.5, 1, 5),), shares=(V.ShareTarget("s", "g", frozenset({"F"}), 0.5),),
        counts=(V.CountTarget("n", "g", frozenset({"M"}), 2),),
    )
    got = outcome(src, SEL.select_for_targets(src, cand, job), job)
    assert all(r["absolute_error"] == 0 for r in got.values())


def test_exact_count_has_no_fallback(spark):
    src, cand = table(spark, [4, 5], "r", g=["M", "M"]), table(spark, [4, 5], "c", g=["F", "F"])
    job = Job(3, counts=(V.CountTarget("n", "g", frozenset({"M"}), 3),))
    with pytest.raises(SEL.Infeasible) as error:
        SEL.select_for_targets(src, cand, job)
    assert error.value.code == "solver_infeasible"


def test_too_few_candidates(spark):
    job = Job(5, means=(V.MeanTarget("m", "score", 4.0, 1, 5),))
    with pytest.raises(SEL.Infeasible) as error:
        SEL.select_for_targets(table(spark, [4], "r"), table(spark, [4, 5], "c"), job)
    assert error.value.code == "candidate_support"


def test_one_replacement_reaches_the_mean(spark):
    src, cand = table(spark, [5, 5, 5], "r"), table(spark, [1, 1, 1, 5], "c")
    job = Job(4, means=(V.MeanTarget("m", "score", 3.0, 1, 5),))
    append = outcome(src, SEL.select_for_targets(src, cand, job), job)["m"]["weighted_error"]
    plan = SEL.plan_replacements(src, cand, job, append)
    assert (plan.status, plan.removed_count) == ("available", 1)
    assert plan.kept.count() == 2 and plan.chosen.count() == 2
    assert outcome(plan.kept, plan.chosen, job)["m"]["absolute_error"] == 0


def test_replacement_not_required(spark):
    src, cand = table(spark, [4, 5], "r"), table(spark, [4, 5, 5], "c")
    job = Job(4, means=(V.MeanTarget("m", "score", 4.75, 1, 5),))
    assert SEL.plan_replacements(src, cand, job, 0.0).status == "not_required"


def test_four_state_denominators(spark):
    slot = '{{"state":"{}"}}'
    cells = ['{"state":"answered","value":{"kind":"multi_choice","optionKeys":["A"]}}'] + [
        slot.format(s) for s in ("skipped", "not_reached", "indeterminate")
    ]
    src = table(spark, [1, 2, 3, 4], "r", pop=["P"] * 4, box=cells)
    job = Job(4, conditionals=(V.ConditionalTarget("c", "pop", frozenset({"P"}), "box", frozenset({cells[0]}), 0.5),))
    row = V.outcomes(src, job.targets).first()
    assert (row["denominator"], row["numerator"]) == (2, 1)


def test_routing_rules_drop_candidates(spark):
    p = '{"state":"answered","value":{"kind":"single_choice","optionKey":"end"}}'
    on = '{"state":"answered","value":{"kind":"single_choice","optionKey":"on"}}'
    down, empty = '{"state":"answered","value":{"kind":"text","text":"x"}}', '{"state":"not_reached"}'
    cand = table(spark, [1, 2, 3], "c", branch=[p, p, on], downstream=[down, empty, empty])
    rules = [
        RoutingRule("branch", "end", forbidden=(("downstream", "answer_slot"),)),
        RoutingRule("branch", "on", required=(("downstream", "answer_slot"),)),
    ]
    assert [r["cand_id"] for r in drop_misrouted(cand, rules).collect()] == ["c1"]


@pytest.mark.parametrize("size", [60, 60_000])
def test_fewest_replacements(spark, size):
    """Scores 1-5 in equal parts, mean 3.0; a tenth more rows and mean 3.4: 5s in place of the lowest scores."""
    src = spark.range(size).selectExpr("cast(id as string) AS response_id", "cast(1 + id % 5 as double) AS score")
    cand = spark.range(size).selectExpr("cast(id as string) AS cand_id", "cast(1 + id % 5 as double) AS score")
    final = size + size // 10
    job = Job(final, means=(V.MeanTarget("m", "score", 3.4, 1, 5),))
    wanted = round(3.4 * final) - 3 * size  # what the new and replacing rows must bring, less what goes
    fives, removed, gain = size // 5, 0, 5 * (size // 10)  # additions are 5s, while there are any
    left = fives - size // 10
    while gain < wanted:
        removed += 1
        gain += (5 if left > 0 else 4) - 1  # the rows that go are 1s: there are more than enough of them
        left -= 1
    plan = SEL.plan_replacements(src, cand, job, 1.0)
    assert (plan.status, plan.removed_count) == ("available", removed)
    assert plan.kept.count() == size - removed and plan.chosen.count() == size // 10 + removed
    assert outcome(plan.kept, plan.chosen, job)["m"]["absolute_error"] <= 0.5 / final + 1e-12


def test_replacement_query_removes_no_more_than_it_must(spark):
    """The lowest rows go, the highest candidates come: the share leaves room for that, so no plan can do with less."""
    sf = "/root/testdata/sf0.001"
    plan = augmenting.replacement_plan(spark, sf).first()
    job = augmenting.job(spark, sf, augmenting._HIGH)
    scores = lambda df: sorted(r[0] for r in df.select("score_q_score").collect())
    have, pool = scores(augmenting.source(spark, sf)), scores(augmenting.pool(spark, sf))[::-1]
    extra, removed = job.final_count - len(have), 0
    while sum(have[removed:]) + sum(pool[: extra + removed]) < round(3.4 * job.final_count):
        removed += 1
    assert (plan.status, plan.replaced, plan.kept_rows, plan.chosen_rows) == ("available", removed, len(have) - removed, extra + removed)


def test_hidden_append_is_found(spark):
    """Targets are what a random choice reaches, so the least error is 0; several targets pull at once."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        draw = lambda n: [(int(rng.integers(1, 6)), str(rng.choice(["A", "B", "C"])), str(rng.choice(["x", "y"]))) for _ in range(n)]  # noqa: B023, E731
        have, pool = draw(400), draw(900)
        hidden = [pool[i] for i in rng.permutation(900)[:150]]
        both = have + hidden
        in_x = [r for r in both if r[2] == "x"]
        job = Job(
            550, means=(V.MeanTarget("m", "score", sum(r[0] for r in both) / 550, 1, 5),),
            shares=(V.ShareTarget("s", "g", frozenset({"A"}), sum(r[1] == "A" for r in both) / 550),),
            conditionals=(V.ConditionalTarget("c", "h", frozenset({"x"}), "g", frozenset({"B"}), sum(r[1] == "B" for r in in_x) / len(in_x)),),
        )
        src, cand = (table(spark, [r[0] for r in rows], p, g=[r[1] for r in rows], h=[r[2] for r in rows]) for rows, p in ((have, "r"), (pool, "c")))
        got = outcome(src, SEL.select_for_targets(src, cand, job), job)
        assert all(r["absolute_error"] < 1e-9 for r in got.values())


def test_relaxed_counts_come_second(spark):
    """The mean is met first; of the choices that do, the one closest to the count is taken."""
    src = table(spark, [3, 3], "r", g=["M", "M"])
    cand = table(spark, [5, 1, 3, 3, 5, 1], "c", g=["F", "F", "M", "M", "M", "F"])
    job = Job(4, means=(V.MeanTarget("m", "score", 3.0, 1, 5),), counts=(V.CountTarget("n", "g", frozenset({"M"}), 1),))
    with pytest.raises(SEL.Infeasible):
        SEL.select_for_targets(src, cand, job)
    got = outcome(src, SEL.select_for_targets(src, cand, job, enforce_counts=False), job)
    assert got["m"]["absolute_error"] == 0 and got["n"]["achieved"] == 2


def test_many_runs_in_one_job(spark):
    """Runs do not see each other; each gets its own least error."""
    names = ["__d0", "__n0"]
    cells = [(f"run{i}", 0, 1.0, float(s), 5 + i) for i in range(200) for s in (1, 2, 3, 4, 5)]
    runs = {f"run{i}": SEL.RunSpec((SEL.Spec(1 + i / 50, 0.25, "mean"),), (0.0, 0.0), 5 if i % 10 else 10_000) for i in range(200)}
    rows = SEL.solve_runs(spark.createDataFrame(cells, "run string, keep int, __d0 double, __n0 double, cap long"), names, runs).collect()
    assert len(rows) == len(cells)
    for i in range(200):
        own = [r for r in rows if r["run"] == f"run{i}"]
        if i % 10 == 0:
            assert {r["status"] for r in own} == {"short"}
            continue
        total = sum(r["take"] * r["__n0"] for r in own)
        assert sum(r["take"] for r in own) == 5 and abs(total - (1 + i / 50) * 5) <= 0.5 + 1e-9


def test_mean_end_to_end(spark):
    """80 rows, one 5 and seventy-nine 4; 40 additions to mean 4.3 are 35 fives and 5 fours."""
    rows = [(f"r{i}", 5.0 if i == 0 else 4.0, "A" if i % 2 else "B", i) for i in range(80)]
    src = spark.createDataFrame(rows, "response_id string, score double, segment string, i int").selectExpr(
        "response_id", "score", "segment", "timestamp_ntz'2026-08-01 00:00:00' + make_interval(0,0,0,0,0,20*i,0) AS submitted_at"
    )
    job = Job(120, means=(V.MeanTarget("m", "score", 4.3, 1, 5),), categorical=("segment",), seed=20260906)
    done = PL.augment(src, job)
    added = {r["score"]: r["count"] for r in done.synthetic.groupBy("score").count().collect()}
    assert added == {5.0: 35, 4.0: 5}
    assert done.final.count() == 120 and done.edit_status == "not_required"
    assert done.final.select("response_id").distinct().count() == 120
    assert {r[0] for r in done.synthetic.select("segment").distinct().collect()} <= {"A", "B"}
    assert done.outcome.first()["achieved"] == pytest.approx(4.3)


def test_drawn_times_follow_the_source(spark):
    """Lumpy times (days, a rush, a gap): the drawn ones stay within 0.01 of the source's distribution."""
    size = 20_000
    at = "timestamp_micros(cast(case when id % 4 = 0 then 86400e6 * (id % 90) when id % 4 < 3 then 86400e6 * 200 + 3600e6 * pow(id / 20000, 3) else 86400e6 * 300 * (id / 20000) end as bigint))"
    source = spark.range(size).selectExpr("cast(1 + id % 5 as double) AS score", "if(id % 3 = 0, 'a', 'b') AS segment", f"{at} AS submitted_at")
    model = copula.fit(source, ["score"], ["segment"], "submitted_at")
    rows = spark.range(100_000).selectExpr("id", "cast(map() as map<string,string>) AS given")
    micros = lambda df: np.sort(np.array([r[0] for r in df.selectExpr("unix_micros(cast(submitted_at as timestamp))").collect()]))
    have, drawn = micros(source), micros(copula.sample(model, rows, [()], 7, ["id"]))
    points = np.unique(np.r_[have, drawn])
    cdf = lambda x: np.searchsorted(x, points, side="right") / len(x)
    # Between two quantiles times are spread evenly: a lump of many equal times is compared at its ends.
    assert np.abs(cdf(have) - cdf(drawn)).max() < 0.02
    ends = np.quantile(have, np.linspace(0, 1, 21)[1:-1], method="nearest")
    for x in ends:
        below, upto = (have < x).mean(), (have <= x).mean()
        assert below - 0.01 < (drawn <= x).mean() < upto + 0.01
    assert drawn.min() >= have.min() and drawn.max() <= have.max()


def test_normal_quantiles(spark):
    from statistics import NormalDist

    points = [0.0, 1e-13, 1e-9, 1e-4, 0.02, 0.02425, 0.03, 0.3, 0.5, 0.7, 0.97, 0.97575, 0.98, 1 - 1e-6, 1.0, *[i / 997 for i in range(1, 997)]]
    df = spark.createDataFrame([(p,) for p in points], "p double").select("p", copula.inverse_normal(F.col("p")).alias("z"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for p, z in df.collect():
        want = NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))
        assert abs(z - want) <= 2e-8 * max(1.0, abs(want))


def test_time_scores_rise_with_time(spark):
    source = spark.range(5000).selectExpr("timestamp_micros(cast(pow(id, 2) as bigint)) AS at", "id")
    grid = tuple(source.selectExpr(f"percentile_approx(unix_micros(at), array({', '.join(str(i / (copula.TIME_GRID - 1)) for i in range(copula.TIME_GRID))}), 10000)").first()[0])
    got = [r.z for r in source.select(copula._time_score("at", grid).alias("z"), "id").orderBy("id").collect()]
    want = np.interp([i * i for i in range(5000)], grid, copula._grid_z(len(grid)))
    assert np.allclose(got, want, atol=1e-6) and sorted(got) == got


@pytest.mark.parametrize("levels", [255, 256, 257])
def test_missing_scores_keep_their_normal_score(spark, monkeypatch, levels):
    """The joint model is the same whether levels are looked up by join or from literals."""
    rows = [(float(i // 5 % (levels - 1)) if i % 5 else None, None if i % 7 == 0 else "ab"[i % 5 > 0]) for i in range(5 * levels)]
    source = spark.createDataFrame(rows, "score double, segment string")
    assert source.select("score").distinct().count() == levels
    models = []
    for limit in (10**6, 256, 1):
        monkeypatch.setattr(copula, "SMALL_COLUMN", limit)
        models.append(copula.fit(source, ["score"], ["segment"]).correlation)
    assert abs(models[0][0, 1]) > 0.3
    assert all(np.allclose(models[0], m, atol=1e-9) for m in models[1:])
