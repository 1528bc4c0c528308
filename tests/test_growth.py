"""Steps whose tasks or broadcasts used to grow faster than they are spread."""

import pytest
from pyspark.sql import functions as F

from canvass.functions.slots import cell_eligible
from canvass.plans import selection as SEL
from canvass.plans import targets as T
from canvass.plans import vectors as V
from canvass.queries import QUERIES
from canvass.scale import explode_count, join_dimension

SF = "/root/testdata/sf0.001"


def test_copies_are_spread_over_tasks(spark):
    """Few small blocks, many copies: one task made them all once AQE had put the blocks together."""
    asked = spark.createDataFrame([("a", 40_000), ("b", 9)], "name string, amount long")
    copies = explode_count(asked, F.col("amount"), "copy").withColumn("task", F.spark_partition_id())
    out = copies.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name", "copy").alias("different"), F.count_distinct("task").alias("tasks")).first()
    assert (out["n"], out["different"]) == (40_009, 40_009)
    assert out["tasks"] > 1


def _after_run(df):
    """The plan that was run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_grow_are_never_broadcast(spark):
    rows = spark.range(50_000).select("id", (F.col("id") % 3).alias("k")).repartition(4, "id")
    few = spark.range(3).select(F.col("id").alias("k"))
    assert "BroadcastHashJoin [k" in _after_run(join_dimension(rows, few, "k")) and join_dimension(rows, few, "k").count() == 50_000
    many = spark.range(3).select(F.col("id").alias("k")).repartition(2)
    assert "BroadcastHashJoin" not in _after_run(join_dimension(rows, many, "k", most=2))


def test_frozen_baselines_broadcast_metrics_not_targets(spark):
    plan = _after_run(QUERIES["agg08"](spark, SF))
    assert "Inner, BuildRight" in plan and "Inner, BuildLeft" not in plan.split("Inner, BuildRight")[0]


@pytest.mark.parametrize("name", ["scl10", "src04"])
def test_forms_are_merged(spark, name):
    """Tables with a row or more per form are not broadcast to one another."""
    plan = _after_run(QUERIES[name](spark, SF)).split("+- == Initial Plan ==")[0]
    assert "BroadcastHashJoin [form_id" not in plan
    assert "BroadcastHashJoin [cast(form_id" not in plan


def test_previews_unfold_in_place(spark):
    """Targets override the form's subjects, also subjects the form does not have; no row of a draft is sorted against others."""
    metrics = spark.createDataFrame(
        [("f", "option", "option:q:A", 4, 8, 0.5), ("f", "option", "option:q:B", 2, 8, 0.25), ("f", "mean", "mean:q", None, 8, 3.0)],
        "form_id string, metric string, subject_key string, count long, denominator_count long, metric_value double",
    )
    drafts = spark.createDataFrame([(1, "f", 16), (2, "f", None), (3, "none", 5)], "draft_id long, form_id string, final_count long")
    target = "draft_id long, form_id string, final_count long, position int, target_id string, kind string, subject_kind string, question_id string, option_key string, group_id string, intent string, value double"
    targets = spark.createDataFrame([
        (1, "f", 16, 0, "a", "share", "option", "q", "A", None, "absolute", 0.75),
        (1, "f", 16, 1, "b", "share", "option", "q", "A", None, "absolute", 0.25),
        (1, "f", 16, 2, "c", "share", "option", "q", "Z", None, "absolute", 0.5),
        (3, "none", 5, 0, "d", "share", "option", "q", "A", None, "absolute", 0.5),
    ], target)
    sources = spark.createDataFrame([("f", 8)], "form_id string, source_count long")
    done = T.preview(targets, drafts, metrics, sources)
    plan = _after_run(done)
    got = {(r["draft_id"], r["subject_key"]): (r["target_id"], r["status"], r["projected_count"], r["delta_count"]) for r in done.collect()}
    assert got == {
        (1, "option:q:A"): ("b", "projected", 4, 0), (1, "option:q:B"): (None, "projected", 4, 2), (1, "option:q:Z"): ("c", "invalid", None, None),
        (2, "option:q:A"): (None, "projected", None, None), (2, "option:q:B"): (None, "projected", None, None),
        (3, "option:q:A"): ("d", "invalid", None, None),
    }
    assert "Generate" in plan.split("Aggregate")[0]


def test_cells_are_read_once_per_target(spark):
    """Signatures are never null: joining on them adds no filter that reads every cell again."""
    cells = ['{"state":"answered"}', '{"state":"skipped"}', '{"state":"not_reached"}', '{"state":"indeterminate"}', '{"state":"other"}', "{}", "no slot", "", None]
    rows = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "cell string, id int").repartition(2, "id")
    assert [r[0] for r in rows.orderBy("id").select(cell_eligible(F.col("cell"))).collect()] == [True, True, False, False, True, True, True, True, True]
    signed, names = SEL._signatures(rows, (V.ShareTarget("s", "cell", frozenset({cells[0]}), 0.5), V.MeanTarget("m", "id", 3.0, 0, 9)))
    assert not any(signed.schema[n].nullable for n in names)
    takes = signed.groupBy(*names).agg(F.count(F.lit(1)).alias("take"))
    plan = signed.join(F.broadcast(takes), names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_routing_rules_read_made_cells(spark):
    """Cells that are made by a projection are made once, not again for every use in a rule."""
    plan = QUERIES["flt13"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all("StructsToJson" not in line for line in plan.splitlines() if "Filter" in line)
    assert plan.count("StructsToJson") <= 4


def test_answer_starts_are_summed_in_place(spark):
    """No array of all starts, which was made once for each answer of a response."""
    assert "sequence(" not in QUERIES["src05"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_kind_of_an_answer_is_asked_once(spark):
    """Conditions inside a lambda are interpreted for every answer, so fields do not ask for the kind again one by one."""
    plan = QUERIES["src05"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(f"spec.kind = {kind})") == 1 for kind in ("single_choice", "multi_choice", "ordinal", "text", "file"))
