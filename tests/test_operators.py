"""Numbering, prefix sums, plans, parsers, quality and routing on small literal inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from canvass.functions import parsing as Q
from canvass.functions.labels import likert_label, spreadsheet_safe
from canvass.operators import evaluate as E
from canvass.operators.groups import group_overlaps
from canvass.plans import allocation
from canvass.plans import support as S
from canvass.scale import explode_count, hash_order, number_by_hash, prefix_sums
from canvass.sources import tables as ST


@pytest.mark.parametrize("partitions", ["1", "4", "32"])
def test_numbering_is_dense_and_independent_of_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        # One key holds nearly all rows.
        rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 4800, "hot").otherwise("cold"))
        numbered = number_by_hash(rows, ["k"], hash_order(1, "id"), tie=["id"])
        got = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in numbered.groupBy("k").agg(
            F.count_distinct("rn").alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi")).collect()}
        assert got == {"hot": (4800, 1, 4800), "cold": (200, 1, 200)}
        # The same three rows come first on any number of partitions.
        first = sorted(r["id"] for r in numbered.where("k = 'hot' AND rn <= 3").collect())
        by_hash = rows.where("k = 'hot'").orderBy(hash_order(1, "id")).limit(3)
        assert first == sorted(r["id"] for r in by_hash.collect())
        sums = prefix_sums(rows, ["id"], {"total": F.lit(1)}, keys=["k"])
        assert sums.where("id = 4799 OR id = 4999").orderBy("id").select("total").collect() == [(4800,), (200,)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def spread(requested, counts):
    """Every value in turn takes its rounded share of what is left; the last one takes the rest."""
    total, left, out = sum(n for _, n in counts), requested, []
    for k, (value, n) in enumerate(counts):
        amount = left if k == len(counts) - 1 else min(left, max(1, round(requested * n / total)))
        out += [(value, amount)] if amount else []
        left -= amount
    return out


@pytest.mark.parametrize("window_rows", [10**6, 0])
def test_weighted_requests_in_window_and_ranges(spark, monkeypatch, window_rows):
    """One request holds nearly all values, another has a null in its key; both plans give the loop's amounts."""
    monkeypatch.setattr(allocation, "WINDOW_ROWS", window_rows)
    rows = [("hot", 1.0, f"v{i:05d}", 1 + i * 7 % 11, 30_000) for i in range(4000)]
    rows += [("cold", None, f"w{i}", 1 + i, 17) for i in range(9)] + [("one", None, "x", 3, 5), ("none", 2.0, "y", 0, 5)]
    counts = spark.createDataFrame(rows, "target_id string, score double, value string, n long, requested long").repartition(5)
    got = sorted((r.target_id, r.value, r.amount) for r in allocation.weighted_requests(counts, ["target_id", "score"], [F.col("value")]).collect())
    want = []
    for target in ("hot", "cold", "one"):
        own = [r for r in rows if r[0] == target]
        want += [(target, value, amount) for value, amount in spread(own[0][4], [(r[2], r[3]) for r in own])]
    assert got == sorted(want)


def test_ranges_spread_one_request(spark):
    """No range partition holds far more than its share of one request's values."""
    values = spark.range(40_000).selectExpr("'k' AS k", "cast(id AS string) AS value", "1 + id % 5 AS n")
    sums = prefix_sums(values, ["value"], {"upto": "n"}, keys=["k"])
    sizes = sorted(r["count"] for r in sums.groupBy(F.spark_partition_id()).count().collect())
    assert sums.agg(F.max("upto")).first()[0] == 120_000 and sum(sizes) == 40_000


def test_group_overlaps_equal_pairs(spark):
    """Bitmaps count what comparing every pair counts; one member is common to most groups."""
    rng = random.Random(2)
    listed = {}
    for g in range(300):
        members = {f"m{rng.randint(0, 200)}" for _ in range(rng.randint(0, 3))} | ({"common"} if g % 3 else set())
        listed["q2" if g % 7 == 0 else "q1", g] = members or {"alone" + str(g)}
    rows = [("f", q, g, m) for (q, g), members in listed.items() for m in members for _ in range(1 + g % 2)]
    members = spark.createDataFrame(rows, "form_id string, question_id string, group_id long, member string")
    got = {(r.question_id, r.group_id): r.overlapping_groups for r in group_overlaps(members).collect()}
    assert got == {(q, g): sum(1 for (p, h), other in listed.items() if (p, h) != (q, g) and p == q and other & own) for (q, g), own in listed.items()}


def test_common_member_makes_no_pairs(spark):
    """60,000 groups with different sets share one member: bits, not 3.6 billion pairs."""
    rows = spark.range(60_000).selectExpr("'f' AS form_id", "'q' AS question_id", "id AS group_id", "explode(array('common', cast(id AS string))) AS member")
    got = group_overlaps(rows).agg(F.min("overlapping_groups").alias("a"), F.max("overlapping_groups").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert tuple(got) == (59_999, 59_999, 60_000)


def test_conditional_support_equals_the_whole_scan(spark):
    """The stretches that are scanned hold the best denominator of all, ties to the larger one."""
    rng = random.Random(6)
    rows, want = [], {}
    for g in range(150):
        population, available = rng.randint(0, 60), rng.randint(0, 400)
        own = [(f"t{i}", rng.randint(0, population), rng.choice([0.0, 1.0, 0.5, round(rng.random(), 1), round(rng.random(), 2), rng.random()])) for i in range(rng.randint(1, 3))]
        rows += [(g, t, population, n, v, available) for t, n, v in own]
        best = None
        for d in range(max(1, population), population + available + 1):
            total = 0.0
            for _, n, v in own:
                low, high = n, n + d - population
                total += min(abs(min(max(x, low), high) / d - v) for x in (low, high, math.floor(v * d), math.ceil(v * d)))
            key = (round(total, 12), -d)
            best = key if best is None or key < best else best
        want[g] = None if best is None else -best[1]
    df = spark.createDataFrame(rows, "g long, target_id string, source_population long, source_numerator long, value double, available long")
    got = {r.g: r.denominator for r in S.conditional_support(df, ["g"]).collect()}
    assert got == want


def test_conditional_support_of_a_billion_rows(spark):
    """The work depends on the decimals of the values, not on the rows."""
    rows = [(1, "a", 300_000_000, 100_000_000, 0.5, 700_000_000), (1, "b", 300_000_000, 1, 0.25, 700_000_000), (2, "a", 10**9, 0, 0.1234, 10**9)]
    df = spark.createDataFrame(rows, "g long, target_id string, source_population long, source_numerator long, value double, available long")
    got = {(r.g, r.target_id): (r.denominator, r.numerator) for r in S.conditional_support(df, ["g"]).collect()}
    assert got == {(1, "a"): (10**9, 5 * 10**8), (1, "b"): (10**9, 25 * 10**7), (2, "a"): (2 * 10**9, 246_800_000)}
    scanned = S._scan_denominators(df.groupBy("g").agg(
        F.max("source_population").alias("source_population"), F.max("available").alias("available"), F.collect_list(F.struct("target_id", "source_numerator", "value")).alias("targets")))
    assert scanned.count() < 50_000


def test_limit_keeps_the_first_rows(spark):
    rows = spark.range(1000).withColumn("k", F.lit("x"))
    top = number_by_hash(rows, ["k"], hash_order(1, "id"), tie=["id"], limit=F.lit(17))
    assert sorted(r["rn"] for r in top.collect()) == list(range(1, 18))


def test_explode_count_crosses_blocks(spark):
    df = spark.createDataFrame([("a", 5000), ("b", 0), ("c", 1)], "id string, n long")
    got = explode_count(df, F.col("n"), "i").groupBy("id").agg(F.count_distinct("i").alias("n"), F.max("i").alias("m"))
    assert {(r["id"], r["n"], r["m"]) for r in got.collect()} == {("a", 5000, 5000), ("c", 1, 1)}


def test_mean_plan(spark):
    df = spark.createDataFrame(
        [("t", 80, 80, 321.0, 120, 4.3, 1, 5)],
        "target_id string, source_count long, answered_count long, score_sum double, final_count long, value double, minimum int, maximum int",
    )
    r = S.mean_support(df).first()
    assert (r["low_score"], r["low_count"], r["high_count"]) == (4, 5, 35)
    assert r["absolute_error"] == pytest.approx(0)


@pytest.mark.parametrize("raw, ok", [("4", True), ("-1", False), ("4.0", False), ("0x4", False), (" 4 ", False), ("6", False), (None, False)])
def test_ordinal_parser(spark, raw, ok):
    p = spark.createDataFrame([(raw,)], "raw string").select(Q.parse_ordinal(F.col("raw"), F.lit(1), F.lit(5)).alias("p")).first()["p"]
    assert (p["error"] is None) is ok


@pytest.mark.parametrize(
    "raw, year, time, ok",
    [("2024-02-29", True, False, True), ("2023-02-29", True, False, False), ("1900-02-29", True, False, False),
     ("02-29", False, False, True), ("2024-01-01 23:59", True, True, True), ("2024-01-01 24:00", True, True, False),
     ("04-31", False, False, False), ("2024-1-1", True, False, False)],
)
def test_date_parser(spark, raw, year, time, ok):
    p = spark.createDataFrame([(raw,)], "raw string").select(Q.parse_date(F.col("raw"), F.lit(year), F.lit(time)).alias("p")).first()["p"]
    assert (p["value"] == raw) is ok


def test_labels(spark):
    df = spark.createDataFrame([("=1+1",), ("  @x",), ("plain",)], "t string")
    assert [r[0] for r in df.select(spreadsheet_safe(F.col("t"))).collect()] == ["'=1+1", "'  @x", "plain"]
    df = spark.createDataFrame([("  Strongly   AGREE ",)], "t string")
    assert df.select(likert_label(F.col("t"))).first()[0] == "strongly agree"


def test_duplicates_and_clones(spark):
    rows = [("original", 4, "A"), ("original", 4, "B"), ("original", 5, "A"),
            ("synthetic", 4, "A"), ("synthetic", 3, "C"), ("synthetic", 3, "C"), ("synthetic", 3, "C")]
    r = E.row_diagnostics(spark.createDataFrame(rows, "origin string, score int, segment string"), ["score", "segment"]).first()
    assert tuple(r) == (5, 3, 0.75, 1, 0.25)


def test_ks_and_median_against_brute_force(spark):
    import statistics

    source, synth = [0, 10, 20, 30, 1000], [5, 500, 990, 995]
    rows = [("original", s) for s in source] + [("synthetic", s) for s in synth]
    df = spark.createDataFrame(rows, "origin string, s long").selectExpr(
        "origin", "timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS submitted_at"
    )
    r = E.timestamp_ks(df).first()
    cdf = lambda xs, t: sum(x <= t for x in xs) / len(xs)
    assert r["ks_statistic"] == pytest.approx(max(abs(cdf(source, t) - cdf(synth, t)) for t in source + synth))
    assert r["median_delta_seconds"] == pytest.approx(statistics.median(synth) - statistics.median(source))


def test_revisions_are_immutable(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "response_id string, v int")
    ST.append_revision(rows, root, "p", "r1", first_import=True)
    with pytest.raises(ST.DuplicateResponses):
        ST.append_revision(rows.union(rows), root, "p", "r2")
    with pytest.raises(ST.EmptyCapture):
        ST.append_revision(rows.limit(0), root, "q", "r1", first_import=True)
    ST.append_revision(rows.where("v = 1"), root, "p", "r3")
    assert ST.current_revision(spark, root).first()["revision_id"] == "r3"
    assert ST.read_revision(spark, root, "p", "r1").count() == 2
