import math

import pytest

from evidentia.operators import belief, validity
from evidentia.operators.evaluate import noisy_log
from pyspark.sql import functions as F


def counts(spark, *rows):
    return spark.createDataFrame([(1, s, n) for s, n in rows], "k int, source_api string, n int")


@pytest.mark.parametrize("rows, want", [([("reach", 1)], 0.65), ([("signor", 1)], 0.941), ([("reach", 3)], 1 - (0.05 + 0.3**3)), ([("REACH", 1), ("signor", 0)], 0.65), ([("new", 2)], 1 - (0.1 + 0.09)), ([("reach", 1), ("signor", 1)], 1 - 0.35 * 0.059)])
def test_counts(spark, rows, want):
    assert math.isclose(belief.from_counts(counts(spark, *rows), ["k"]).first().belief, want)


def test_list(spark):
    rows = [(1, ["signor", "reach", "reach"], 5), (2, [], 3), (3, ["reach"], 0), (4, ["reach"], 3), (5, None, 2)]
    got = {r.k: r.belief for r in belief.from_list(spark.createDataFrame(rows, "k int, sources array<string>, evidence_count int"), ["k"]).collect()}
    assert math.isclose(got[1], 1 - (0.05 + 0.3**4) * (0.01 + 0.049)) and got[2] == got[3] == got[5] == 0
    assert math.isclose(got[4], 1 - (0.05 + 0.3**3))


def test_gated(spark):
    rows = [(1, "reach", "true"), (1, "Reach", " FALSE "), (1, "signor", "false"), (2, "reach", "false"), (3, "trips", None)]
    got = {r.k: r for r in belief.gated(spark.createDataFrame(rows, "k int, source_api string, included string"), ["k"]).collect()}
    assert math.isclose(got[1].belief, 0.65) and math.isclose(got[1].parametric_only, 1 - (0.05 + 0.09) * 0.059)
    assert (got[1].n_total, got[1].n_surviving, got[1].n_gated) == (3, 1, 2)
    assert [p.source for p in got[1].per_source] == ["reach", "signor"] and got[1].per_source[1].factor == 1.0
    assert got[2].belief == 0 and math.isclose(got[3].belief, 0.65)
    with pytest.raises(Exception, match="without a source"):
        belief.gated(spark.createDataFrame([(1, None, "true")], "k int, source_api string, included string"), ["k"]).collect()


def test_contradiction(spark):
    rows = [(1, 0, "reach", True, "up"), (1, 1, "signor", True, "down"), (2, 0, "reach", True, None), (2, 1, "reach", True, "up"), (3, 0, "reach", True, "b"), (3, 1, "reach", True, "a")]
    df = spark.createDataFrame(rows, "k int, position int, source_api string, included boolean, regulation_type string")
    got = {r.k: r for r in belief.contradicted(df, ["k"]).collect()}
    assert math.isclose(got[1].belief, 0.941 * (1 - 0.65)) and got[1].dominant == "down" and got[1].is_contradictory
    assert got[2].dominant == "unknown" and got[2].is_contradictory
    assert got[3].dominant == "b" and math.isclose(got[3].belief, 0.65 * 0.35)
    edges = spark.createDataFrame([(1, 0, "up", ["reach"], 1), (1, 1, "down", ["signor"], 1)], "k int, position int, regulation_type string, sources array<string>, evidence_count int")
    assert math.isclose(belief.edge_contradiction(edges, ["k"]).first().belief, 0.941 * 0.35)


def test_gate(spark):
    df = spark.createDataFrame([("correct",), ("CORRECT",), ("incorrect",), ("abstain",), (None,), ("other",)], "v string")
    assert [r.a for r in df.select(belief.kept(F.col("v")).alias("a")).collect()] == [True, True, False, True, True, False]
    assert [r.a for r in df.select(belief.kept(F.col("v"), True).alias("a")).collect()] == [True, True, False, False, False, False]


def test_statement_score(spark):
    s = spark.createDataFrame([("a", ["reach", None, "reach"]), ("b", [])], "stmt_hash string, sources array<string>")
    v = spark.createDataFrame([("a", 0, "correct"), ("a", 1, "incorrect")], "stmt_hash string, position int, verdict string")
    got = {r.stmt_hash: r for r in belief.statement_score(s, v).collect()}
    assert math.isclose(got["a"].belief, 1 - (0.05 + 0.09)) and got["a"].n_total == 3 and got["a"].n_gated == 1
    assert got["b"].belief == 0 and got["b"].n_total == 0 and not got["b"].has_scores


def test_aggregators(spark):
    s = spark.createDataFrame([("a", 0.5), ("a", 0.8), ("a", None), ("b", None)], "stmt_hash string, score double")
    get = lambda by: {r.stmt_hash: r.belief for r in belief.aggregate(s, by).collect()}
    assert math.isclose(get("mean")["a"], 0.65) and math.isclose(get("noisy_or")["a"], 0.9)
    assert math.isclose(get(noisy_log)["a"], math.sqrt(0.4)) and "b" not in get("mean")


def test_missing_scores_and_no_data(spark):
    steps = spark.createDataFrame([("a", "e1", 0.9, "correct"), ("a", "e2", None, None)], "stmt_hash string, evidence_hash string, score double, verdict string")
    st = spark.createDataFrame([("a", 0.5, 0, 0)], "stmt_hash string, published_belief double, supports_count int, supported_by_count int")
    assert validity.statement_scores(steps).first().n_ev == 1
    assert {r.verdict: r.share for r in validity.verdict_shares(steps).collect()} == {"correct": 0.5, "unknown": 0.5}
    assert validity.support_effect(steps, st).count() == 0 and validity.calibration(steps.limit(0), st).first().mae is None
    assert validity.residual_histogram(steps, st).count() == 11
