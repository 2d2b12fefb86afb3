from evidentia.operators import claims, evaluate, reads, render
from evidentia.functions.columns import vote
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_texts(spark):
    assert one(spark, render.signed(F.lit(0.5))) == "+0.50" and one(spark, render.plural(F.lit(1), "row", "rows")) == "1 row"
    assert one(spark, render.comparison(F.lit(0.9), F.lit(0.5))) == "strongly supported; above the published belief"
    assert one(spark, render.epistemics(F.lit(True), F.lit(None).cast("boolean"), F.lit(True))) == "direct, curated"
    assert one(spark, render.trace(F.lit("Activation"), F.lit("A activates B"), F.lit("incorrect"), F.lit("role_swap"), F.lit(0.05))) == "Claim (Activation): A activates B. Verdict: incorrect because of role swap. Score: 0.05"
    assert one(spark, render.bar(F.lit(0.25), 4)) == "█░░░" and one(spark, render.cue(F.lit("cue 'may' near"))) == "may"
    assert tuple(one(spark, render.highlight(F.lit("a BIG cat"), F.lit("big")))) == ("a ", "BIG", " cat")
    assert one(spark, render.highlight(F.lit("x"), F.lit("y"))) is None
    assert one(spark, vote(F.lit("object_role"), F.lit("present_as_subject"))) == -1.0 and one(spark, vote(F.lit("scope"), F.lit(None).cast("string"))) == 0.0
    d = spark.createDataFrame([(3, 0.1, 0.2)], "n long, mae double, bias double")
    assert render.validity_line(d).first().sentence == "mean error 0.100 over 3 statements; leans high"


def test_attribution_and_best(spark):
    rows = [("s", 1, "subject_role", "present_as_subject", "llm", "high"), ("s", 2, "scope", "negated", "substrate", "high"), ("s", 3, "scope", "hedged", "llm", "low"), ("s", 4, "relation_axis", "no_relation", "abstain", "high")]
    df = spark.createDataFrame(rows, "stmt_hash string, evidence_hash long, probe string, answer string, source string, confidence string")
    got = {r.evidence_hash: r for r in reads.attributions(df).collect()}
    assert [round(got[i].contribution, 3) for i in (1, 2, 3, 4)] == [1.0, -1.0, -0.12, 0.0]
    assert got[2].decisive and not got[1].decisive and got[4].normalized_width == 0
    best = {r.probe: r.evidence_hash for r in reads.best_by_probe(df).collect()}
    assert best["scope"] == 2


def test_ranking_and_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    assert abs(evaluate.average_precision(df).first().auprc - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert evaluate.calibration_error(spark.createDataFrame([(1.0, 0)], "score double, label int")).first().ece == 0.0
    p = evaluate.latency(spark.createDataFrame([(float(i), "a") for i in range(1, 101)], "v double, g string"), "v", ["g"]).first()
    assert (p.p50, round(p.p99, 6), p.index_p99) == (50.5, 99.01, 100.0)


def test_agents_and_index(spark):
    agent = "struct<name:string,db_refs:map<string,string>>"
    rows = [("k", ("A", {"HGNC": "1"}), ("B", {}), None), ("m", None, None, [("C", {}), None, ("D", {})])]
    df = spark.createDataFrame(rows, f"stmt_hash string, enz {agent}, sub {agent}, members array<{agent}>")
    assert {(r.stmt_hash, r.role, r.role_index, r.name) for r in claims.agent_rows(df).collect()} == {("k", "enz", 0, "A"), ("k", "sub", 0, "B"), ("m", "member", 0, "C"), ("m", "member", 2, "D")}
    index = spark.createDataFrame([(7, "s1", 0, ["X", "Y"]), (7, "s2", 0, ["A", "B"]), (8, "s3", 1, ["Q"])], "source_hash long, stmt_hash string, ev_index int, agents array<string>")
    asked = spark.createDataFrame([(1, 7, "A", "B"), (2, 7, "N", "N"), (3, 8, "A", "B")], "query_id int, source_hash long, subject string, object string")
    assert {r.query_id: r.stmt_hash for r in claims.index_lookup(asked, index).collect()} == {1: "s2", 2: "s1", 3: "s3"}
