import json
from itertools import product

import pytest

from evidentia.functions import relations as R
from evidentia.operators import claims, context, decide, entities, routing
from pyspark.sql import functions as F

NAMES = [{"name": "MAPK1", "aliases": ["ERK2", "p42"]}, {"name": "ELK1", "aliases": ["Elk-1"]}]

#: A sentence for each pattern of the catalogue: agent ERK2, target Elk-1.
SENTENCES = {
    "mod_pos.active_verb": "ERK2 phosphorylates Elk-1 at S383.",
    "mod_pos.passive_by": "Elk-1 is phosphorylated by ERK2",
    "mod_pos.nominalized_by": "phosphorylation of Elk-1 by ERK2",
    "mod_pos.induced_adj": "ERK2-induced Elk-1 phosphorylation",
    "mod_pos.mediated_adj": "ERK2-mediated Elk-1 acetylation",
    "mod_pos.dependent_of": "ERK2-dependent phosphorylation of Elk-1",
    "mod_pos.compound_nominal": "ERK2 phosphorylation of Elk-1",
    "mod_pos.target_compound_by": "Elk-1 phosphorylation by ERK2",
    "mod_pos.x_increases_phos_of_y": "ERK2 also increases the phosphorylation of Elk-1",
    "mod_pos.relative_clause": "ERK2, which in turn phosphorylates Elk-1",
    "bind.active_verb": "ERK2 binds to Elk-1",
    "bind.binding_of_to": "binding of ERK2 to Elk-1",
    "bind.interacts_with": "ERK2 interacts with Elk-1",
    "bind.complex_of": "complex of ERK2 and Elk-1",
    "bind.interaction_compound": "ERK2/Elk-1 interaction",
    "bind.between_and": "interaction between ERK2 and Elk-1",
    "bind.recruits": "ERK2 recruits Elk-1",
    "bind.gerund_to": "ERK2 binding to Elk-1",
    "bind.possessive_interaction": "ERK2's interaction with Elk-1",
    "bind.forms_complex_with": "ERK2 forms a complex with Elk-1",
    "bind.coord_complex": "ERK2 and Elk-1 complex",
    "bind.binding_affinity_for": "binding affinity of ERK2 for Elk-1",
    "bind.bound_to": "ERK2 bound directly to Elk-1",
    "bind.passive_associated": "ERK2 is stably associated with Elk-1",
    "bind.coord_bound_to": "MEK and ERK2 bound to Elk-1",
    "bind.gerund_modifier_to": "ERK2 protein binding to Elk-1",
    "act_pos.active_verb": "ERK2 activates Elk-1",
    "act_pos.induced_adj": "ERK2-induced Elk-1 activation",
    "act_pos.mediated_adj": "ERK2-mediated Elk-1 activation",
    "act_pos.nominalized_by": "activation of Elk-1 by ERK2",
    "act_pos.compound_nominal": "ERK2 activation of Elk-1",
    "act_pos.triggered_act": "ERK2 triggered the activation of Elk-1",
    "act_pos.x_induced_act_of_y": "ERK2-induced activation of Elk-1",
    "act_pos.x_induced_act_of_coord_last": "ERK2-induced activation of FOS, JUN and Elk-1",
    "act_pos.x_induced_release_of": "ERK2 stimulates the release of Elk-1",
    "act_pos.x_induced_release_coord_last": "ERK2-induced release of IL6 and Elk-1",
    "act_neg.verb_activation_of": "ERK2 inhibits the activation of Elk-1",
    "act_neg.verb_y_activation": "ERK2 suppresses Elk-1 signaling",
    "act_neg.nominalized_by": "reduction in Elk-1 activity by ERK2",
    "act_neg.mediated_decrease": "ERK2-mediated decrease in Elk-1 activity",
    "amt_pos.upregulates": "ERK2 upregulates Elk-1 expression",
    "amt_pos.induces_expression": "ERK2 induces Elk-1 expression",
    "amt_pos.passive_upregulated": "Elk-1 expression is increased by ERK2",
    "amt_pos.induced_adj": "ERK2-induced Elk-1 expression",
    "amt_pos.required_to_elevate": "ERK2 signalling is required to elevate Elk-1",
    "amt_pos.x_induces_expression_of_y": "ERK2 further induces the expression of Elk-1",
    "amt_pos.coord_first": "ERK2 increases Elk-1 and FOS expression",
    "amt_pos.coord_last": "ERK2 increases FOS and Elk-1 secretion",
}


def test_every_pattern_has_a_sentence():
    assert [r[0] for r in R.catalogue()] == list(SENTENCES) and len(SENTENCES) == 48


@pytest.mark.parametrize("pattern_id", SENTENCES)
def test_pattern(pattern_id):
    import re

    _, axis, sign, pattern = next(r for r in R.catalogue() if r[0] == pattern_id)
    m = re.search(pattern, SENTENCES[pattern_id], re.IGNORECASE)
    assert m and (context.normal(m["X"]), context.normal(m["Y"])) == ("erk2", "elk1")
    found = context.detected(SENTENCES[pattern_id], NAMES)
    assert (axis, sign, "MAPK1", "ELK1") in {(d["axis"], d["sign"], d["agent"], d["target"]) for d in found}
    assert not re.search(pattern, "ERK2 was seen. Elk-1 was not.", re.IGNORECASE)


def test_columns_agree_with_the_pass(spark):
    names = F.array(*[F.struct(F.lit(e["name"]).alias("name"), F.array(*map(F.lit, e["aliases"])).alias("aliases")) for e in NAMES])
    some = [SENTENCES[k] for k in ("mod_pos.active_verb", "bind.between_and", "act_neg.verb_y_activation", "amt_pos.coord_last")]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    for r in df.select("t", context.relations(F.col("t"), names).alias("r")).collect():
        want = {(d["axis"], d["sign"], d["agent"], d["target"]) for d in context.detected(r.t, NAMES)}
        assert {(x.axis, x.sign, x.agent, x.target) for x in r.r} == want


def test_normalised(spark):
    words = ["NF-κB", "TGF-beta", "theta", "θ", "p53", "α-x.'", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", context.normalised(F.col("w")).alias("n")).collect()
    assert [r.n for r in got] == ["nfkb", "tgfb", "thh", "q", "p53", "ax", None]
    assert all((context.normal(r.w) or None) == r.n for r in got)


def test_text_columns(spark):
    def one(c, t):
        return spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x

    assert one(context.clauses, "This is the first one. Short. And here the second one!") == ["This is the first one.", "And here the second one!"]
    assert one(context.clauses, "Only one here.") == ["Only one here."] and one(context.clauses, " ") == []
    c = one(context.chain, "A acts via MEK1 and RAF → MEK → ERK")
    assert c.has_chain and c.candidates == ["MEK1", "RAF", "MEK", "ERK"]
    assert not one(context.chain, "A activates B").has_chain
    assert one(context.nominalisations, "INS-induced activation of PI3K and ins-induced ACTIVATION of pi3k") == ["INS-induced activation of PI3K"]
    assert one(context.cascade_terminals, "the RAF/MEK/ERK pathway and JAK-STAT3-SOCS signaling") == ["ERK", "SOCS"]
    names = F.array(*[F.struct(F.lit(e["name"]).alias("name"), F.array(*map(F.lit, e["aliases"])).alias("aliases")) for e in NAMES])
    assert one(lambda t: context.cascade_terminals(t, names), "RAF/MEK/ERK2 pathway, A/B/ERK2 axis, a/b/c cascade and JAK-STAT3-Elk1 signaling") == ["MAPK1", "ELK1"]


def test_positions_detectors():
    assert context.sites("phosphorylated at S102 and serine 15") == ["S102", "S15"]
    assert context.sites("the S100 protein; see Fig. S12; T7 polymerase") == []
    spans = context.positions("ERK2 may bind", ["ERK2"])
    assert context.hedges("ERK2 may bind", spans) == ["may"] and context.hedges("ERK2 binds; others may not", spans) == []
    assert context.perturbation("ERK2 siRNA reduced it", ["ERK2"]) == "loss_of_function"
    assert context.perturbation("overexpression of ERK2", ["ERK2"]) == "gain_of_function"
    assert context.perturbation("an inhibitor of ERK2 and ERK2 overexpression", ["ERK2"]) == "loss_of_function"
    assert context.perturbation("ERK2 is here", ["ERK2"]) is None
    assert context.upstream("ERK2-induced x", ["ERK2"]) and context.upstream("driven by ERK2", ["ERK2"]) and not context.upstream("ERK2", ["ERK2"])
    t = "ERK2 does not activate Elk-1"
    assert context.negated(t, context.positions(t, ["ERK2"]), context.positions(t, ["Elk-1"]))
    assert not context.negated(t, context.positions(t, ["ERK2"]), [])
    assert context.sites("phosphorylation " + "x " * 14 + "at T185 and Y187") == ["T185"]  # the second one is too far off
    assert context.sites("S102 is modified. Table T9 shows residue S5 kinase") == ["S102"]
    assert context.hedges("presumably to bind ERK2", context.positions("presumably to bind ERK2", ["ERK2"])) == ["presumably", "presumably to"]
    far = "may " + "x" * 70 + " ERK2"
    assert context.hedges(far, context.positions(far, ["ERK2"])) == []
    far = "ERK2 " + "x" * 60 + " not " + "x" * 60 + " Elk-1"
    assert not context.negated(far, context.positions(far, ["ERK2"]), context.positions(far, ["Elk-1"]))


def test_features_of_a_batch_are_those_of_each_row():
    texts = [*SENTENCES.values(), "ERK2 may not bind Elk-1; residue S383 is modified", None, "", "ERK2 knockdown reduced ELK1-induced phosphorylation", "ERK2 may not bind Elk-1; residue S383 is modified"]
    rows = [(t, "MAPK1", "ELK1", NAMES) for t in texts]
    together = context.features(*zip(*rows))
    assert together == [context.features([t], [s], [o], [e])[0] for t, s, o, e in rows]
    assert together[48]["sites"] == ["S383"] and together[48]["hedges"] == ["may"] and together[48]["negated"] and together[51]["subject_perturbation"] == "loss_of_function"


def test_catalogue_order():
    found = context.detected("AAA upregulates BBB. AAA inhibits the activation of BBB.", [{"name": n, "aliases": []} for n in ("AAA", "BBB")])
    assert [d["pattern_id"] for d in found][:1] == ["act_neg.verb_activation_of"]
    assert [k.split(".")[0] for k in dict.fromkeys(k.split(".")[0] for k in SENTENCES)] == ["mod_pos", "bind", "act_pos", "act_neg", "amt_pos"]


def pairs(spark, rows):
    entity = "array<struct<name:string,aliases:array<string>>>"
    df = spark.createDataFrame([(i, k, ["MAPK1", "ELK1"], t, [(e["name"], e["aliases"]) for e in NAMES]) for i, (k, t) in enumerate(rows)], f"evidence_hash int, stmt_type string, agents array<string>, text string, entities {entity}")
    return context.build(claims.parse(df.withColumn("stmt_hash", F.col("evidence_hash"))))


CASES = [
    ("Phosphorylation", "ERK2 phosphorylates Elk-1.", ("present_as_subject", "present_as_object", "direct_sign_match", None)),
    ("Phosphorylation", "Elk-1 phosphorylates ERK2.", (None, None, None, None)),
    ("Activation", "ERK2 phosphorylates Elk-1.", ("present_as_subject", "present_as_object", "direct_axis_mismatch", None)),
    ("Activation", "ERK2 suppresses Elk-1 signaling.", ("present_as_subject", "present_as_object", "direct_sign_mismatch", None)),
    ("Inhibition", "ERK2 siRNA was used; ERK2 activates Elk-1.", ("present_as_subject", "present_as_object", "direct_sign_match", None)),
    ("Complex", "Elk-1 binds ERK2.", ("present_as_subject", "present_as_object", "direct_sign_match", None)),
    ("Activation", "ERK2 does not activate Elk-1", (None, None, None, "negated")),
    ("Activation", "ERK2 may signal to Elk-1", (None, None, None, "hedged")),
    ("Activation", "nothing here", (None, None, None, None)),
    ("Activation", None, (None, None, None, None)),
]


def test_routing_and_decision(spark):
    routed = routing.route(pairs(spark, [(k, t) for k, t, _ in CASES]))
    got = {r.evidence_hash: r.probes for r in routed.collect()}
    for i, (_, text, want) in enumerate(CASES):
        answers = tuple(got[i][p].answer if got[i][p] else None for p in routing.PROBES)
        if text == "Elk-1 binds ERK2.":
            assert answers[2] == "direct_sign_match"
        else:
            assert answers == want, text
    decided = {r.evidence_hash: r for r in decide.decide(routing.answer_open(routed)).collect()}
    assert (decided[0].verdict, decided[0].reason, decided[0].confidence, decided[0].score) == ("correct", "regex_substrate_match", "medium", 0.8)
    assert decided[8].verdict == "abstain" and decided[8].score == 0.5
    asserted = {"scope": lambda claim, text: F.struct(F.lit("asserted").alias("answer"), F.lit("llm").alias("source"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("perturbation"))}
    done = {r.evidence_hash: r for r in decide.decide(routing.answer_open(routed, asserted)).collect()}
    assert (done[0].verdict, done[0].confidence, done[0].score) == ("correct", "high", 0.95)
    assert (done[2].verdict, done[2].reason, done[2].score) == ("incorrect", "axis_mismatch", 0.05)
    assert (done[3].verdict, done[3].reason) == ("incorrect", "sign_mismatch")
    steps = routing.step_rows(routed, "r").groupBy("step_kind").count().collect()
    assert {r.step_kind: r["count"] for r in steps}["parse_claim"] == len(CASES)


def plain_verdict(s, o, r, c, kind, axis):
    causal = kind in claims.CAUSAL
    if "absent" in (s, o):
        return "abstain", "grounding_gap"
    if "present_as_decoy" in (s, o):
        return "incorrect", "absent_relationship"
    if "present_as_mediator" in (s, o):
        return "abstain", "indirect_chain"
    if (s, o) == ("present_as_object", "present_as_subject") and axis != "binding":
        return "incorrect", "role_swap"
    fixed = {"no_relation": "absent_relationship", "direct_axis_mismatch": "axis_mismatch", "direct_partner_mismatch": "binding_domain_mismatch", "direct_sign_mismatch": "sign_mismatch"}
    if r in fixed:
        return "incorrect", fixed[r]
    if r == "via_mediator_partial":
        return ("correct" if causal else "abstain"), "chain_extraction_gap"
    if r == "via_mediator" and not causal:
        return "abstain", "indirect_chain"
    if r == "abstain":
        return "abstain", None
    return {"hedged": ("correct", "hedging_hypothesis"), "negated": ("incorrect", "contradicted")}.get(c, ("correct", "match"))


def test_alike_sentences_are_worked_once(spark):
    """Nulls and empty texts are kept apart; scoring reads the distinct sentences in one pass."""
    from evidentia.plans import catalogue, scoring  # noqa: F401

    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([("x", None), (None, "x"), ("x", ""), (None, None)] * 3)], "id long, a string, b string")
    seen = []

    def work(each):
        seen.append(each.count())
        return each.withColumn("c", F.to_json(F.struct("a", "b")))

    got = context.once(rows, ["a", "b"], work).collect()
    assert seen == [4] and len(got) == 12 and all(r.c == json.dumps({k: r[k] for k in "ab" if r[k] is not None}, separators=(",", ":")) for r in got)
    plan = catalogue.QUERIES["scored_sentences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_evidences_are_gathered_by_sentence(spark):
    """Odd rows too are what the pass over every row makes of them; scoring reads its table once and joins nothing."""
    from evidentia.plans import catalogue, scoring

    alike = [("Activation", "A1", "B1", "A1 activates B1."), ("Complex", "A1", "B1", "A1 activates B1."), ("Activation", "A1", None, "A1 activates B1."), ("Inhibition", None, "B1", "B1 may inhibit"), ("Complex", None, None, None), (None, "A1", "B1", "")]
    rows = spark.createDataFrame([(None if i % 5 == 4 else i, *alike[i % 6]) for i in range(60)], "evidence_hash long, stmt_type string, subject string, object string, text string")
    got = scoring._parsed(context.gathered(rows, "evidence_hash", ["stmt_type", "subject", "object", "text"], scoring._asked))
    assert got.count() == 6
    kept = ["evidence_hash", "stmt_type", "subject", "object", "text", "ctx", "claim"]
    each = lambda df: sorted(map(repr, df.select(kept).collect()))
    assert each(got.withColumn("evidence_hash", F.explode("of"))) == each(scoring._pairs(lambda name: rows))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [0] * (context.HELD // 16)})
    assert [len(lot) for lot in context._lots(iter([batch] * 5))] == [2, 2, 1]
    parts = [pa.table({"a": pa.array(a), "k": pa.array(k, pa.int64())}) for a, k in ((["x", None, "x"], [1, 2, None]), (["y"], [4]), ([None, "x", "y"], [5, 6, 7]))]
    merged = context._merged([context._grouped(t, ["a"], "k") for t in parts], ["a"]).to_pylist()
    assert sorted((r["a"] or "", r["of"]) for r in merged) == [("", [2, 5]), ("x", [1, None, 6]), ("y", [4, 7])]
    for name in ("scored_sentences", "route_probes", "relation_catalogue"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Scan parquet") == plan.count("MapInArrow") == 1


def test_answered_pairs_stay_out_of_python(spark):
    """A Python answerer gets open pairs only, and gives what a column does."""
    answer = F.udf(lambda text: ("asserted", "llm", "high", None) if "open" in text else 1 / 0, routing.ANSWER)
    column = F.struct(F.lit("asserted").alias("answer"), F.lit("llm").alias("source"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("perturbation"))
    given = "named_struct('answer', 'hedged', 'source', 'substrate', 'confidence', 'medium', 'perturbation', cast(null as string))"
    probes = ", ".join(f"'{p}', " + (f"if(id < 2, {given}, null)" if p == "scope" else given) for p in routing.PROBES)
    routed = spark.range(4).selectExpr("id", "id AS claim", "if(id < 2, 'done', 'open') AS text", f"named_struct({probes}) AS probes")
    by = [sorted((r.id, r.probes.scope.answer) for r in routing.answer_open(routed, {"scope": f}).collect()) for f in (lambda claim, text: answer(text), lambda claim, text: column)]
    assert by == [[(0, "hedged"), (1, "hedged"), (2, "asserted"), (3, "asserted")]] * 2


def test_whole_decision_table(spark):
    rows = [(*x, k, claims.AXES[k][0]) for x in product(*routing.ANSWERS.values()) for k in ("Activation", "Complex", "Phosphorylation")]
    df = spark.createDataFrame(rows, "s string, o string, r string, c string, kind string, axis string")
    probe = lambda c: F.struct(F.col(c).alias("answer"), F.lit("llm").alias("source"))
    got = df.select("*", decide.verdict(probe("s"), probe("o"), probe("r"), probe("c"), F.col("kind"), F.col("axis")).alias("v")).collect()
    assert len(got) == len(rows) == 5 * 5 * 8 * 4 * 3
    assert all((x.v.verdict, x.v.reason) == plain_verdict(*x[:6]) for x in got)


def test_replies(spark):
    reply = lambda t, p: spark.createDataFrame([(t,)], "t string").select(routing.closed_answer(F.col("t"), p).alias("x")).first().x
    assert reply('{"answer": "hedged", "confidence": "high"}', "scope")[:3] == ("hedged", "llm", "high")
    assert reply('Sure: {"answer": "negated"} ok', "scope")[:3] == ("negated", "llm", "medium")
    assert reply("no json", "scope")[:2] == ("abstain", "abstain") and reply('{"answer": "x"}', "subject_role")[:2] == ("absent", "abstain")
    status = lambda t: spark.createDataFrame([(t,)], "t string").select(entities.grounding_status(F.col("t")).alias("x")).first().x
    assert status('{"status": "mentioned"} then {"status": "equivalent"}') == "equivalent" and status("?") == "uncertain" and status(None) == "uncertain"


def test_claims(spark):
    rows = [("Complex", ["A", None, "B", "C"]), ("Autophosphorylation", ["A"]), ("Inhibition", ["MIR21", "PTEN"]), ("Strange", []), ("Dephosphorylation", ["A", "B"])]
    got = [r.claim for r in claims.parse(spark.createDataFrame(rows, "stmt_type string, agents array<string>")).collect()]
    assert [(c.subject, c.objects, c.axis, c.sign) for c in got] == [("A", ["B", "C"], "binding", "neutral"), ("A", ["A"], "modification", "positive"), ("MIR21", ["PTEN"], "amount", "negative"), ("?", [], "unclear", "neutral"), ("A", ["B"], "modification", "negative")]
    assert claims.violations(claims.parse(spark.createDataFrame(rows, "stmt_type string, agents array<string>"))).count() == 0
    keys = spark.createDataFrame([("-1",), ("255",), ("00000000000000FF",), ("zz",)], "h string").select(claims.statement_key(F.col("h")).alias("k")).collect()
    assert [r.k for r in keys] == ["f" * 16, "00000000000000ff", "00000000000000ff", None]


def test_entities(spark):
    cand = spark.createDataFrame([("ERK2", 0, "MAPK1", "HGNC", "6871", 0.9), ("ERK", 0, "ERK", "FPLX", "ERK", 0.8), ("p42", 0, "OTHER", "HGNC", "1", 0.5), ("p42", 1, "MAPK1", "HGNC", "6871", 0.4), ("q9", 0, "Q9", "HGNC", "2", 0.9)], "text string, position int, entry string, db string, id string, score double")
    fam = spark.createDataFrame([("HGNC:6871", "FPLX:ERK")], "child string, parent string")
    rows = [(i, t, "MAPK1", None, "HGNC", "6871", ["MAPK1", "MAP kinase 1"]) for i, t in enumerate(["erk2", "ERK", "p42", "q9", "nothing"])]
    got = entities.verify(spark.createDataFrame(rows, "id int, raw_text string, name string, canonical string, db string, db_id string, all_names array<string>"), cand, fam).orderBy("id").collect()
    assert [r.status for r in got] == ["MATCH", "MATCH", "AMBIGUOUS", "MISMATCH", "UNRESOLVABLE"] and got[2].low_confidence
    t = spark.createDataFrame([("TNF", "the TNF level", True), ("TNF", "TNFR", False), ("NF-kappaB", "nfkappab here", True)], "n string, t string, w boolean")
    assert all(r.x == r.w for r in t.select("w", entities.mentioned(F.col("n"), F.col("t")).alias("x")).collect())


def test_curations(spark):
    from evidentia.operators import curate

    evidence = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", "z"), (None, "d", "w")], "source_hash long, id string, tag string")
    cur = spark.createDataFrame([(1, "ok", "p"), (1, "wrong", "q"), (3, "ok", "r"), (None, "ok", "s")], "source_hash long, tag string, curator string")
    got = curate.curated(evidence, cur).select("id", "tag", "curation_tag", "curator").collect()
    assert sorted(map(tuple, got)) == [("a", "x", "ok", "p"), ("a", "x", "wrong", "q"), ("b", "y", "ok", "p"), ("b", "y", "wrong", "q")]
    rows = spark.createDataFrame([(1, "A", "B", "t", 2), (1, "A", "C", "t", 1), (2, "A", "B", "t", 3), (3, "?", "?", "t", 4), (4, "A", "D", "", 5), (5, "E", "F", "t", 6), (6, "A", "E", "t", 7)], "source_hash long, subject string, object string, text string, n int")
    keys = curate.excluded(spark.createDataFrame([(6,), (None,)], "source_hash long"), spark.createDataFrame([(6,), (7,)], "source_hash long"))
    assert keys.count() == 2
    pairs = spark.createDataFrame([("E", "F")], "subject string, object string")
    assert sorted((r.source_hash, r.n) for r in curate.available(rows, keys, pairs, order="n").collect()) == [(1, 1), (2, 3)]
