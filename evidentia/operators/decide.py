"""The decision table: four probe answers, a claim and groundings to a verdict and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import CAUSAL

# Scores by verdict and confidence.
SCORES = {"correct": {"high": 0.95, "medium": 0.80, "low": 0.65}, "abstain": {"high": 0.50, "medium": 0.50, "low": 0.50}, "incorrect": {"high": 0.05, "medium": 0.20, "low": 0.35}}


def _v(verdict: str, reason: str | None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).cast("string").alias("reason"))


def verdict(sr: Column, ob: Column, ra: Column, sc: Column, stmt_type: Column, axis: Column) -> Column:
    """(verdict, reason) of probe structs (answer, source); the first rule that fits decides."""
    s, o, r, c = (x["answer"] for x in (sr, ob, ra, sc))
    gone = F.lit(False)
    for x in (sr, ob, ra, sc):
        gone = gone | (x["source"] == "abstain")
    causal = stmt_type.isin(CAUSAL)
    scoped = lambda other: F.when(c == "hedged", _v("correct", "hedging_hypothesis")).when(c == "negated", _v("incorrect", "contradicted")).otherwise(other)
    return (
        F.when(gone, _v("abstain", None))
        .when((s == "absent") | (o == "absent"), _v("abstain", "grounding_gap"))
        .when((s == "present_as_decoy") | (o == "present_as_decoy"), _v("incorrect", "absent_relationship"))
        .when((s == "present_as_mediator") | (o == "present_as_mediator"), _v("abstain", "indirect_chain"))
        .when((s == "present_as_object") & (o == "present_as_subject") & (axis != "binding"), _v("incorrect", "role_swap"))
        .when(r == "no_relation", _v("incorrect", "absent_relationship"))
        .when(r == "direct_axis_mismatch", _v("incorrect", "axis_mismatch"))
        .when(r == "direct_partner_mismatch", _v("incorrect", "binding_domain_mismatch"))
        .when(r == "direct_sign_mismatch", _v("incorrect", "sign_mismatch"))
        .when((r == "via_mediator") & causal, scoped(_v("correct", "match")))
        .when(r == "via_mediator", _v("abstain", "indirect_chain"))
        .when(r == "via_mediator_partial", F.when(causal, _v("correct", "chain_extraction_gap")).otherwise(_v("abstain", "chain_extraction_gap")))
        .when(r == "direct_sign_match", scoped(_v("correct", "match")))
        .otherwise(_v("abstain", None))
    )


def rescued(claim: Column, relations: Column) -> Column:
    """Whether the catalogue has the claim's own relation, by axis and (unadjusted) sign."""
    obj = F.coalesce(F.get(claim["objects"], F.lit(0)), claim["subject"])
    forth = lambda r: (r["agent"] == claim["subject"]) & (r["target"] == obj)
    back = lambda r: (claim["axis"] == "binding") & (r["agent"] == obj) & (r["target"] == claim["subject"])
    return F.exists(relations, lambda r: (forth(r) | back(r)) & (r["axis"] == claim["axis"]) & (r["sign"] == claim["sign"]))


def confidence(verdict: Column, reason: Column, scope_answer: Column, uncertain: Column) -> Column:
    weak = F.coalesce(reason.isin("hedging_hypothesis", "chain_extraction_gap"), F.lit(False)) | F.coalesce(scope_answer == "abstain", F.lit(False))
    return F.when(verdict == "incorrect", "high").when(verdict == "abstain", "medium").when(reason == "regex_substrate_match", "medium").when(weak, "low").when(uncertain, "medium").otherwise("high")


def score(verdict: Column, confidence: Column) -> Column:
    pairs = [x for v, by in SCORES.items() for c, s in by.items() for x in (F.lit(f"{v}|{c}"), F.lit(s))]
    return F.try_element_at(F.create_map(*pairs), F.concat_ws("|", verdict, confidence))


def decide(pairs: DataFrame, groundings: str | None = None) -> DataFrame:
    """``pairs`` (claim, probes and, for rescues, ctx) with verdict, reason, confidence and score.

    ``groundings``: a column of grounding statuses; one that is uncertain lowers confidence.
    """
    p = F.col("probes")
    out = pairs.withColumn("__d", verdict(p["subject_role"], p["object_role"], p["relation_axis"], p["scope"], F.col("claim.stmt_type"), F.col("claim.axis")))
    if "ctx" in pairs.columns:
        saved = (F.col("__d.verdict") == "abstain") & rescued(F.col("claim"), F.col("ctx.relations"))
        out = out.withColumn("__d", F.when(saved, _v("correct", "regex_substrate_match")).otherwise(F.col("__d")))
    unsure = F.exists(F.coalesce(groundings, F.array().cast("array<string>")), lambda g: g == "uncertain") if groundings else F.lit(False)
    out = out.withColumn("verdict", F.col("__d.verdict")).withColumn("reason", F.col("__d.reason")).drop("__d")
    out = out.withColumn("confidence", confidence(F.col("verdict"), F.col("reason"), p["scope"]["answer"], unsure))
    return out.withColumn("score", score(F.col("verdict"), F.col("confidence")))


def output_json(pairs: DataFrame) -> DataFrame:
    """Decided pairs as aggregate step rows."""
    body = F.struct("score", "verdict", "confidence", F.array_compact(F.array("reason")).alias("reasons"), F.lit(0).alias("tokens"), F.array().cast("array<string>").alias("call_log"))
    return pairs.select("stmt_hash", "evidence_hash", F.lit("aggregate").alias("step_kind"), F.to_json(body, {"ignoreNullFields": "false"}).alias("output_json"))


def trace(pair: Column) -> Column:
    """The answers of the four probes as one line."""
    parts = [F.concat(F.lit(f"{n}="), F.coalesce(pair[n]["answer"], F.lit("open")), F.lit("/"), F.coalesce(pair[n]["source"], F.lit("-"))) for n in ("subject_role", "object_role", "relation_axis", "scope")]
    return F.concat_ws(" ", *parts)
