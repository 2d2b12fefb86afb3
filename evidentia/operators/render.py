"""Text renderings of statements, beliefs, validity and coverage; highlights and lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import belief_phrase


def signed(x: Column, digits: int = 2) -> Column:
    """A number with its sign and fixed decimals."""
    return F.format_string(f"%+.{digits}f", x)


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def comparison(ours: Column, published: Column) -> Column:
    """Our belief against the published one, in words."""
    gap = ours - published
    word = F.when(ours.isNull() | published.isNull(), "no comparison").when(F.abs(gap) < 0.05, "agrees with the published belief").when(gap > 0, "above the published belief").otherwise("below the published belief")
    return F.concat(belief_phrase(ours), F.lit("; "), word)


def epistemics(direct: Column, negated: Column, curated: Column) -> Column:
    """What is known of how evidence was obtained; unknown flags say nothing."""
    parts = F.array_compact(F.array(F.when(direct, "direct").when(~direct, "indirect"), F.when(negated, "negated"), F.when(curated, "curated")))
    return F.array_join(parts, ", ")


def trace(kind: Column, sentence: Column, verdict: Column, reason: Column, score: Column) -> Column:
    """A statement's path to its verdict as one text; missing steps are left out."""
    parts = F.array_compact(F.array(
        F.concat(F.lit("Claim ("), kind, F.lit("): "), sentence),
        F.concat(F.lit("Verdict: "), verdict, F.when(reason.isNotNull(), F.concat(F.lit(" because of "), F.replace(reason, F.lit("_"), F.lit(" ")))).otherwise("")),
        F.concat(F.lit("Score: "), F.format_string("%.2f", score)),
    ))
    return F.array_join(parts, ". ")


def validity_line(measures: DataFrame) -> DataFrame:
    """Calibration measures (n, mae, bias) as a sentence."""
    lean = F.when(F.col("bias") > 0.02, "leans high").when(F.col("bias") < -0.02, "leans low").otherwise("is balanced")
    said = F.concat(F.lit("mean error "), F.format_string("%.3f", "mae"), F.lit(" over "), plural(F.col("n"), "statement", "statements"), F.lit("; "), lean)
    return measures.select(F.when(F.col("n") > 0, said).otherwise("no statements to compare").alias("sentence"))


def coverage_line(rates: DataFrame) -> DataFrame:
    """Coverage rates as a sentence."""
    share = lambda c: F.concat(F.format_string("%.0f", F.col(c) * 100), F.lit(" %"))
    said = F.concat(F.lit("rules answered all of "), share("all_substrate_rate"), F.lit("; "), share("short_circuited_rate"), F.lit(" were cut short; "), F.format_string("%.1f", "mean_invoked"), F.lit(" probes an evidence"))
    return rates.select(F.when(F.col("n_evidences") > 0, said).otherwise("no evidence yet").alias("sentence"))


def bar(x: Column, width: int = 20) -> Column:
    """A share as a bar of blocks."""
    n = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def cue(rationale: Column) -> Column:
    """The quoted cue in a rationale, if there is one."""
    return F.nullif(F.regexp_extract(rationale, "['\"]([^'\"]+)['\"]", 1), F.lit(""))


def highlight(text: Column, part: Column) -> Column:
    """A text in three: before, the part (whatever its case), after; null without it."""
    at = F.instr(F.lower(text), F.lower(part))
    n = F.length(part)
    return F.when(at > 0, F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), F.substring(text, at, n).alias("hit"), F.substring(text, at + n, F.length(text)).alias("after")))


def verdict_tally(steps: DataFrame, key: str = "stmt_hash") -> DataFrame:
    """Verdict counts and mean score of each statement."""
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v)
    return steps.groupBy(key).agg(n("correct"), n("incorrect"), n("abstain"), F.avg("score").alias("mean_score"))


def entity_context(name: Column, line: Column, status: Column, low_confidence: Column, note: Column) -> Column:
    """An entity's line, and its provenance where that is doubtful."""
    doubtful = status.isin("MISMATCH", "AMBIGUOUS") | F.coalesce(low_confidence, F.lit(False))
    return F.concat(name, F.lit(": "), line, F.when(doubtful, F.concat(F.lit("\n  provenance: "), F.coalesce(note, status))).otherwise(""))


def version_labels(spark, path: str, pattern: str = r"\b[A-Z]-phase\b|\bv\d+\b") -> DataFrame:
    """Lines of text files that hold a version label."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line")).where(F.rlike("line", F.lit(pattern)))
