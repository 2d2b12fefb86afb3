"""Belief algebra: per-source noise, gating by verdicts, contradiction, aggregation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp

# Random and systematic error by source.
PRIORS: dict[str, tuple[float, float]] = {
    "reach": (0.30, 0.05),
    "sparser": (0.30, 0.05),
    "trips": (0.30, 0.05),
    "rlimsp": (0.20, 0.05),
    "medscan": (0.30, 0.05),
    "eidos": (0.30, 0.05),
    "cwms": (0.30, 0.05),
    "signor": (0.049, 0.01),
    "biogrid": (0.01, 0.01),
    "phosphosite": (0.01, 0.01),
    "cbn": (0.01, 0.01),
    "trrust": (0.10, 0.01),
    "tas": (0.01, 0.01),
    "hprd": (0.01, 0.01),
    "pid": (0.01, 0.01),
    "reactome": (0.01, 0.01),
    "kegg": (0.01, 0.01),
    "drugbank": (0.01, 0.01),
}
# Sources whose random error was measured on curated records.
RECALIBRATED = PRIORS | {"reach": (0.462, 0.05), "sparser": (0.516, 0.05), "trips": (0.077, 0.05), "medscan": (0.481, 0.05), "rlimsp": (0.056, 0.05)}
UNKNOWN = (0.30, 0.10)


def error(source: Column, n: Column, priors: dict[str, tuple[float, float]] | None = None) -> Column:
    """Probability that ``n`` reports of a source are all wrong: its systematic error and random**n."""
    priors = PRIORS if priors is None else priors
    pairs = [x for s, (r, y) in priors.items() for x in (F.lit(s), F.struct(F.lit(float(r)).alias("rand"), F.lit(float(y)).alias("syst")))]
    unknown = F.struct(F.lit(UNKNOWN[0]).alias("rand"), F.lit(UNKNOWN[1]).alias("syst"))
    prior = F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(source)), unknown) if pairs else unknown
    return prior["syst"] + F.pow(prior["rand"], n)


def from_counts(counts: DataFrame, keys: list[str], source: str = "source_api", n: str = "n", priors=None) -> DataFrame:
    """Belief of each key from rows (key, source, count); counts of 0 and less say nothing."""
    factor = F.when(F.col(n) > 0, error(F.col(source), F.col(n), priors)).otherwise(F.lit(1.0))
    return counts.groupBy(*keys).agg(clamp(1 - F.product(factor)).alias("belief"))


def from_list(rows: DataFrame, keys: list[str], sources: str = "sources", total: str = "evidence_count", priors=None) -> DataFrame:
    """Belief of each row (``keys`` unique) from its list of sources and the evidence they have in all.

    Each distinct source has one piece of evidence; what is left over falls to the first in
    the alphabet. No sources, or no evidence: 0.
    """
    names = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast("array<string>"))))
    extra = F.greatest(F.lit(0), F.col(total) - F.size("__s"))
    count = lambda i: F.when(F.size("__s") == 1, F.col(total)).otherwise(F.lit(1) + F.when(i == 0, extra).otherwise(F.lit(0)))
    wrong = F.aggregate(F.transform("__s", lambda s, i: error(s, count(i), priors)), F.lit(1.0), lambda a, x: a * x)
    belief = F.when((F.size("__s") == 0) | (F.col(total) <= 0), F.lit(0.0)).otherwise(clamp(1 - wrong))
    return rows.withColumn("__s", names).select(*keys, belief.alias("belief"))


def kept(verdict: Column, gate_unscored: bool = False) -> Column:
    """Whether evidence passes the hard gate: correct does, unscored does unless it is gated, else not."""
    v = F.lower(verdict)
    return F.when(v.isNull() | (v == "abstain"), F.lit(not gate_unscored)).otherwise(v == "correct")


def included(flag: Column) -> Column:
    """An inclusion flag that may be text; a missing one includes."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))) == "true", F.lit(True))


def gated(evidence: DataFrame, keys: list[str], source: str = "source_api", flag: str = "included", priors=None) -> DataFrame:
    """Belief of each key with gated evidence left out, and without gating.

    A source whose evidence is all gated says nothing. Evidence without a source is an error.
    Returns ``keys, belief, parametric_only, n_total, n_surviving, n_gated, per_source``, the
    last an array in order of the source's name. Two combinable aggregates on one
    partitioning: the second groups by a subset of the first's keys.
    """
    name = F.coalesce(F.lower(F.col(source)), F.raise_error(F.lit("evidence without a source")).cast("string"))
    by_source = evidence.groupBy(*keys, name.alias("source")).agg(F.count(F.lit(1)).alias("total"), F.sum(included(F.col(flag)).cast("long")).alias("alive"))
    factor = F.when(F.col("alive") == 0, F.lit(1.0)).otherwise(error(F.col("source"), F.col("alive"), priors))
    detail = F.struct("source", F.col("total").alias("n_total"), F.col("alive").alias("n_surviving"), factor.alias("factor"))
    return by_source.groupBy(*keys).agg(
        clamp(1 - F.product(factor)).alias("belief"),
        clamp(1 - F.product(error(F.col("source"), F.col("total"), priors))).alias("parametric_only"),
        F.sum("total").alias("n_total"),
        F.sum("alive").alias("n_surviving"),
        F.sum(F.col("total") - F.col("alive")).alias("n_gated"),
        F.array_sort(F.collect_list(detail)).alias("per_source"),
    )


def contradicted(evidence: DataFrame, keys: list[str], direction: str = "regulation_type", position: str = "position", source: str = "source_api", flag: str = "included", priors=None) -> DataFrame:
    """Gated belief of the dominant direction, less what contradicts it.

    Directions are believed by themselves; the strongest (the first seen, by ``position``,
    of equals) is multiplied by one minus the strongest other, in which ``unknown`` has
    no part. Counts are of all directions.
    """
    known = evidence.withColumn("__d", F.coalesce(F.col(direction), F.lit("unknown")))
    each = gated(known, [*keys, "__d"], source, flag, priors)
    first = known.groupBy(*keys, "__d").agg(F.min(position).alias("__p"))
    each = each.join(first, [*keys, "__d"])
    rows = F.array_sort(F.collect_list(F.struct((-F.col("belief")).alias("b"), F.col("__p").alias("p"), F.col("__d").alias("d"), "parametric_only")))
    whole = each.groupBy(*keys).agg(rows.alias("r"), *[F.sum(c).alias(c) for c in ("n_total", "n_surviving", "n_gated")])
    others = F.filter(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x["d"] != "unknown")
    top = F.get("r", F.lit(0))
    worst = F.array_max(F.transform("others", lambda x: -x["b"]))
    return whole.withColumn("others", others).select(
        *keys, (-top["b"] * (1 - F.coalesce(worst, F.lit(0.0)))).alias("belief"), top["parametric_only"].alias("parametric_only"), top["d"].alias("dominant"), (F.size("others") > 0).alias("is_contradictory"), "n_total", "n_surviving", "n_gated"
    )


def edge_contradiction(edges: DataFrame, keys: list[str], priors=None) -> DataFrame:
    """Parametric belief with contradiction from edges (key, position, regulation_type, sources, evidence_count)."""
    known = edges.withColumn("__d", F.coalesce("regulation_type", F.lit("unknown")))
    merged = known.groupBy(*keys, "__d").agg(F.flatten(F.collect_list("sources")).alias("sources"), F.sum("evidence_count").alias("evidence_count"), F.min("position").alias("__p"))
    each = from_list(merged, [*keys, "__d", "__p"], priors=priors)
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("belief")).alias("b"), F.col("__p").alias("p"), F.col("__d").alias("d")))).alias("r"))
    others = F.filter(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))), lambda x: x["d"] != "unknown")
    worst = F.coalesce(F.array_max(F.transform("o", lambda x: -x["b"])), F.lit(0.0))
    return whole.withColumn("o", others).select(*keys, (-F.get("r", F.lit(0))["b"] * (1 - worst)).alias("belief"), F.get("r", F.lit(0))["d"].alias("dominant"), (F.size("o") > 0).alias("is_contradictory"))


def edge_score(evidence: DataFrame, keys: list[str], verdict: str = "verdict", gate_unscored: bool = False, priors=None) -> DataFrame:
    """Gated belief of each edge from its evidence's verdicts, and whether any verdict is there."""
    flagged = evidence.withColumn("included", kept(F.col(verdict), gate_unscored))
    scored = evidence.groupBy(*keys).agg(F.max(F.col(verdict).isNotNull()).alias("has_scores"))
    return gated(flagged, keys, priors=priors).join(scored, keys)


def statement_score(statements: DataFrame, verdicts: DataFrame, key: str = "stmt_hash", gate_unscored: bool = False, priors=None) -> DataFrame:
    """Gated belief of statements from their evidence array and verdicts by position.

    ``statements``: ``key, sources`` (an array; a missing source is ``unknown``);
    ``verdicts``: ``key, position, verdict``. Evidence without a verdict there is unscored; a
    statement without evidence has belief 0.
    """
    rows = statements.select(key, F.posexplode("sources").alias("position", "source_api"))
    rows = rows.join(verdicts.select(key, "position", "verdict"), [key, "position"], "left")
    rows = rows.withColumn("source_api", F.coalesce(F.nullif("source_api", F.lit("")), F.lit("unknown")))
    found = edge_score(rows, [key], gate_unscored=gate_unscored, priors=priors).select(key, "belief", "parametric_only", "n_total", "n_surviving", "n_gated", "has_scores")
    zero = {"belief": 0.0, "parametric_only": 0.0, "n_total": 0, "n_surviving": 0, "n_gated": 0}
    return statements.select(key).join(found, key, "left").fillna(zero).fillna(False, ["has_scores"])


#: Ways to make one number of a statement's scores.
AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "noisy_or": lambda s: 1 - F.product(clamp(1 - s)),
}


def aggregate(steps: DataFrame, by: str | Callable = "mean", key: str = "stmt_hash", score: str = "score") -> DataFrame:
    """One belief a statement from its evidence's scores; missing scores are passed over.

    ``by``: the name of an aggregator, or a function from a list of floats to a float, which
    then runs on the executors for each statement's list.
    """
    rows = steps.where(F.col(score).isNotNull())
    if isinstance(by, str):
        return rows.groupBy(key).agg(AGGREGATORS[by](F.col(score)).alias("belief"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def fold(lists: pd.Series) -> pd.Series:
        return lists.map(lambda xs: float(by(xs.tolist())))

    return rows.groupBy(key).agg(F.array_sort(F.collect_list(score)).alias("__s"), F.count(F.lit(1)).alias("n")).select(key, fold("__s").alias("belief"), "n")
