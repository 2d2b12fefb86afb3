"""Validity of a run: calibration, dispersion, agreement with gold labels, graph plausibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, ratio


def statement_scores(steps: DataFrame, key: str = "stmt_hash") -> DataFrame:
    """Mean score of each statement and how many of its evidences have one."""
    return steps.where("score is not null").groupBy(key).agg(F.avg("score").alias("our_score"), F.count(F.lit(1)).alias("n_ev"))


def verdict_shares(steps: DataFrame) -> DataFrame:
    """Share of each verdict; a missing one counts as unknown."""
    counts = steps.groupBy(F.coalesce("verdict", F.lit("unknown")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("verdict", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def _gaps(steps: DataFrame, statements: DataFrame) -> DataFrame:
    both = statement_scores(steps).join(statements, "stmt_hash").where("published_belief is not null")
    return both.withColumn("gap", F.col("our_score") - F.col("published_belief"))


def calibration(steps: DataFrame, statements: DataFrame) -> DataFrame:
    """Mean absolute error, root mean square error and bias against the published belief."""
    g = F.col("gap")
    return _gaps(steps, statements).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(g)).alias("mae"), F.sqrt(F.avg(g * g)).alias("rmse"), F.avg(g).alias("bias"))


def dispersion(steps: DataFrame) -> DataFrame:
    """Mean and largest spread of scores within statements that have more than one."""
    each = steps.where("score is not null").groupBy("stmt_hash").agg(F.stddev_pop("score").alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.agg(F.avg("s").alias("mean_stdev"), F.max("s").alias("max_stdev"), F.count(F.lit(1)).alias("n_statements"))


def stratified(steps: DataFrame, statements: DataFrame, evidence: DataFrame | None = None, stratum: str = "stmt_type", least: int = 2) -> DataFrame:
    """Calibration by stratum: a column of the statement or, with ``evidence``, its first source by name."""
    gaps = _gaps(steps, statements)
    if evidence is not None:
        gaps = gaps.join(evidence.groupBy("stmt_hash").agg(F.min("source_api").alias(stratum)), "stmt_hash")
    out = gaps.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("gap")).alias("mae"), F.avg("gap").alias("bias"))
    return out.where(F.col("n") >= least).orderBy(F.desc("mae"), stratum)


def agreement(predicted: DataFrame, gold: DataFrame, key: str, positive: str = "correct", by: str = "truth_set_id") -> DataFrame:
    """Confusion counts, precision, recall and F1 by truth set; 0 where a ratio has no base."""
    both = predicted.join(gold, key)
    p, g = F.col("verdict") == positive, F.col("gold") == positive
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = both.groupBy(by).agg(count(p & g).alias("tp"), count(p & ~g).alias("fp"), count(~p & g).alias("fn"), count(~p & ~g).alias("tn"))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def support_effect(steps: DataFrame, statements: DataFrame) -> DataFrame:
    """Mean score of statements with and without supporters, and the difference; no row unless both exist."""
    rows = statement_scores(steps).join(statements, "stmt_hash")
    has = F.col("supports_count") + F.col("supported_by_count") > 0
    out = rows.agg(
        F.avg(F.when(has, F.col("our_score"))).alias("mean_with"), F.avg(F.when(~has, F.col("our_score"))).alias("mean_without"),
        F.sum(has.cast("long")).alias("n_with"), F.sum((~has).cast("long")).alias("n_without"),
    )
    return out.where("n_with > 0 and n_without > 0").withColumn("delta", F.col("mean_with") - F.col("mean_without"))


def residual_histogram(steps: DataFrame, statements: DataFrame, bins: int = 11) -> DataFrame:
    """Counts of our minus published belief in equal bins of [-1, 1]; every bin has a row."""
    at = F.least(F.floor((clamp(F.col("gap"), -1.0, 1.0) + 1) * (bins / 2)), F.lit(bins - 1)).cast("int")
    counts = _gaps(steps, statements).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = steps.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # a row a bin


def metric_rows(metrics: DataFrame, run_id: str) -> DataFrame:
    """A one-row metric table as long rows (run_id, metric_name, value); a null stays as a null with its reason."""
    names = metrics.columns
    pairs = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("value")) for n in names])
    long = metrics.select(F.inline(pairs))
    return long.select(F.lit(run_id).alias("run_id"), "metric_name", "value", F.when(F.col("value").isNull(), F.lit("no data")).alias("reason"))


def metric_pivot(long: DataFrame, names: list[str], key: str = "run_id") -> DataFrame:
    """Long metric rows as one wide row a key."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("metric_name") == n, F.col("value"))).alias(n) for n in names])
