"""Offline evaluation: ranking and probability metrics, flips, gates, costs, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import lookup


def average_precision(scored: DataFrame, score: str = "score", label: str = "label", slices: int = 1000) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds.

    Ties are one step, so the running sums are over distinct scores, not rows. They run by
    ``slices`` of the scores from 0 to 1 and begin with the sums of the slices above, so no
    task has the whole order.
    """
    part = F.floor(F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)) * slices)
    steps = scored.groupBy(score).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n")).withColumn("part", part)
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    sums = steps.groupBy("part").agg(F.sum("tp").alias("ptp"), F.sum("n").alias("pn"))
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("ptp", "pn")])
    over = Window.partitionBy("part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(F.broadcast(sums), "part").select("tp", (F.col("ptp") + F.sum("tp").over(over)).alias("ctp"), (F.col("pn") + F.sum("n").over(over)).alias("cn"))
    total = F.sum("tp")
    return run.agg(F.when(total > 0, F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / total).alias("auprc"))


def brier(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))


def calibration_error(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal half-open bins, of which a score of 1 is in none."""
    at = F.floor(F.col(score) * bins)
    cells = scored.where(F.col(score) < 1).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(label).alias("y"))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    return cells.agg(F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))).alias("gap")).crossJoin(total).select((F.coalesce("gap", F.lit(0.0)) / F.col("total")).alias("ece"))  # a row each


def gate_rates(rows: DataFrame, by: list[str], keep: str = "kept", label: str = "label") -> DataFrame:
    """False gate and false pass rates overall and by each column, in one pass.

    Rows (facet, value, n_true, n_false, false_gate_rate, false_pass_rate).
    """
    true, kept_ = F.col(label) == 1, F.col(keep)
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in by], F.struct(F.lit("overall").alias("facet"), F.lit("all").alias("value")))
    flat = rows.select(F.inline(facets), true.alias("t"), kept_.alias("k"))
    count = lambda c: F.sum(c.cast("long"))
    t, k = F.col("t"), F.col("k")
    out = flat.groupBy("facet", "value").agg(count(t).alias("n_true"), count(~t).alias("n_false"), count(t & ~k).alias("gated"), count(~t & k).alias("passed"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select("facet", "value", "n_true", "n_false", rate(F.col("gated"), F.col("n_true")).alias("false_gate_rate"), rate(F.col("passed"), F.col("n_false")).alias("false_pass_rate"))


def common_keys(systems: dict[str, DataFrame], key: str, value: str = "verdict") -> DataFrame:
    """Keys that all systems judged, with a column of verdicts for each system."""
    out = None
    for name, df in systems.items():
        part = df.select(key, F.col(value).alias(name))
        out = part if out is None else out.join(part, key)
    return out


def flip_table(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """How often each verdict of one system met each of another."""
    return rows.groupBy(F.col(a).alias("verdict")).pivot(b, values).count().fillna(0)


def accuracy(rows: DataFrame, verdict: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy over decided rows only; undecided ones are counted apart."""
    decided = F.col(verdict) != "abstain"
    right = F.when(decided, (F.col(verdict) == F.col(gold)).cast("double"))
    return rows.groupBy(*(by or [])).agg(F.avg(right).alias("accuracy"), F.sum(decided.cast("long")).alias("n_decided"), F.sum((~decided).cast("long")).alias("n_undecided"))


def outcome_classes(rows: DataFrame, old: str, new: str, gold: str) -> DataFrame:
    """Counts of regressions, gains, both right and both wrong between two systems."""
    a, b = F.col(old) == F.col(gold), F.col(new) == F.col(gold)
    kind = F.when(a & b, "both_right").when(a, "regression").when(b, "gain").otherwise("both_wrong")
    return rows.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def latency(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Interpolated median and 99th percentile, and the element at the 99th percentile's index."""
    c = F.col(column).cast("double")
    ordered = F.array_sort(F.collect_list(c))
    at = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * 0.99).cast("int"))
    out = [F.percentile(c, F.lit(0.5)).alias("p50"), F.percentile(c, F.lit(0.99)).alias("p99")]
    if by:  # whole groups in order, so only for groups of a bounded size
        out.append(F.get(ordered, at).alias("index_p99"))
    return rows.groupBy(*(by or [])).agg(*out)


def reasons(rows: DataFrame, column: str = "reasons") -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pass_rates(rows: DataFrame, by: str, key: str, passed: str = "passed", failures: int = 2) -> DataFrame:
    """Pass rate by pattern and the first failures of each."""
    rate = rows.groupBy(by).agg(F.avg(F.col(passed).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(key))
    bad = rows.where(~F.col(passed)).withColumn("__r", rank).where(F.col("__r") <= failures).groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("failures"))
    return rate.join(bad, by, "left")


def gates(measures: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row of measures as passed checks and a verdict: ship if all hold, hold if none, else partial."""
    flags = [c.alias(n) for n, c in checks.items()]
    n = sum((F.coalesce(F.col(k).cast("int"), F.lit(0)) for k in checks), F.lit(0))
    verdict = F.when(n == len(checks), "ship").when(n == 0, "hold").otherwise("partial")
    return measures.select(*flags).withColumn("n_passed", n).withColumn("decision", verdict)


# Dollars for a million tokens, in and out, by model.
PRICES: dict[str, tuple[float, float]] = {
    "claude-haiku-4-5": (0.80, 4.00),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-opus-4-7": (15.00, 75.00),
    "gemini-2.5-flash": (0.075, 0.30),
    "gemini-2.5-pro": (1.25, 5.00),
    "gpt-4o": (2.50, 10.00),
    "gpt-4o-mini": (0.15, 0.60),
}


def estimate_cost(counts: DataFrame, models: list[str] | None = None, calls: float = 5.0, tokens_in: int = 330, tokens_out: int = 70, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """Calls, tokens and dollars for each model from one row (n_stmts, n_evidences).

    A price of 0 given by the caller counts as not given; unknown models then cost 0.
    """
    names = models or list(PRICES)
    calls_ = F.bround(F.col("n_evidences") * F.lit(calls)).cast("long")
    rows = counts.select("*", F.explode(F.array(*map(F.lit, names))).alias("model_id"))
    price = [F.lit(given) if given else lookup(F.col("model_id"), {m: p[i] for m, p in PRICES.items()}, 0.0) for i, given in enumerate((price_in, price_out))]
    rows = rows.withColumn("n_llm_calls", calls_).withColumn("input_tokens", F.col("n_llm_calls") * tokens_in).withColumn("output_tokens", F.col("n_llm_calls") * tokens_out)
    usd = F.col("input_tokens") / 1e6 * price[0] + F.col("output_tokens") / 1e6 * price[1]
    return rows.withColumn("cost_usd", F.bround(usd, 4))


def actual_cost(logs: DataFrame, model: str, key: str = "run_id", calls: str = "call_log") -> DataFrame:
    """Token sums and dollars of each run from arrays of calls (prompt_tokens, out_tokens)."""
    total = lambda f: F.aggregate(F.coalesce(calls, F.array()), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[f], F.lit(0)).cast("long"))
    out = logs.groupBy(key).agg(F.sum(total("prompt_tokens")).alias("prompt_tokens"), F.sum(total("out_tokens")).alias("out_tokens"))
    a, b = PRICES.get(model, (0.0, 0.0))
    return out.withColumn("cost_usd", F.bround(F.col("prompt_tokens") / 1e6 * a + F.col("out_tokens") / 1e6 * b, 4))


def source_counts(evidence: DataFrame, key: str = "stmt_hash", source: str = "source_api") -> DataFrame:
    """A map of counts by source for each statement."""
    n = evidence.groupBy(key, source).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("source_counts"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: a congruence, the same in any SQL."""
    return F.pmod(key.cast("long") * 7919 + seed * 104_729, F.lit(1_000_003)) / 1_000_003


def balanced_sample(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each class, in a seeded order of their keys."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(uniform(F.col(key), seed), key))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def stratified_sample(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` rows, strata in proportion but each with one at least; the largest gives what is over."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    quota = F.greatest(F.lit(1), F.bround(F.col("c") * n / F.col("t"), 0).cast("long"))
    q = counts.crossJoin(F.broadcast(total)).withColumn("q", quota)  # one row
    over = q.agg((F.sum("q") - n).alias("over"), F.max_by(by, F.struct("q", by)).alias("largest"))
    q = q.crossJoin(F.broadcast(over)).withColumn("q", F.when((F.col(by) == F.col("largest")) & (F.col("over") > 0), F.greatest(F.lit(1), F.col("q") - F.col("over"))).otherwise(F.col("q")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(uniform(F.col(key), seed), key))
    return rows.withColumn("__r", rank).join(q.select(by, "q"), by).where(F.col("__r") <= F.col("q")).drop("__r", "q")


def greedy_strata(rows: DataFrame, by: str, key: str, each: int = 3, most: int = 12) -> DataFrame:
    """Up to ``each`` rows a type, larger types first, until there are ``most``; then the rest by key."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__c"))
    ranked = rows.join(sizes, by).withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(key)))
    return ranked.orderBy((F.col("__r") > each), F.desc("__c"), by, "__r").limit(most).drop("__c", "__r")


def simulate_verdicts(rows: DataFrame, by: str, key: str, label: str, rates: dict[str, float], default: float = 0.787, seed: int = 0) -> DataFrame:
    """A verdict for each row that is right with its type's accuracy, seeded by the key."""
    right = uniform(F.col(key), seed) < lookup(F.col(by), rates, default)
    verdict = F.when(right == (F.col(label) == 1), "correct").otherwise("incorrect")
    return rows.withColumn("verdict", verdict)


def complexity(rows: DataFrame, text: str, key: str, each: int) -> DataFrame:
    """Rows by size of their text, ``each`` a bucket."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    bucket = F.when((F.length(text) < 100) & (words < 15), "simple").when((F.length(text) < 250) & (words < 40), "medium").otherwise("complex")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(key))
    return rows.withColumn("bucket", bucket).withColumn("__r", rank).where(F.col("__r") <= each).drop("__r")


def field_match(rows: DataFrame, pairs: list[tuple[str, str]], sets: list[tuple[str, str]] = ()) -> DataFrame:
    """Share of rows whose fields agree, and whose arrays agree as sets."""
    same = [F.avg((F.col(a).eqNullSafe(F.col(b))).cast("double")).alias(a) for a, b in pairs]
    same += [F.avg((F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).cast("double")).alias(a) for a, b in sets]
    return rows.agg(*same)


def first_containing(assertions: Column, agents: Column, targets: Column) -> Column:
    """The first assertion (agents, targets) whose sets contain what is expected."""
    holds = lambda a: (F.size(F.array_except(agents, a["agents"])) == 0) & (F.size(F.array_except(targets, a["targets"])) == 0)
    return F.get(F.filter(assertions, holds), F.lit(0))


def extremes(rows: DataFrame, size: Column, key: str, longest: int = 3, middle: int = 2) -> DataFrame:
    """The longest rows and those at the middle of the order."""
    n = rows.count()
    top = rows.orderBy(size.desc(), key).limit(longest)
    mid = rows.orderBy(size, key).offset(max(0, n // 2 - middle // 2)).limit(middle)
    return top.withColumn("place", F.lit("longest")).unionByName(mid.withColumn("place", F.lit("middle")))


def noisy_log(values: list[float]) -> float:
    """The geometric mean of a list: an example of a caller's own aggregator."""
    return math.exp(sum(math.log(max(v, 1e-9)) for v in values) / len(values)) if values else 0.0
