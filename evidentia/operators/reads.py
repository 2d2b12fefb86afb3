"""Read queries over statements, evidence, agents, runs and scoring steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import confidence_weight, role_order, vote

TOP = 5


def latest_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The latest succeeded runs."""
    return runs.where("status = 'succeeded'").orderBy(F.desc("started_at"), "run_id").limit(n)


def predecessors(runs: DataFrame) -> DataFrame:
    """Each succeeded run and the succeeded one before it."""
    before = F.lag("run_id").over(Window.partitionBy("status").orderBy("started_at", "run_id"))
    return runs.where("status = 'succeeded'").withColumn("previous", before)


def run_scores(steps: DataFrame, run_id: str) -> DataFrame:
    """Mean score and largest verdict of each statement in a run."""
    return steps.where(F.col("run_id") == run_id).groupBy("stmt_hash").agg(F.avg("score").alias("our_score"), F.max("verdict").alias("verdict"))


def ordered_agents(agents: DataFrame) -> DataFrame:
    """Each statement's agents (role, name), subject first, then object, members, others."""
    rows = F.array_sort(F.collect_list(F.struct(role_order(F.col("role")).alias("o"), "role_index", "role", "name")))
    return agents.groupBy("stmt_hash").agg(F.transform(rows, lambda a: F.struct(a["role"].alias("role"), a["name"].alias("name"))).alias("agents"))


def matrix(statements: DataFrame, evidence: DataFrame, agents: DataFrame, steps: DataFrame, run_id: str, limit: int = 50_000) -> DataFrame:
    """A row a statement with its sources, agents, scores and their difference, largest first.

    Every side is aggregated before it is joined, so evidence and agents don't multiply.
    """
    ev = evidence.groupBy("stmt_hash").agg(F.count(F.lit(1)).alias("n_evidences"), F.array_join(F.array_sort(F.collect_set("source_api")), ", ").alias("sources"))
    ag = agents.groupBy("stmt_hash").agg(F.countDistinct("name").alias("n_agents"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    out = statements.join(ev, "stmt_hash", "left").join(ag, "stmt_hash", "left").join(run_scores(steps, run_id), "stmt_hash", "left")
    delta = F.col("our_score") - F.col("published_belief")
    out = out.select("stmt_hash", "stmt_type", "published_belief", "our_score", "verdict", delta.alias("delta"), F.coalesce("n_evidences", F.lit(0)).alias("n_evidences"), F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_agents", F.lit(0)).alias("n_agents"), F.coalesce("names", F.lit("")).alias("names"))
    return out.orderBy(F.desc(F.abs(F.coalesce("delta", F.lit(0.0)))), "stmt_hash").limit(limit)


def crossings(steps: DataFrame, current: str, previous: str) -> DataFrame:
    """Statements whose verdict differs between two runs."""
    a, b = (run_scores(steps, r).select("stmt_hash", F.col("verdict").alias(n)) for r, n in ((current, "verdict"), (previous, "was")))
    return a.join(b, "stmt_hash").where("verdict <> was")


def narrative(steps: DataFrame, statements: DataFrame, current: str, previous: str) -> DataFrame:
    """What changed from one run to the next: error, bias and crossings, in numbers and a sentence."""
    from .validity import calibration

    a, b = (calibration(steps.where(F.col("run_id") == r), statements).select(F.col("mae").alias(f"mae{i}"), F.col("bias").alias(f"bias{i}")) for i, r in enumerate((current, previous)))
    n = crossings(steps, current, previous).agg(F.count(F.lit(1)).alias("crossings"))
    row = a.crossJoin(b).crossJoin(n)  # one row each
    delta = F.col("mae0") - F.col("mae1")
    word = F.when(F.abs(delta) < 0.005, "held").when(delta < 0, "improved").otherwise("worsened")
    said = F.concat(F.lit("error "), word, F.lit("; "), F.col("crossings").cast("string"), F.when(F.col("crossings") == 1, " verdict changed").otherwise(" verdicts changed"))
    return row.select(delta.alias("mae_delta"), (F.col("bias0") - F.col("bias1")).alias("bias_delta"), "crossings", said.alias("summary"))


def final_sources(slots: DataFrame, answers: DataFrame) -> DataFrame:
    """How each probe of each evidence was answered in the end: rules before model before abstention."""
    joined = slots.join(answers.select("evidence_hash", "probe", F.col("source").alias("s"), F.col("answer").alias("a")), ["evidence_hash", "probe"], "left")
    end = F.when(F.col("substrate_source") == "substrate", "substrate").when(F.col("s") == "llm", "llm").when((F.col("s") == "abstain") | (F.col("a") == "abstain"), "abstain").when(F.col("s").isNotNull(), F.col("s"))
    return joined.select("evidence_hash", "probe", end.alias("final_source"))


def probe_coverage(final: DataFrame) -> DataFrame:
    """Counts of the ways of answering by probe."""
    is_ = lambda v: F.sum(F.when(F.col("final_source") == v, 1).otherwise(0))
    return final.groupBy("probe").agg(F.count(F.lit(1)).alias("total"), is_("substrate").alias("substrate_n"), is_("llm").alias("llm_n"), is_("abstain").alias("abstain_n"), F.sum(F.col("final_source").isNull().cast("long")).alias("notrun_n"))


def coverage_rates(final: DataFrame) -> DataFrame:
    """Share of evidences that rules answered in full, that were cut short, and probes run a piece."""
    is_ = lambda c: F.sum(c.cast("long"))
    s, m = F.coalesce(F.col("final_source") == "substrate", F.lit(False)), F.coalesce(F.col("final_source") == "llm", F.lit(False))
    per = final.groupBy("evidence_hash").agg(is_(s).alias("s"), is_(m).alias("m"), is_(F.col("final_source").isNull()).alias("none"))
    rate = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return per.agg(F.count(F.lit(1)).alias("n_evidences"), rate((F.col("none") == 0) & (F.col("m") == 0)).alias("all_substrate_rate"), rate(F.col("none") > 0).alias("short_circuited_rate"), F.coalesce(F.avg(F.col("s") + F.col("m")), F.lit(0.0)).alias("mean_invoked"))


def findings_base(statements: DataFrame, evidence: DataFrame, steps: DataFrame, run_id: str) -> DataFrame:
    counts = evidence.groupBy("stmt_hash").agg(F.count(F.lit(1)).alias("n_evidences"))
    return statements.join(run_scores(steps, run_id), "stmt_hash").join(counts, "stmt_hash", "left").withColumn("n_evidences", F.coalesce("n_evidences", F.lit(0)))


def biggest_disagreement(base: DataFrame, n: int = TOP) -> DataFrame:
    gap = F.abs(F.col("our_score") - F.col("published_belief"))
    return base.where("published_belief is not null and our_score is not null").withColumn("gap", gap).orderBy(F.desc("gap"), "stmt_hash").limit(n)


def low_confidence(base: DataFrame, n: int = TOP) -> DataFrame:
    """Undecided statements with much evidence."""
    undecided = F.round("our_score", 9).between(0.4, 0.6)  # a mean's last digits depend on the order of its sum
    return base.where(undecided & (F.col("n_evidences") >= 3)).orderBy(F.desc("n_evidences"), F.round(F.abs(F.col("our_score") - 0.5), 9), "stmt_hash").limit(n)


def probe_split(answers: DataFrame, n: int = TOP) -> DataFrame:
    """Statements whose probes disagree most: the spread of +1, 0 and -1 votes."""
    for_ = ((F.col("probe") == "subject_role") & (F.col("answer") == "present_as_subject")) | ((F.col("probe") == "object_role") & (F.col("answer") == "present_as_object")) | ((F.col("probe") == "relation_axis") & (F.col("answer") == "direct_sign_match")) | ((F.col("probe") == "scope") & (F.col("answer") == "asserted"))
    against = ((F.col("probe") == "scope") & (F.col("answer") == "negated")) | F.col("answer").isin("absent", "present_as_decoy", "direct_sign_mismatch", "direct_axis_mismatch", "no_relation")
    v = F.when(for_, 1.0).when(against, -1.0).otherwise(0.0)
    return answers.groupBy("stmt_hash").agg(F.stddev_pop(v).alias("probe_stdev")).where("probe_stdev > 0").orderBy(F.desc(F.round("probe_stdev", 9)), "stmt_hash").limit(n)


def moved(steps: DataFrame, current: str, previous: str, way: str = "down", n: int | None = TOP, first: int | None = None) -> DataFrame:
    """Statements that fell from correct to incorrect (``down``) or rose (``up``).

    ``first``: look at so many statements by hash only, a limit that some dashboards have.
    """
    was, now = ("correct", "incorrect") if way == "down" else ("incorrect", "correct")
    a, b = run_scores(steps, current), run_scores(steps, previous).select("stmt_hash", F.col("verdict").alias("was"))
    a = a.orderBy("stmt_hash").limit(first) if first else a
    out = a.join(b, "stmt_hash").where((F.col("was") == was) & (F.col("verdict") == now)).orderBy("stmt_hash")
    return out.limit(n) if n else out


def focus(statements: DataFrame, steps: DataFrame, run_id: str, stmt_hash=None) -> DataFrame:
    """The statement asked for, or else that with the largest difference from its published belief."""
    rows = statements.join(run_scores(steps, run_id), "stmt_hash").withColumn("gap", F.abs(F.col("our_score") - F.col("published_belief")))
    if stmt_hash is not None:
        return rows.where(F.col("stmt_hash") == stmt_hash)
    return rows.where("gap is not null").orderBy(F.desc("gap"), "stmt_hash").limit(1)


def longest_texts(evidence: DataFrame, n: int = 3) -> DataFrame:
    return evidence.orderBy(F.desc_nulls_last(F.length("text")), "evidence_hash").limit(n)


def attributions(probes: DataFrame, key: str = "stmt_hash") -> DataFrame:
    """Contribution of each probe output to its statement, its width, and whether it decides the sign."""
    c = F.when(F.col("source") == "abstain", F.lit(0.0)).otherwise(vote(F.col("probe"), F.col("answer")) * confidence_weight(F.col("confidence")))
    w = Window.partitionBy(key)
    rows = probes.withColumn("contribution", F.coalesce(c, F.lit(0.0))).withColumn("__sum", F.sum("contribution").over(w)).withColumn("__max", F.max(F.abs("contribution")).over(w))
    decisive = (F.abs("contribution") > 1e-6) & ((F.col("__sum") >= 0) != (F.col("__sum") - F.col("contribution") >= 0))
    width = F.when(F.col("__max") > 0, F.abs("contribution") / F.col("__max")).otherwise(0.0)
    return rows.withColumn("normalized_width", width).withColumn("decisive", decisive).drop("__sum", "__max")


def merged_outputs(answers: DataFrame, slots: DataFrame) -> DataFrame:
    """Probe outputs and, where there is none for an evidence's probe, the rules' slot."""
    own = answers.select("stmt_hash", "evidence_hash", "probe", "answer", "source", "confidence")
    rest = slots.where("substrate_source is not null").join(own, ["evidence_hash", "probe"], "left_anti")
    return own.unionByName(rest.select("stmt_hash", "evidence_hash", "probe", F.col("substrate_answer").alias("answer"), F.col("substrate_source").alias("source"), F.col("substrate_confidence").alias("confidence")))


def best_by_probe(outputs: DataFrame) -> DataFrame:
    """One output a statement and probe: highest confidence, rules before others, smallest evidence."""
    order = F.struct(confidence_weight(F.col("confidence")).alias("w"), (F.col("source") == "substrate").cast("int").alias("r"), (-F.col("evidence_hash")).alias("e"))
    return outputs.groupBy("stmt_hash", "probe").agg(F.max_by(F.struct("evidence_hash", "answer", "source", "confidence"), order).alias("b")).select("stmt_hash", "probe", "b.*")


def overview(statements: DataFrame, evidence: DataFrame, agents: DataFrame, truth: DataFrame, runs: DataFrame) -> DataFrame:
    """Row counts of the corpus."""
    parts = [("statement", statements), ("evidence", evidence), ("agent", agents), ("truth_label", truth), ("score_run", runs)]
    out = None
    for name, df in parts:
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def counts_by(df: DataFrame, column: str, n: int = 16) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def run_meta(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with how many statements and evidences they scored."""
    n = steps.groupBy("run_id").agg(F.countDistinct("stmt_hash").alias("n_stmts"), F.count(F.lit(1)).alias("n_evidences"))
    return runs.join(F.broadcast(n), "run_id", "left").select("run_id", "status", F.coalesce("n_stmts", F.lit(0)).alias("n_stmts"), F.coalesce("n_evidences", F.lit(0)).alias("n_evidences"))  # a row a run


def labels_of(labels: DataFrame, statements: DataFrame, evidence: DataFrame, agents: DataFrame) -> DataFrame:
    """Labels whose target, of any kind, is in the corpus: one semi-join a kind."""
    out = None
    for kind, df, key in (("statement", statements, "stmt_hash"), ("evidence", evidence, "evidence_hash"), ("agent", agents, "agent_hash")):
        part = labels.where(F.col("target_kind") == kind).join(df.select(F.col(key).alias("target_id")), "target_id", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def truth_coverage(labels: DataFrame, statements: DataFrame, evidence: DataFrame, agents: DataFrame) -> DataFrame:
    """Labels in the corpus by truth set."""
    return labels_of(labels, statements, evidence, agents).groupBy("truth_set_id").agg(F.count(F.lit(1)).alias("n"))


def last_run_of(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest run that touched each statement."""
    touched = steps.select("stmt_hash", "run_id").distinct().join(F.broadcast(runs.select("run_id", "started_at")), "run_id")  # a row a run
    return touched.groupBy("stmt_hash").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def ingested(keys: DataFrame, stored: DataFrame, key: str, stored_key: str) -> DataFrame:
    """How many of a file's keys are stored already."""
    known = stored.select(F.col(stored_key).alias(key)).distinct().withColumn("__in", F.lit(1))
    return keys.select(key).distinct().join(known, key, "left").agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("__in"), F.lit(0)).alias("n_stored"))
