"""The registered queries, one an operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belief, contamination, evaluate, reads, validity
from .bindings import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a view getter as a query, with its SQL over ``{view}`` marks."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show, and counts as longs."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c) for c in df.columns])


def _of(run: str, v) -> DataFrame:
    return v("step").where(F.col("run_id") == run)


_PRIOR = "CASE lower(source_api) " + " ".join(f"WHEN '{s}' THEN CAST({{{i}}} AS DOUBLE)".replace("{0}", str(p[0])).replace("{1}", str(p[1])) for i in (0,) for s, p in belief.PRIORS.items()) + " ELSE 0.3 END"
_SYST = "CASE lower(source_api) " + " ".join(f"WHEN '{s}' THEN CAST({p[1]} AS DOUBLE)" for s, p in belief.PRIORS.items()) + " ELSE 0.1 END"
_ERR = lambda n: f"(CAST({_SYST} AS DOUBLE) + pow(CAST({_PRIOR} AS DOUBLE), {n}))"
_GATED = f"""per AS (SELECT stmt_hash, lower(source_api) AS source_api, count(*) AS total, sum(CASE WHEN flag_a <> 'R' THEN 1 ELSE 0 END) AS alive FROM {{evidence}} GROUP BY 1, 2)"""


@query(f"""WITH {_GATED} SELECT stmt_hash, round(greatest(0, least(1, 1 - product(CASE WHEN alive = 0 THEN 1.0 ELSE {_ERR('alive')} END))), 6) AS belief,
  round(greatest(0, least(1, 1 - product({_ERR('total')}))), 6) AS parametric_only, CAST(sum(total) AS BIGINT) AS n_total, CAST(sum(alive) AS BIGINT) AS n_surviving,
  CAST(sum(total - alive) AS BIGINT) AS n_gated FROM per GROUP BY 1""")
def gated_belief(v):
    e = v("evidence").withColumn("included", F.when(F.col("flag_a") != "R", " TRUE ").otherwise("false"))
    return rounded(belief.gated(e, ["stmt_hash"]).drop("per_source"))


@query(f"""WITH c AS (SELECT stmt_hash, source_api, count(*) AS n FROM {{evidence}} GROUP BY 1, 2)
  SELECT stmt_hash, round(greatest(0, least(1, 1 - product({_ERR('n')}))), 6) AS belief FROM c GROUP BY 1""")
def parametric_belief_counts(v):
    return rounded(belief.from_counts(v("evidence").groupBy("stmt_hash", "source_api").agg(F.count(F.lit(1)).alias("n")), ["stmt_hash"]))


@query(f"""WITH s AS (SELECT stmt_hash, lower(source_api) AS source_api, count(*) AS n FROM {{evidence}} GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY stmt_hash ORDER BY source_api) AS i, count(*) OVER (PARTITION BY stmt_hash) AS k, CAST(sum(n) OVER (PARTITION BY stmt_hash) AS BIGINT) AS total FROM s),
  u AS (SELECT *, CASE WHEN i = 1 THEN 1 + total - k ELSE 1 END AS m FROM t)
  SELECT stmt_hash, round(greatest(0, least(1, 1 - product({_ERR('m')}))), 6) AS belief FROM u GROUP BY 1""")
def parametric_belief_list(v):
    rows = v("evidence").groupBy("stmt_hash").agg(F.collect_list(F.lower("source_api")).alias("sources"), F.count(F.lit(1)).alias("evidence_count"))
    return rounded(belief.from_list(rows, ["stmt_hash"]))


@query(f"""WITH d AS (SELECT stmt_hash, coalesce(regulation_type, 'unknown') AS d, lower(source_api) AS source_api, min(position) AS p, count(*) AS total, sum(CASE WHEN flag_a <> 'R' THEN 1 ELSE 0 END) AS alive FROM {{evidence}} GROUP BY 1, 2, 3),
  b AS (SELECT stmt_hash, d, min(p) AS p, greatest(0, least(1, 1 - product(CASE WHEN alive = 0 THEN 1.0 ELSE {_ERR('alive')} END))) AS belief, CAST(sum(total) AS BIGINT) AS n_total, CAST(sum(alive) AS BIGINT) AS n_surviving FROM d GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY stmt_hash ORDER BY belief DESC, p) AS i FROM b),
  o AS (SELECT stmt_hash, max(belief) AS worst FROM r WHERE i > 1 AND d <> 'unknown' GROUP BY 1), s AS (SELECT stmt_hash, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(sum(n_surviving) AS BIGINT) AS n_surviving FROM b GROUP BY 1)
  SELECT r.stmt_hash, round(r.belief * (1 - coalesce(o.worst, 0)), 9) AS belief, r.d AS dominant, o.worst IS NOT NULL AS is_contradictory, s.n_total, s.n_surviving
  FROM r JOIN s ON r.stmt_hash = s.stmt_hash LEFT JOIN o ON o.stmt_hash = r.stmt_hash WHERE r.i = 1""")
def contradiction_belief(v):
    e = v("evidence").withColumn("included", F.col("flag_a") != "R")
    return rounded(belief.contradicted(e, ["stmt_hash"]).select("stmt_hash", "belief", "dominant", "is_contradictory", "n_total", "n_surviving"), 9)


@query("""SELECT evidence_hash, run_id, CASE WHEN verdict = 'correct' THEN TRUE WHEN verdict IS NULL OR verdict = 'abstain' THEN TRUE ELSE FALSE END AS kept,
  CASE WHEN verdict = 'correct' THEN TRUE ELSE FALSE END AS kept_strict FROM {step}""")
def hard_gate_flags(v):
    return v("step").select("evidence_hash", "run_id", belief.kept(F.col("verdict")).alias("kept"), belief.kept(F.initcap("verdict"), True).alias("kept_strict"))


@query(f"""WITH j AS (SELECT e.stmt_hash, lower(e.source_api) AS source_api, s.verdict FROM {{evidence}} e JOIN {{step}} s ON s.evidence_hash = e.evidence_hash AND s.run_id = 'run2'),
  per AS (SELECT stmt_hash, source_api, count(*) AS total, sum(CASE WHEN verdict = 'incorrect' THEN 0 ELSE 1 END) AS alive, max(verdict IS NOT NULL) AS h FROM j GROUP BY 1, 2)
  SELECT stmt_hash, round(greatest(0, least(1, 1 - product(CASE WHEN alive = 0 THEN 1.0 ELSE {_ERR('alive')} END))), 6) AS belief, max(h) AS has_scores FROM per GROUP BY 1""")
def edge_score(v):
    rows = v("evidence").select("evidence_hash", "source_api").join(_of("run2", v), "evidence_hash")
    return rounded(belief.edge_score(rows, ["stmt_hash"]).select("stmt_hash", "belief", "has_scores"))


@query("SELECT stmt_hash, round(avg(score), 6) AS belief, count(*) AS n FROM {step} WHERE run_id = 'run1' AND score IS NOT NULL GROUP BY 1")
def mean_belief(v):
    return rounded(belief.aggregate(_of("run1", v), "mean"))


@query("SELECT stmt_hash, round(1 - product(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 - score AS DOUBLE)))), 6) AS belief, count(*) AS n FROM {step} WHERE run_id = 'run1' AND score IS NOT NULL GROUP BY 1")
def noisy_or_belief(v):
    return rounded(belief.aggregate(_of("run1", v), "noisy_or"))


@query("SELECT stmt_hash, round(exp(avg(ln(greatest(score, 1e-9)))), 6) AS belief, count(*) AS n FROM {step} WHERE run_id = 'run1' AND score IS NOT NULL GROUP BY 1")
def caller_aggregate(v):
    return rounded(belief.aggregate(_of("run1", v), evaluate.noisy_log))


@query("SELECT coalesce(verdict, 'unknown') AS verdict, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {step} WHERE run_id = 'run2'), 6) AS share FROM {step} WHERE run_id = 'run2' GROUP BY 1")
def verdict_share(v):
    return rounded(validity.verdict_shares(_of("run2", v)))


_S = "s AS (SELECT stmt_hash, avg(score) AS our, count(*) AS n_ev FROM {step} WHERE run_id = 'run1' AND score IS NOT NULL GROUP BY 1), g AS (SELECT t.*, s.our, s.n_ev, s.our - t.published_belief AS gap FROM s JOIN {statement} t ON t.stmt_hash = s.stmt_hash)"


@query(f"WITH {_S} SELECT count(*) AS n, round(avg(abs(gap)), 6) AS mae, round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(gap), 6) AS bias FROM g")
def calibration_mae_rmse_bias(v):
    return rounded(validity.calibration(_of("run1", v), v("statement")))


@query("WITH d AS (SELECT stmt_hash, stddev_pop(score) AS s FROM {step} WHERE run_id = 'run1' AND score IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT round(avg(s), 6) AS mean_stdev, round(max(s), 6) AS max_stdev, count(*) AS n_statements FROM d")
def evidence_dispersion(v):
    return rounded(validity.dispersion(_of("run1", v)))


@query(f"WITH {_S} SELECT stmt_type, count(*) AS n, round(avg(abs(gap)), 6) AS mae, round(avg(gap), 6) AS bias FROM g GROUP BY 1 HAVING count(*) >= 2")
def stratified_calibration_type(v):
    return rounded(validity.stratified(_of("run1", v), v("statement")))


@query(f"WITH {_S}, m AS (SELECT stmt_hash, min(source_api) AS source_api FROM {{evidence}} GROUP BY 1) SELECT m.source_api, count(*) AS n, round(avg(abs(gap)), 6) AS mae, round(avg(gap), 6) AS bias FROM g JOIN m ON m.stmt_hash = g.stmt_hash GROUP BY 1 HAVING count(*) >= 2")
def stratified_calibration_source(v):
    return rounded(validity.stratified(_of("run1", v), v("statement"), v("evidence"), "source_api"))


@query("""WITH c AS (SELECT truth_set_id, sum(CASE WHEN p.verdict = 'correct' AND gold = 'correct' THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p.verdict = 'correct' AND gold <> 'correct' THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN p.verdict <> 'correct' AND gold = 'correct' THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p.verdict <> 'correct' AND gold <> 'correct' THEN 1 ELSE 0 END) AS tn FROM {predicted} p JOIN {truth} t ON t.target_id = p.target_id GROUP BY 1),
  q AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS r FROM c)
  SELECT truth_set_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q""")
def truth_prf1(v):
    return rounded(validity.agreement(v("predicted"), v("truth"), "target_id"))


@query(f"""WITH {_S} SELECT round(avg(CASE WHEN supports_count + supported_by_count > 0 THEN our END), 6) AS mean_with, round(avg(CASE WHEN supports_count + supported_by_count = 0 THEN our END), 6) AS mean_without,
  CAST(sum(CASE WHEN supports_count + supported_by_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with, CAST(sum(CASE WHEN supports_count + supported_by_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_without,
  round(avg(CASE WHEN supports_count + supported_by_count > 0 THEN our END) - avg(CASE WHEN supports_count + supported_by_count = 0 THEN our END), 6) AS delta FROM g""")
def supports_delta(v):
    return rounded(validity.support_effect(_of("run1", v), v("statement")))


@query(f"WITH {_S}, b AS (SELECT CAST(least(floor((greatest(-1, least(1, gap)) + 1) * 5.5), 10) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY 1), a AS (SELECT CAST(range AS BIGINT) AS bin FROM range(11)) SELECT a.bin, coalesce(n, 0) AS n FROM a LEFT JOIN b ON a.bin = b.bin")
def residual_histogram(v):
    return rounded(validity.residual_histogram(_of("run1", v), v("statement")))


_M = "m AS (SELECT stmt_hash, avg(score) AS our, max(verdict) AS verdict FROM {step} WHERE run_id = 'run2' GROUP BY 1)"
_EV = "ev AS (SELECT stmt_hash, count(*) AS n_evidences, string_agg(DISTINCT source_api, ', ' ORDER BY source_api) AS sources FROM {evidence} GROUP BY 1)"


@query(f"""WITH {_M}, {_EV}, ag AS (SELECT stmt_hash, count(DISTINCT name) AS n_agents, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM {{agent}} GROUP BY 1)
  SELECT t.stmt_hash, stmt_type, published_belief, round(our, 6) AS our_score, verdict, round(our - published_belief, 6) AS delta, coalesce(n_evidences, 0) AS n_evidences, coalesce(sources, '') AS sources, coalesce(n_agents, 0) AS n_agents, coalesce(names, '') AS names
  FROM {{statement}} t LEFT JOIN ev ON ev.stmt_hash = t.stmt_hash LEFT JOIN ag ON ag.stmt_hash = t.stmt_hash LEFT JOIN m ON m.stmt_hash = t.stmt_hash
  ORDER BY abs(coalesce(our - published_belief, 0)) DESC, t.stmt_hash LIMIT 50000""")
def statement_matrix(v):
    return rounded(reads.matrix(v("statement"), v("evidence"), v("agent"), v("step"), "run2"))


@query("SELECT stmt_hash, string_agg(concat(role, ':', name), ' ' ORDER BY CASE role WHEN 'subj' THEN 0 WHEN 'obj' THEN 1 WHEN 'member' THEN 2 ELSE 3 END, role_index, role, name) AS agents FROM {agent} GROUP BY 1")
def ordered_agents(v):
    return reads.ordered_agents(v("agent")).select("stmt_hash", F.array_join(F.transform("agents", lambda a: F.concat(a["role"], F.lit(":"), a["name"])), " ").alias("agents"))


@query("SELECT run_id, CAST(started_at AS BIGINT) AS started_at, status FROM {run} WHERE status = 'succeeded' ORDER BY started_at DESC LIMIT 2")
def latest_run(v):
    return rounded(reads.latest_runs(v("run"), 2))


@query("SELECT run_id, lag(run_id) OVER (ORDER BY started_at) AS previous FROM {run} WHERE status = 'succeeded'")
def predecessor_run(v):
    return reads.predecessors(v("run")).select("run_id", "previous")


_X = "x1 AS (SELECT stmt_hash, max(verdict) AS verdict FROM {step} WHERE run_id = 'run2' GROUP BY 1), x2 AS (SELECT stmt_hash, max(verdict) AS was FROM {step} WHERE run_id = 'run1' GROUP BY 1), x AS (SELECT x1.*, was FROM x1 JOIN x2 ON x1.stmt_hash = x2.stmt_hash)"


@query(f"WITH {_X} SELECT * FROM x WHERE verdict <> was")
def verdict_crossings(v):
    return reads.crossings(v("step"), "run2", "run1")


@query(f"""WITH {_X}, c AS (SELECT run_id, avg(abs(our - published_belief)) AS mae, avg(our - published_belief) AS bias FROM (SELECT run_id, stmt_hash, avg(score) AS our FROM {{step}} WHERE score IS NOT NULL GROUP BY 1, 2) s JOIN {{statement}} t ON t.stmt_hash = s.stmt_hash GROUP BY 1),
  d AS (SELECT max(CASE WHEN run_id = 'run2' THEN mae END) - max(CASE WHEN run_id = 'run1' THEN mae END) AS m, max(CASE WHEN run_id = 'run2' THEN bias END) - max(CASE WHEN run_id = 'run1' THEN bias END) AS b FROM c), n AS (SELECT count(*) AS k FROM x WHERE verdict <> was)
  SELECT round(m, 6) AS mae_delta, round(b, 6) AS bias_delta, k AS crossings, concat('error ', CASE WHEN abs(m) < 0.005 THEN 'held' WHEN m < 0 THEN 'improved' ELSE 'worsened' END, '; ', CAST(k AS VARCHAR), CASE WHEN k = 1 THEN ' verdict changed' ELSE ' verdicts changed' END) AS summary FROM d, n""")
def run_narrative(v):
    return rounded(reads.narrative(v("step"), v("statement"), "run2", "run1"))


_F = """f AS (SELECT s.evidence_hash, s.probe, CASE WHEN s.substrate_source = 'substrate' THEN 'substrate' WHEN a.source = 'llm' THEN 'llm' WHEN a.source = 'abstain' OR a.answer = 'abstain' THEN 'abstain' ELSE a.source END AS fs
  FROM {slot} s LEFT JOIN {answer} a ON a.evidence_hash = s.evidence_hash AND a.probe = s.probe)"""
_N = lambda c, a: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {a}"


@query(f"WITH {_F} SELECT probe, count(*) AS total, " + ", ".join(_N(f"fs = '{k}'", f"{k}_n") for k in ("substrate", "llm", "abstain")) + ", " + _N("fs IS NULL", "notrun_n") + " FROM f GROUP BY 1")
def probe_coverage(v):
    return reads.probe_coverage(reads.final_sources(v("slot"), v("answer")))


@query(f"""WITH {_F}, p AS (SELECT evidence_hash, {_N("fs = 'substrate'", 's')}, {_N("fs = 'llm'", 'm')}, {_N('fs IS NULL', 'z')} FROM f GROUP BY 1)
  SELECT count(*) AS n_evidences, round(avg(CASE WHEN z = 0 AND m = 0 THEN 1.0 ELSE 0.0 END), 6) AS all_substrate_rate, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS short_circuited_rate, round(avg(s + m), 6) AS mean_invoked FROM p""")
def coverage_rates(v):
    return rounded(reads.coverage_rates(reads.final_sources(v("slot"), v("answer"))))


@query("""WITH a AS (SELECT stmt_hash, CASE WHEN answer IN ('present_as_subject') AND probe = 'subject_role' OR answer = 'present_as_object' AND probe = 'object_role' OR answer = 'direct_sign_match' AND probe = 'relation_axis' OR answer = 'asserted' AND probe = 'scope' THEN 1.0
  WHEN answer = 'negated' AND probe = 'scope' OR answer IN ('absent', 'present_as_decoy', 'direct_sign_mismatch', 'direct_axis_mismatch', 'no_relation') THEN -1.0 ELSE 0.0 END AS vote FROM {answer})
  SELECT stmt_hash, round(s, 6) AS probe_stdev FROM (SELECT stmt_hash, stddev_pop(CAST(vote AS DOUBLE)) AS s FROM a GROUP BY 1) WHERE s > 0 ORDER BY round(s, 9) DESC, stmt_hash LIMIT 5""")
def probe_split_topk(v):
    return rounded(reads.probe_split(v("answer")))


_B = f"{_M}, {_EV}, b AS (SELECT t.stmt_hash, stmt_type, published_belief, our AS our_score, verdict, coalesce(n_evidences, 0) AS n_evidences FROM {{statement}} t JOIN m ON m.stmt_hash = t.stmt_hash LEFT JOIN ev ON ev.stmt_hash = t.stmt_hash)"


@query(f"WITH {_B} SELECT stmt_hash, stmt_type, published_belief, round(our_score, 6) AS our_score, round(abs(our_score - published_belief), 6) AS gap FROM b WHERE our_score IS NOT NULL ORDER BY abs(our_score - published_belief) DESC, stmt_hash LIMIT 5")
def biggest_disagreement(v):
    base = reads.findings_base(v("statement"), v("evidence"), v("step"), "run2")
    return rounded(reads.biggest_disagreement(base).select("stmt_hash", "stmt_type", "published_belief", "our_score", "gap"))


@query(f"WITH {_B} SELECT stmt_hash, round(our_score, 6) AS our_score, n_evidences FROM b WHERE round(our_score, 9) BETWEEN 0.4 AND 0.6 AND n_evidences >= 3 ORDER BY n_evidences DESC, round(abs(our_score - 0.5), 9), stmt_hash LIMIT 5")
def low_conf_high_stakes(v):
    base = reads.findings_base(v("statement"), v("evidence"), v("step"), "run2")
    return rounded(reads.low_confidence(base).select("stmt_hash", "our_score", "n_evidences"))


@query(f"WITH {_X} SELECT stmt_hash FROM x WHERE was = 'incorrect' AND verdict = 'correct' ORDER BY stmt_hash LIMIT 5")
def verdict_recoveries(v):
    return reads.moved(v("step"), "run2", "run1", "up").select("stmt_hash")


@query(f"WITH {_X} SELECT stmt_hash FROM x WHERE was = 'correct' AND verdict = 'incorrect' ORDER BY stmt_hash")
def verdict_regressions(v):
    return reads.moved(v("step"), "run2", "run1", "down", n=None).select("stmt_hash")


@query(f"WITH {_M} SELECT t.stmt_hash, stmt_type, round(abs(our - published_belief), 6) AS gap FROM {{statement}} t JOIN m ON m.stmt_hash = t.stmt_hash WHERE our IS NOT NULL ORDER BY abs(our - published_belief) DESC, t.stmt_hash LIMIT 1")
def focus_statement(v):
    return rounded(reads.focus(v("statement"), v("step"), "run2").select("stmt_hash", "stmt_type", "gap"))


_W = """c AS (SELECT *, CASE WHEN source = 'abstain' THEN 0 ELSE CASE answer WHEN 'present_as_subject' THEN CASE probe WHEN 'subject_role' THEN 1.0 ELSE -1.0 END WHEN 'present_as_object' THEN 1.0 WHEN 'absent' THEN -1.0 WHEN 'direct_sign_match' THEN 1.0
  WHEN 'direct_axis_mismatch' THEN -0.7 WHEN 'asserted' THEN 1.0 WHEN 'negated' THEN -1.0 ELSE 0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END END AS w FROM {answer}), k AS (SELECT *, CAST(w AS DOUBLE) AS contribution FROM c)"""


@query(f"""WITH {_W}, s AS (SELECT *, sum(contribution) OVER (PARTITION BY stmt_hash) AS t, max(abs(contribution)) OVER (PARTITION BY stmt_hash) AS x FROM k)
  SELECT stmt_hash, probe, evidence_hash, round(contribution, 6) AS contribution, round(CASE WHEN x > 0 THEN abs(contribution) / x ELSE 0 END, 6) AS normalized_width FROM s""")
def probe_attribution(v):
    return rounded(reads.attributions(v("answer")).select("stmt_hash", "probe", "evidence_hash", "contribution", "normalized_width"))


@query("""WITH o AS (SELECT stmt_hash, evidence_hash, probe, answer, source, confidence FROM {answer} UNION ALL SELECT s.stmt_hash, s.evidence_hash, s.probe, substrate_answer, substrate_source, substrate_confidence FROM {slot} s
  WHERE substrate_source IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {answer} a WHERE a.evidence_hash = s.evidence_hash AND a.probe = s.probe)),
  r AS (SELECT *, row_number() OVER (PARTITION BY stmt_hash, probe ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, CASE source WHEN 'substrate' THEN 0 ELSE 1 END, evidence_hash) AS i FROM o)
  SELECT stmt_hash, probe, evidence_hash, answer, source, confidence FROM r WHERE i = 1""")
def best_probe_summary(v):
    return reads.best_by_probe(reads.merged_outputs(v("answer"), v("slot")))


@query("""SELECT truth_set_id, count(*) AS n FROM {target_label} l WHERE target_kind = 'statement' AND target_id IN (SELECT stmt_hash FROM {statement}) OR target_kind = 'evidence' AND target_id IN (SELECT evidence_hash FROM {evidence})
  OR target_kind = 'agent' AND target_id IN (SELECT agent_hash FROM {agent}) GROUP BY 1""")
def truth_set_coverage(v):
    return reads.truth_coverage(v("target_label"), v("statement"), v("evidence"), v("agent"))


@query("SELECT 'statement' AS table_name, count(*) AS n FROM {statement} UNION ALL SELECT 'evidence', count(*) FROM {evidence} UNION ALL SELECT 'agent', count(*) FROM {agent} UNION ALL SELECT 'truth_label', count(*) FROM {truth} UNION ALL SELECT 'score_run', count(*) FROM {run}")
def overview_counts(v):
    return reads.overview(v("statement"), v("evidence"), v("agent"), v("truth"), v("run"))


@query("SELECT stmt_type, count(*) AS n FROM {statement} GROUP BY 1 ORDER BY n DESC, stmt_type LIMIT 16")
def counts_by_type(v):
    return reads.counts_by(v("statement"), "stmt_type")


@query("SELECT r.run_id, r.status, coalesce(count(DISTINCT s.stmt_hash), 0) AS n_stmts, count(s.evidence_hash) AS n_evidences FROM {run} r LEFT JOIN {step} s ON s.run_id = r.run_id GROUP BY 1, 2")
def run_meta(v):
    return reads.run_meta(v("run"), v("step"))


@query("SELECT stmt_hash, max(run_id) AS run_id FROM {step} GROUP BY 1")
def latest_run_of_statement(v):
    return reads.last_run_of(v("step"), v("run"))


@query("SELECT count(DISTINCT l_orderkey * 2) AS n_keys, count(DISTINCT CASE WHEN l_orderkey * 2 IN (SELECT o_orderkey FROM {orders}) THEN l_orderkey * 2 END) AS n_stored FROM {lineitem}")
def ingest_status_semi(v):
    return reads.ingested(v("lineitem").select((F.col("l_orderkey") * 2).alias("key")), v("orders"), "key", "o_orderkey")


@query("""WITH s AS (SELECT score, sum(label) AS tp, count(*) AS n FROM {scored} GROUP BY 1), r AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT round(sum(CAST(tp AS DOUBLE) * ctp / cn) / sum(tp), 6) AS auprc FROM r""")
def auprc(v):
    return rounded(evaluate.average_precision(v("scored")))


@query("SELECT round(avg((score - label) * (score - label)), 6) AS brier, count(*) AS n FROM {scored}")
def brier(v):
    return rounded(evaluate.brier(v("scored")))


@query("WITH c AS (SELECT floor(score * 10) AS b, count(*) AS n, avg(score) AS s, avg(label) AS y FROM {scored} WHERE score < 1 GROUP BY 1) SELECT round(sum(n * abs(s - y)) / (SELECT count(*) FROM {scored}), 6) AS ece FROM c")
def ece(v):
    return rounded(evaluate.calibration_error(v("scored")))


@query("""WITH f AS (SELECT 'overall' AS facet, 'all' AS value, label, kept FROM {scored} UNION ALL SELECT 'source_api', source_api, label, kept FROM {scored} UNION ALL SELECT 'tag', tag, label, kept FROM {scored})
  SELECT facet, value, CAST(sum(label) AS BIGINT) AS n_true, CAST(sum(1 - label) AS BIGINT) AS n_false, round(coalesce(CAST(sum(CASE WHEN label = 1 AND NOT kept THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(label), 0), 0), 6) AS false_gate_rate,
  round(coalesce(CAST(sum(CASE WHEN label = 0 AND kept THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(1 - label), 0), 0), 6) AS false_pass_rate FROM f GROUP BY 1, 2""")
def false_gate_rates(v):
    return rounded(evaluate.gate_rates(v("scored"), ["source_api", "tag"]))


@query("SELECT old AS verdict, " + ", ".join(f"CAST(sum(CASE WHEN new = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in ("correct", "incorrect", "abstain")) + " FROM {judged} GROUP BY 1")
def flip_table(v):
    return evaluate.flip_table(v("judged"), "old", "new", ["correct", "incorrect", "abstain"])


@query("SELECT source_api, round(avg(CASE WHEN new <> 'abstain' THEN CASE WHEN new = gold THEN 1.0 ELSE 0.0 END END), 6) AS accuracy, CAST(sum(CASE WHEN new <> 'abstain' THEN 1 ELSE 0 END) AS BIGINT) AS n_decided, CAST(sum(CASE WHEN new = 'abstain' THEN 1 ELSE 0 END) AS BIGINT) AS n_undecided FROM {judged} GROUP BY 1")
def decided_accuracy(v):
    return rounded(evaluate.accuracy(v("judged"), "new", "gold", ["source_api"]))


@query("SELECT CASE WHEN old = gold AND new = gold THEN 'both_right' WHEN old = gold THEN 'regression' WHEN new = gold THEN 'gain' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM {judged} GROUP BY 1")
def outcome_classes(v):
    return evaluate.outcome_classes(v("judged"), "old", "new", "gold")


@query("SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.99), 6) AS p99 FROM {events} GROUP BY 1")
def latency_percentiles(v):
    return rounded(evaluate.latency(v("events"), "value", ["event_type"]).drop("index_p99"))


@query("SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS reason FROM {benchmark}) GROUP BY 1")
def reason_histogram(v):
    return evaluate.reasons(v("benchmark").select(F.split(F.lower("text"), " ", -1).alias("reasons")))


@query("""WITH m AS (SELECT avg(CASE WHEN new <> 'abstain' THEN CASE WHEN new = gold THEN 1.0 ELSE 0.0 END END) AS a, avg(CASE WHEN new = 'abstain' THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM {judged})
  SELECT a >= 0.45 AS accurate, s <= 0.3 AS decided, n >= 100 AS enough, CAST(CASE WHEN a >= 0.45 THEN 1 ELSE 0 END + CASE WHEN s <= 0.3 THEN 1 ELSE 0 END + CASE WHEN n >= 100 THEN 1 ELSE 0 END AS BIGINT) AS n_passed,
  CASE CASE WHEN a >= 0.45 THEN 1 ELSE 0 END + CASE WHEN s <= 0.3 THEN 1 ELSE 0 END + CASE WHEN n >= 100 THEN 1 ELSE 0 END WHEN 3 THEN 'ship' WHEN 0 THEN 'hold' ELSE 'partial' END AS decision FROM m""")
def ship_gates(v):
    j = v("judged")
    m = evaluate.accuracy(j, "new", "gold").withColumn("share", F.col("n_undecided") / (F.col("n_decided") + F.col("n_undecided")))
    return rounded(evaluate.gates(m, {"accurate": F.col("accuracy") >= 0.45, "decided": F.col("share") <= 0.3, "enough": F.col("n_decided") + F.col("n_undecided") >= 100}))


_U = "(id * 7919 + 42 * 104729) % 1000003"


@query(f"SELECT id, label FROM (SELECT id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY {_U}, id) AS r FROM {{scored}}) WHERE r <= 100")
def balanced_sample(v):
    return rounded(evaluate.balanced_sample(v("scored"), "label", "id", 100, 42).select("id", "label"))


@query(f"""WITH c AS (SELECT source_api, count(*) AS c FROM {{scored}} GROUP BY 1), q AS (SELECT *, greatest(1, CAST(round_even(CAST(c AS DOUBLE) * 200 / (SELECT sum(c) FROM c), 0) AS BIGINT)) AS q FROM c),
  o AS (SELECT sum(q) - 200 AS o FROM q), g AS (SELECT source_api AS l FROM q ORDER BY q DESC, source_api DESC LIMIT 1), z AS (SELECT source_api, CASE WHEN source_api = l AND o > 0 THEN greatest(1, q - o) ELSE q END AS q FROM q, o, g)
  SELECT s.id, s.source_api FROM (SELECT id, source_api, row_number() OVER (PARTITION BY source_api ORDER BY {_U}, id) AS r FROM {{scored}}) s JOIN z ON z.source_api = s.source_api WHERE r <= z.q""")
def stratified_sample(v):
    return evaluate.stratified_sample(v("scored"), "source_api", "id", 200, 42).select("id", "source_api")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_api ORDER BY id) AS r, count(*) OVER (PARTITION BY source_api) AS c FROM {scored}) SELECT id, source_api FROM r ORDER BY r > 3, c DESC, source_api, r LIMIT 12""")
def greedy_strata(v):
    return evaluate.greedy_strata(v("scored"), "source_api", "id").select("id", "source_api")


@query(f"SELECT id, CASE WHEN (CAST({_U} AS DOUBLE) / 1000003 < CASE tag WHEN 'grounding' THEN 0.6 WHEN 'polarity' THEN 0.7 ELSE 0.787 END) = (label = 1) THEN 'correct' ELSE 'incorrect' END AS verdict FROM {{scored}}")
def simulated_verdicts(v):
    return evaluate.simulate_verdicts(v("scored"), "tag", "id", "label", {"grounding": 0.6, "polarity": 0.7}, seed=42).select("id", "verdict")


@query("""WITH c AS (SELECT count(*) AS n_stmts FROM {statement}), e AS (SELECT count(*) AS n_evidences FROM {evidence}), p AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}', {a}, {b})" for m, (a, b) in evaluate.PRICES.items()) + """) AS t(model_id, a, b))
  SELECT model_id, n_stmts, n_evidences, n_evidences * 5 AS n_llm_calls, n_evidences * 5 * 330 AS input_tokens, n_evidences * 5 * 70 AS output_tokens, round(n_evidences * 5 * 330 / 1e6 * CAST(a AS DOUBLE) + n_evidences * 5 * 70 / 1e6 * CAST(b AS DOUBLE), 3) AS cost_usd FROM c, e, p""")
def cost_estimate(v):
    counts = v("statement").agg(F.count(F.lit(1)).alias("n_stmts")).crossJoin(v("evidence").agg(F.count(F.lit(1)).alias("n_evidences")))  # a row each
    return rounded(evaluate.estimate_cost(counts), 3)


@query("SELECT conv_id AS run_id, CAST(sum(CASE role WHEN 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS out_tokens, round(sum(CASE role WHEN 'user' THEN length(text) ELSE 0 END) / 1e6 * 3 + sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END) / 1e6 * 15, 4) AS cost_usd FROM {conversations} GROUP BY 1")
def cost_actual(v):
    n = lambda role: F.when(F.col("role") == role, F.length("text")).otherwise(0)
    logs = v("conversations").select(F.col("conv_id").alias("run_id"), F.array(F.struct(n("user").alias("prompt_tokens"), n("assistant").alias("out_tokens"))).alias("call_log"))
    return rounded(evaluate.actual_cost(logs, "claude-sonnet-4-6"), 4)


@query("SELECT stmt_hash, string_agg(concat(source_api, '=', CAST(n AS VARCHAR)), ' ' ORDER BY source_api) AS counts FROM (SELECT stmt_hash, source_api, count(*) AS n FROM {evidence} GROUP BY 1, 2) GROUP BY 1")
def source_counts_map(v):
    return evaluate.source_counts(v("evidence")).select("stmt_hash", F.array_join(F.transform(F.map_entries("source_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias("counts"))


_NORM = lambda c: f"lower(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '[.,;:!? ]+$', ''))"
_PAIR = f"n AS (SELECT example_id, {_NORM('text')} AS t FROM {{example}}), m AS (SELECT eval_id, {_NORM('text')} AS u FROM {{eval}})"


@query(f"WITH {_PAIR} SELECT example_id, eval_id FROM n JOIN m ON t = u WHERE t <> ''")
def contamination_exact(v):
    return contamination.exact(v("example"), v("eval"))


@query(f"WITH {_PAIR} SELECT example_id, eval_id FROM n, m WHERE length(t) >= 30 AND u <> '' AND t NOT IN (SELECT u FROM m WHERE u IS NOT NULL) AND (contains(u, t) OR contains(t, u))")
def contamination_substring(v):
    return contamination.contained(v("example"), v("eval"))


@query(f"WITH {_PAIR}, w AS (SELECT DISTINCT example_id, substr(t, CAST(i AS INT) + 1, 50) AS w FROM (SELECT example_id, t, unnest(range(0, length(t) - 49, 5)) AS i FROM n WHERE length(t) >= 50 AND t NOT IN (SELECT u FROM m WHERE u IS NOT NULL))) SELECT DISTINCT example_id, eval_id FROM w, m WHERE contains(u, w)")
def contamination_shingle(v):
    return contamination.shared_windows(v("example"), v("eval"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM {events}")
def json_extract_props(v):
    from ..functions.columns import json_number, json_text

    return v("events").select("event_id", json_number(F.col("props"), "$.k").cast("long").alias("k"), json_text(F.col("props"), "$.missing").alias("missing"))


@query("SELECT run_id, round(max(mae), 6) AS mae, round(max(bias), 6) AS bias FROM (SELECT run_id, avg(abs(our - published_belief)) AS mae, avg(our - published_belief) AS bias FROM (SELECT run_id, stmt_hash, avg(score) AS our FROM {step} WHERE score IS NOT NULL GROUP BY 1, 2) s JOIN {statement} t ON t.stmt_hash = s.stmt_hash GROUP BY 1) GROUP BY 1")
def metric_pivot(v):
    long = None
    for run in ("run1", "run2"):
        rows = validity.metric_rows(validity.calibration(_of(run, v), v("statement")), run)
        long = rows if long is None else long.unionByName(rows)
    return rounded(validity.metric_pivot(long, ["mae", "bias"]))


@query("SELECT eval_id FROM {eval} e WHERE NOT EXISTS (SELECT 1 FROM {truth} t WHERE t.target_id = e.eval_id)")
def resume_unscored(v):
    return v("eval").select("eval_id").join(v("truth").select(F.col("target_id").alias("eval_id")), "eval_id", "left_anti")
