"""Views of the driver's tables in the shape of the corpus tables.

Each is one SELECT that Spark and DuckDB read alike, so queries and their SQL share it. Only
``round`` differs between the two: Spark rounds the decimals that a double is printed with,
DuckDB the double times a power of ten, and Spark is told to do as DuckDB does.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "statement": """SELECT o_orderkey AS stmt_hash, CASE o_orderkey % 5 WHEN 0 THEN 'Phosphorylation' WHEN 1 THEN 'Activation'
        WHEN 2 THEN 'Inhibition' WHEN 3 THEN 'Complex' ELSE 'IncreaseAmount' END AS stmt_type,
        round(o_totalprice / 500000, 4) AS published_belief, o_orderpriority AS source_dump_id,
        o_orderkey % 3 AS supports_count, o_orderkey % 2 AS supported_by_count FROM {orders}""",
    "evidence": """SELECT l_orderkey * 10 + l_linenumber AS evidence_hash, l_orderkey AS stmt_hash,
        CASE min(l_suppkey) % 7 WHEN 0 THEN 'reach' WHEN 1 THEN 'Sparser' WHEN 2 THEN 'signor' WHEN 3 THEN 'trips'
        WHEN 4 THEN 'rlimsp' WHEN 5 THEN 'biogrid' ELSE 'newdb' END AS source_api, min(l_returnflag) AS flag_a, max(l_returnflag) AS flag_b,
        min(l_discount) AS d_a, max(l_discount) AS d_b, min(l_partkey) AS part, min(l_suppkey) AS supp,
        CASE min(l_linestatus) WHEN 'F' THEN 'increases' WHEN 'O' THEN CASE min(l_suppkey) % 2 WHEN 0 THEN 'decreases' END END AS regulation_type,
        l_linenumber AS position FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "step": """SELECT 'run1' AS run_id, stmt_hash, evidence_hash, CASE flag_a WHEN 'A' THEN 'correct' WHEN 'N' THEN 'abstain' ELSE 'incorrect' END AS verdict,
        CASE WHEN flag_a = 'N' AND part % 5 = 0 THEN NULL ELSE round(1 - d_a * 5, 4) END AS score FROM {evidence}
        UNION ALL SELECT 'run2' AS run_id, stmt_hash, evidence_hash, CASE flag_b WHEN 'A' THEN 'incorrect' WHEN 'N' THEN NULL ELSE 'correct' END AS verdict,
        CASE WHEN flag_b = 'N' AND part % 5 = 1 THEN NULL ELSE round(1 - d_b * 6, 4) END AS score FROM {evidence}""",
    "run": """SELECT 'run1' AS run_id, 1 AS started_at, 'succeeded' AS status UNION ALL SELECT 'run2', 2, 'succeeded'
        UNION ALL SELECT 'run3', 3, 'failed' UNION ALL SELECT 'run0', 0, 'succeeded'""",
    "agent": """SELECT evidence_hash AS agent_hash, stmt_hash, CASE part % 4 WHEN 0 THEN 'subj' WHEN 1 THEN 'obj' WHEN 2 THEN 'member' ELSE 'other' END AS role,
        position AS role_index, concat('P', CAST(part % 97 AS STRING)) AS name FROM {evidence} WHERE position <= 4""",
    "slot": """SELECT e.evidence_hash, e.stmt_hash, p.probe, CASE (e.part + p.k) % 3 WHEN 0 THEN 'substrate' END AS substrate_source,
        CASE (e.part + p.k) % 3 WHEN 0 THEN p.good END AS substrate_answer, CASE (e.part + p.k) % 3 WHEN 0 THEN 'medium' END AS substrate_confidence
        FROM {evidence} e CROSS JOIN {probe} p""",
    "answer": """SELECT e.evidence_hash, e.stmt_hash, p.probe, CASE (e.supp + p.k) % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN p.bad ELSE p.good END AS answer,
        CASE (e.supp + p.k) % 5 WHEN 0 THEN 'abstain' WHEN 4 THEN 'other' ELSE 'llm' END AS source,
        CASE e.supp % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
        FROM {evidence} e CROSS JOIN {probe} p WHERE (e.part + p.k) % 4 <> 0""",
    "probe": """SELECT 0 AS k, 'subject_role' AS probe, 'present_as_subject' AS good, 'absent' AS bad
        UNION ALL SELECT 1, 'object_role', 'present_as_object', 'present_as_subject'
        UNION ALL SELECT 2, 'relation_axis', 'direct_sign_match', 'direct_axis_mismatch' UNION ALL SELECT 3, 'scope', 'asserted', 'negated'""",
    "truth": """SELECT CASE doc_id % 3 WHEN 0 THEN 'gold_a' ELSE 'gold_b' END AS truth_set_id, doc_id AS target_id,
        CASE quality WHEN 1 THEN 'correct' ELSE 'incorrect' END AS gold FROM {labels}""",
    "predicted": "SELECT doc_id AS target_id, CASE WHEN n_chars > 1000 THEN 'correct' ELSE 'incorrect' END AS verdict FROM {documents}",
    "target_label": """SELECT CASE part % 3 WHEN 0 THEN 'gold_a' WHEN 1 THEN 'gold_b' ELSE 'gold_c' END AS truth_set_id, CASE supp % 3 WHEN 0 THEN 'statement' WHEN 1 THEN 'evidence' ELSE 'agent' END AS target_kind,
        CASE supp % 3 WHEN 0 THEN stmt_hash WHEN 1 THEN evidence_hash ELSE evidence_hash + CASE part % 2 WHEN 0 THEN 0 ELSE 5 END END AS target_id FROM {evidence}""",
    "scored": """SELECT evidence_hash AS id, stmt_hash, CAST(round(1 - d_a * 10, 2) AS DOUBLE) AS score, CASE flag_a WHEN 'A' THEN 1 ELSE 0 END AS label, source_api,
        CASE part % 4 WHEN 0 THEN 'grounding' WHEN 1 THEN 'polarity' ELSE 'correct' END AS tag, CASE WHEN flag_b = 'R' THEN TRUE ELSE FALSE END AS kept FROM {evidence}""",
    "judged": """SELECT evidence_hash AS id, CASE flag_a WHEN 'A' THEN 'correct' WHEN 'N' THEN 'abstain' ELSE 'incorrect' END AS old,
        CASE flag_b WHEN 'R' THEN 'correct' WHEN 'N' THEN 'abstain' ELSE 'incorrect' END AS new, CASE part % 2 WHEN 0 THEN 'correct' ELSE 'incorrect' END AS gold, source_api FROM {evidence}""",
    "sentence": """SELECT evidence_hash, stmt_hash, part % 8 AS verb, CASE supp % 4 WHEN 0 THEN 'Phosphorylation' WHEN 1 THEN 'Activation' WHEN 2 THEN 'Inhibition' ELSE 'Complex' END AS stmt_type,
        concat('GS', CAST(supp % 53 AS STRING)) AS subject, concat('GP', CAST(part % 97 AS STRING)) AS object,
        concat('GS', CAST(supp % 53 AS STRING), CASE part % 8 WHEN 0 THEN ' phosphorylates ' WHEN 1 THEN ' activates ' WHEN 2 THEN ' inhibits the activation of ' WHEN 3 THEN ' binds to '
        WHEN 4 THEN ' upregulates ' WHEN 5 THEN ' does not activate ' WHEN 6 THEN ' may signal to ' ELSE ' and ' END, 'GP', CAST(part % 97 AS STRING), CASE part % 3 WHEN 0 THEN ' via MEK1.' WHEN 1 THEN ' in the RAF/MEK/ERK pathway.' ELSE '.' END) AS text FROM {evidence}""",
    "example": "SELECT item_id AS example_id, text FROM {benchmark}",
    "eval": "SELECT doc_id AS eval_id, text FROM {documents}",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def needs(sql: str) -> list[str]:
    """Views that a text with ``{view}`` marks needs, each after those it stands on itself."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", sql):
        if name in VIEWS:
            for x in [*needs(VIEWS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def duck(sql: str) -> str:
    """A query with ``{view}`` marks as SQL for DuckDB, the views as common table expressions."""
    names = needs(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).replace("AS STRING", "AS VARCHAR")
    withs = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in names)
    body = plain(sql).strip()
    if not withs:
        return body
    return f"WITH {withs}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {withs} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the tables themselves, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_spark(name, sf_dir))


def rounding(sql: str) -> str:
    """``round(x, n)`` as DuckDB rounds doubles: 0.01945 to four digits is 0.0194, as 194.49999999999997 is below the half."""
    return re.sub(r"\bround\(([^()]+), (\d+)\)", r"(round((\1) * 1e\2D) / 1e\2D)", sql)


def _spark(name: str, sf_dir: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"({_spark(m[1], sf_dir)})" if m[1] in VIEWS else f"parquet.`{sf_dir}/{m[1]}.parquet`", rounding(VIEWS[name]))
