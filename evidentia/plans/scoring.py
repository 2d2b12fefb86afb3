"""Registered queries of the scoring dataflow, the store and the live tail."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import relations as R
from ..functions.columns import hex16, short_sha
from ..operators import claims, contamination, context, curate, decide, entities, routing
from ..sources import corpus, store
from ..streaming import tail
from .catalogue import ORACLE_SQL, QUERIES, query, rounded


def _claims(v):
    return _parsed(v("sentence"))


def _parsed(sentences):
    return claims.parse(sentences.withColumn("agents", F.array("subject", "object")))


def _pairs(v):
    entities = F.array(*[F.struct(F.col(c).alias("name"), F.array(F.lower(c)).alias("aliases")) for c in ("subject", "object")])
    return context.build(_parsed(v("sentence")).withColumn("entities", entities))


def _asked(stmt_type, subject, object, text):
    """What a sentence of a statement is asked about, as ``_pairs`` has it in columns."""
    known = [n for n in (subject, object) if n is not None] or ["?"]
    return text, known[0], known[min(1, len(known) - 1)], [{"name": n, "aliases": [n and n.lower()]} for n in (subject, object)]


def _told(v, work, **told):
    """The columns ``told`` of what ``work`` makes of the pairs, for every evidence; those alike in all that it depends on are worked once."""
    pairs = context.gathered(v("sentence"), "evidence_hash", ["stmt_type", "subject", "object", "text"], _asked)
    return work(_parsed(pairs)).select(F.explode("of").alias("evidence_hash"), *[c.alias(n) for n, c in told.items()])


_AXIS = "CASE stmt_type WHEN 'Phosphorylation' THEN 'modification' WHEN 'Complex' THEN 'binding' ELSE 'activity' END"
_SIGN = "CASE stmt_type WHEN 'Inhibition' THEN 'negative' WHEN 'Complex' THEN 'neutral' ELSE 'positive' END"
_RELATION = "CASE WHEN verb > 4 THEN NULL WHEN verb = 0 AND stmt_type = 'Phosphorylation' OR verb = 1 AND stmt_type = 'Activation' OR verb = 2 AND stmt_type = 'Inhibition' OR verb = 3 AND stmt_type = 'Complex' THEN 'direct_sign_match' WHEN verb = 1 AND stmt_type = 'Inhibition' OR verb = 2 AND stmt_type = 'Activation' THEN 'direct_sign_mismatch' ELSE 'direct_axis_mismatch' END"


@query(f"SELECT evidence_hash, subject, object, {_AXIS} AS axis, {_SIGN} AS sign FROM {{sentence}}")
def claim_parse(v):
    return _claims(v).select("evidence_hash", "claim.subject", F.col("claim.objects")[0].alias("object"), "claim.axis", "claim.sign")


@query("SELECT evidence_hash, concat(subject, ' ', CASE stmt_type WHEN 'Phosphorylation' THEN 'Phosphorylates' WHEN 'Activation' THEN 'activates' WHEN 'Inhibition' THEN 'inhibits' ELSE 'binds' END, ' ', object) AS claim_text FROM {sentence}")
def claim_text(v):
    return _claims(v).select("evidence_hash", claims.sentence(F.col("claim")).alias("claim_text"))


@query("SELECT item_id, regexp_replace(" + "".join("replace(replace(" for _ in R.GREEK) + "lower(text)" + "".join(f", '{w}', '{x}'), '{s}', '{x}')" for w, s, x in R.GREEK) + r", '[^\p{L}\p{N}]', '', 'g') AS alias FROM {benchmark}")
def alias_normalise(v):
    return v("benchmark").select("item_id", context.normalised(F.col("text")).alias("alias"))


@query("SELECT evidence_hash, verb < 5 AS found, CASE verb WHEN 0 THEN 'modification' WHEN 1 THEN 'activity' WHEN 2 THEN 'activity' WHEN 3 THEN 'binding' WHEN 4 THEN 'amount' END AS axis FROM {sentence}")
def relation_catalogue(v):
    r = F.get("ctx.relations", F.lit(0))
    return _told(v, lambda pairs: pairs, found=F.size("ctx.relations") > 0, axis=r["axis"])


@query("SELECT evidence_hash, contains(text, ' via ') AS has_chain, CASE WHEN contains(text, ' via ') THEN 'MEK1' ELSE '' END AS candidates FROM {sentence}")
def chain_signal(v):
    c = context.chain(F.col("text"))
    return v("sentence").select("evidence_hash", c["has_chain"].alias("has_chain"), F.array_join(c["candidates"], ",").alias("candidates"))


@query("SELECT evidence_hash, CASE WHEN contains(text, 'RAF/MEK/ERK') THEN 'ERK' ELSE '' END AS terminals, CASE WHEN contains(text, 'RAF/MEK/ERK') AND evidence_hash % 3 = 0 THEN subject ELSE '' END AS bound_terminals FROM {sentence}")
def cascade_terminal(v):
    names = F.array(F.struct(F.col("subject").alias("name"), F.when(F.col("evidence_hash") % 3 == 0, F.array(F.lit("erk"))).otherwise(F.array().cast("array<string>")).alias("aliases")))
    join = lambda c: F.array_join(c, ",")
    return v("sentence").select("evidence_hash", join(context.cascade_terminals(F.col("text"))).alias("terminals"), join(context.cascade_terminals(F.col("text"), names)).alias("bound_terminals"))


@query(f"SELECT evidence_hash, CASE WHEN verb < 5 THEN 'present_as_subject' END AS subject_role, CASE WHEN verb < 5 THEN 'present_as_object' END AS object_role, {_RELATION} AS relation_axis, CASE verb WHEN 5 THEN 'negated' WHEN 6 THEN 'hedged' END AS scope FROM {{sentence}}")
def route_probes(v):
    return _told(v, routing.route, **{p: F.col("probes")[p]["answer"] for p in routing.PROBES})


@query(f"""WITH r AS (SELECT *, {_RELATION} AS ra FROM {{sentence}}), d AS (SELECT *, CASE ra WHEN 'direct_sign_match' THEN 'correct' WHEN 'direct_sign_mismatch' THEN 'incorrect' WHEN 'direct_axis_mismatch' THEN 'incorrect' ELSE 'abstain' END AS verdict FROM r)
  SELECT evidence_hash, verdict, CASE ra WHEN 'direct_sign_match' THEN 'match' WHEN 'direct_sign_mismatch' THEN 'sign_mismatch' WHEN 'direct_axis_mismatch' THEN 'axis_mismatch' END AS reason,
  CASE verdict WHEN 'abstain' THEN 'medium' ELSE 'high' END AS confidence, CASE verdict WHEN 'correct' THEN 0.95 WHEN 'incorrect' THEN 0.05 ELSE 0.5 END::DOUBLE AS score FROM d""")
def scored_sentences(v):
    asserted = lambda claim, text: F.struct(F.lit("asserted").alias("answer"), F.lit("llm").alias("source"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("perturbation"))
    decided = lambda pairs: decide.decide(routing.answer_open(routing.route(pairs), {"scope": asserted}))
    return _told(v, decided, **{c: F.col(c) for c in ("verdict", "reason", "confidence", "score")})


@query(f"""WITH k AS (SELECT *, {_RELATION} AS ra FROM {{sentence}}), u AS (SELECT 'parse_claim' AS step_kind FROM k UNION ALL SELECT 'build_context' FROM k UNION ALL SELECT 'substrate_route' FROM k UNION ALL SELECT 'subject_role_probe' FROM k WHERE verb < 5
  UNION ALL SELECT 'object_role_probe' FROM k WHERE verb < 5 UNION ALL SELECT 'relation_axis_probe' FROM k WHERE ra IS NOT NULL UNION ALL SELECT 'scope_probe' FROM k WHERE verb IN (5, 6)) SELECT step_kind, count(*) AS n FROM u GROUP BY 1""")
def step_decompose(v):
    return routing.step_rows(routing.route(_pairs(v)), "run").groupBy("step_kind").agg(F.count(F.lit(1)).alias("n"))


_SET = lambda vs: "(VALUES " + ", ".join(f"('{x}')" for x in vs) + ")"


@query(f"""WITH x AS (SELECT s, o, r, c, t FROM {_SET(routing.ROLES)} a(s), {_SET(routing.ROLES)} b(o), {_SET(routing.ANSWERS['relation_axis'])} d(r), {_SET(routing.ANSWERS['scope'])} e(c), {_SET(['Activation', 'Complex', 'Phosphorylation'])} f(t)),
  z AS (SELECT *, CASE c WHEN 'hedged' THEN 'correct/hedging_hypothesis' WHEN 'negated' THEN 'incorrect/contradicted' ELSE 'correct/match' END AS scoped FROM x)
  SELECT s, o, r, c, t, CASE WHEN s = 'absent' OR o = 'absent' THEN 'abstain/grounding_gap' WHEN s = 'present_as_decoy' OR o = 'present_as_decoy' THEN 'incorrect/absent_relationship' WHEN s = 'present_as_mediator' OR o = 'present_as_mediator' THEN 'abstain/indirect_chain'
  WHEN s = 'present_as_object' AND o = 'present_as_subject' AND t <> 'Complex' THEN 'incorrect/role_swap' WHEN r = 'no_relation' THEN 'incorrect/absent_relationship' WHEN r = 'direct_axis_mismatch' THEN 'incorrect/axis_mismatch' WHEN r = 'direct_partner_mismatch' THEN 'incorrect/binding_domain_mismatch'
  WHEN r = 'direct_sign_mismatch' THEN 'incorrect/sign_mismatch' WHEN r = 'via_mediator' THEN CASE t WHEN 'Activation' THEN scoped ELSE 'abstain/indirect_chain' END WHEN r = 'via_mediator_partial' THEN CASE t WHEN 'Activation' THEN 'correct/chain_extraction_gap' ELSE 'abstain/chain_extraction_gap' END
  WHEN r = 'abstain' THEN 'abstain/' ELSE scoped END AS outcome FROM z""")
def adjudicate(v):
    spark = v("region").sparkSession
    of = lambda c, xs: spark.createDataFrame([(x,) for x in xs], f"{c} string").coalesce(1)
    grid = of("s", routing.ROLES).crossJoin(of("o", routing.ROLES)).crossJoin(of("r", routing.ANSWERS["relation_axis"])).crossJoin(of("c", routing.ANSWERS["scope"])).crossJoin(of("t", ["Activation", "Complex", "Phosphorylation"]))  # fixed lists
    probe = lambda c: F.struct(F.col(c).alias("answer"), F.lit("llm").alias("source"))
    axis = F.when(F.col("t") == "Complex", "binding").otherwise("activity")
    d = decide.verdict(probe("s"), probe("o"), probe("r"), probe("c"), F.col("t"), axis)
    return grid.select("*", F.concat(d["verdict"], F.lit("/"), F.coalesce(d["reason"], F.lit(""))).alias("outcome"))


@query("""WITH i AS (SELECT least(lower(subject), lower(object)) AS a, greatest(lower(subject), lower(object)) AS b, stmt_type, CAST(verb AS DOUBLE) / 8 AS belief FROM {sentence}), p AS (SELECT a, b, max(CASE WHEN stmt_type IN ('Activation', 'Inhibition') THEN belief END) AS belief, count(*) FILTER (stmt_type IN ('Activation', 'Inhibition')) AS n FROM i GROUP BY 1, 2)
  SELECT q.evidence_hash AS query_id, max(i.belief) AS same_axis_belief, CAST(sum(i.n) AS BIGINT) AS same_axis_n FROM {sentence} q JOIN p i ON i.a = least(lower(q.subject), lower(q.object)) AND i.b = greatest(lower(q.subject), lower(q.object)) GROUP BY 1""")
def kg_pair_signal(v):
    s = v("sentence").withColumn("agents", F.array("subject", "object")).withColumn("belief", F.col("verb").cast("double") / 8).withColumn("n_evidence", F.lit(1))
    asked = v("sentence").select(F.col("evidence_hash").alias("query_id"), F.col("object").alias("a"), F.col("subject").alias("b"), F.lit("activity").alias("axis"))
    return claims.pair_signal(asked, claims.pair_index(s)).select("query_id", "same_axis_belief", "same_axis_n")


@query("SELECT item_id AS example_id, doc_id AS eval_id FROM {benchmark}, {documents} WHERE split_part(lower({benchmark}.text), ' ', 1) = split_part(lower({documents}.text), ' ', 1) AND split_part(lower({benchmark}.text), ' ', 2) = split_part(lower({documents}.text), ' ', 2)".replace("{benchmark}.text", "benchmark.text").replace("{documents}.text", "documents.text"))
def pair_match(v):
    two = lambda df, i, name: df.select(F.col(i).alias(name), F.split_part(F.lower("text"), F.lit(" "), F.lit(1)).alias("a"), F.concat(F.lit("2:"), F.split_part(F.lower("text"), F.lit(" "), F.lit(2))).alias("b"))
    return contamination.same_pair(two(v("benchmark"), "item_id", "example_id"), two(v("documents"), "doc_id", "eval_id"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, o_orderpriority AS tag, o_custkey AS curator FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def curation_join(v):
    evidence = v("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_hash"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    curations = v("orders").select(F.col("o_orderkey").alias("source_hash"), F.col("o_orderpriority").alias("tag"), F.col("o_custkey").alias("curator"))
    return curate.curated(evidence, curations).select("id", "tag", "curator")


@query("""WITH r AS (SELECT stmt_hash AS source_hash, subject, object, text, evidence_hash AS id FROM {sentence}), a AS (SELECT * FROM r WHERE source_hash % 3 <> 0 AND source_hash % 7 <> 0 AND NOT (subject = 'GS1' AND object IN ('GP1', 'GP2')))
  SELECT source_hash, min(id) AS id FROM a GROUP BY 1""")
def holdout_exclusions(v):
    rows = v("sentence").select(F.col("stmt_hash").alias("source_hash"), "subject", "object", "text", F.col("evidence_hash").alias("id"))
    keys = curate.excluded(*[rows.where(f"source_hash % {n} = 0").select("source_hash") for n in (3, 7)])
    pairs = curate.excluded(*[rows.select(F.lit("GS1").alias("subject"), F.lit(o).alias("object")).limit(1) for o in ("GP1", "GP2")])
    return curate.available(rows, keys, pairs, order="id").select("source_hash", "id")


@query("SELECT DISTINCT truth_set_id FROM {target_label} WHERE target_kind = 'evidence'")
def verdict_truth_sets(v):
    return curate.verdict_truth_sets(v("target_label").withColumn("field", F.lit("verdict")))


@query("""SELECT stmt_hash, CASE stmt_type WHEN 'Complex' THEN 'protein' WHEN 'Inhibition' THEN 'membrane,complex' ELSE '' END AS domains, CASE stmt_hash % 3 WHEN 0 THEN concat('S', CAST(stmt_hash AS VARCHAR)) WHEN 1 THEN 'Y' ELSE '' END AS sites FROM {statement}""")
def claim_admits(v):
    kind = F.when(F.col("stmt_type") == "Inhibition", "Translocation").otherwise(F.col("stmt_type"))
    residue, position = F.when(F.col("stmt_hash") % 3 == 0, "S").when(F.col("stmt_hash") % 3 == 1, "Y"), F.when(F.col("stmt_hash") % 3 == 0, F.col("stmt_hash").cast("string"))
    return v("statement").select("stmt_hash", F.array_join(curate.binding_domains(kind), ",").alias("domains"), F.array_join(curate.acceptable_sites(residue, position), ",").alias("sites"))


_GROUNDED = [("FPLX", "TNF", "TNF", 0.9, "family"), ("HGNC", "x", "MIR21", 0.9, "mirna"), (None, "let-7", None, None, "mirna"), ("HGNC", "TNF", None, 0.1, "cytokine_or_ligand"), ("CHEBI", "IL6", "IL6", 0.2, "small_molecule"), ("HGNC", "TP53", "TP53", 0.59, "ambiguous"), ("HGNC", "TP53", "TP53", 0.6, "protein"), (None, "q", None, None, "unknown"), ("MESH", "q", "q", None, "protein")]


@query("SELECT s_suppkey AS id, CASE s_suppkey % 9 " + " ".join(f"WHEN {i} THEN '{g[4]}'" for i, g in enumerate(_GROUNDED)) + " END AS kind FROM {supplier}")
def semantic_classes(v):
    field = lambda j, kind: F.get(F.array(*[F.lit(g[j]).cast(kind) for g in _GROUNDED]), (F.col("s_suppkey") % 9).cast("int"))
    return v("supplier").select(F.col("s_suppkey").alias("id"), context.semantic_class(field(0, "string"), field(1, "string"), field(2, "string"), field(3, "double")).alias("kind"))


#: A sentence for each pattern of the catalogue, in its order; A is the agent, B the target.
_SENTENCES = """A phosphorylates B at S383.|B is phosphorylated by A|phosphorylation of B by A|A-induced B phosphorylation|A-mediated B acetylation|A-dependent phosphorylation of B|A phosphorylation of B|B phosphorylation by A|A also increases the phosphorylation of B|A, which in turn phosphorylates B
A binds to B|binding of A to B|A interacts with B|complex of A and B|A/B interaction|interaction between A and B|A recruits B|A binding to B|A's interaction with B|A forms a complex with B|A and B complex|binding affinity of A for B|A bound directly to B|A is stably associated with B|MEK and A bound to B|A protein binding to B
A activates B|A-induced B activation|A-mediated B activation|activation of B by A|A activation of B|A triggered the activation of B|A-induced activation of B|A-induced activation of FOS, JUN and B|A stimulates the release of B|A-induced release of IL6 and B
A inhibits the activation of B|A suppresses B signaling|reduction in B activity by A|A-mediated decrease in B activity
A upregulates B expression|A induces B expression|B expression is increased by A|A-induced B expression|A signalling is required to elevate B|A further induces the expression of B|A increases B and FOS expression|A increases FOS and B secretion"""
_TEMPLATES = [(t, "modification binding activity activity amount".split()[i], "positive neutral positive negative positive".split()[i]) for i, group in enumerate(_SENTENCES.split("\n")) for t in group.split("|")]


def _named(v, templates: list[str], every: int):
    """Suppliers as claims about GA<n> and GB<n>, with a sentence by a template each."""
    words = [F.array(*[F.lit(part) for part in _pieces(t)]) for t in templates]
    a, b = F.concat(F.lit("GA"), F.col("id").cast("string")), F.concat(F.lit("GB"), F.col("id").cast("string"))
    said = F.array_join(F.transform(F.get(F.array(*words), (F.col("id") % every).cast("int")), lambda w: F.when(w == "<A>", a).when(w == "<B>", b).otherwise(w)), "")
    rows = v("supplier").select(F.col("s_suppkey").alias("id")).select("id", F.lit("Activation").alias("stmt_type"), F.array(a, b).alias("agents"), said.alias("text"), a.alias("a"), b.alias("b"))
    names = F.array(*[F.struct(F.col(c).alias("name"), F.array(F.lower(c)).alias("aliases")) for c in "ab"])
    return context.build(claims.parse(rows.withColumn("entities", names)))


def _pieces(template: str) -> list[str]:
    return [f"<{w}>" if w in ("A", "B") else w for w in re.split(r"\b([AB])\b", template)]


@query("SELECT s_suppkey AS id, CASE s_suppkey % 48 " + " ".join(f"WHEN {i} THEN '{a}/{g}'" for i, (_, a, g) in enumerate(_TEMPLATES)) + " END AS relation, CASE s_suppkey % 48 WHEN 0 THEN 'S383' END AS site FROM {supplier}")
def catalogue_patterns(v):
    """What every pattern's sentence is found to say, if it says it of the claim's agent and target."""
    wanted = F.get(F.array(*[F.lit(p[0]) for p in R.catalogue()]), (F.col("id") % 48).cast("int"))
    own = F.filter("ctx.relations", lambda r: (r["agent"] == F.col("a")) & (r["target"] == F.col("b")) & (F.split_part(r["pattern_id"], F.lit("."), F.lit(1)) == F.split_part(wanted, F.lit("."), F.lit(1))))
    first = F.get(own, F.lit(0))
    return _named(v, [t for t, _, _ in _TEMPLATES], 48).select("id", F.concat(first["axis"], F.lit("/"), first["sign"]).alias("relation"), first["site"].alias("site"))


#: Sentences with what the detectors find: sites, hedges, negation, the agent's perturbation.
_DETECTED = [
    ("phosphorylation of B by A at S102 and threonine 15", "S102,T15", "", False, None), ("A may bind B; residue Y15 is modified", "Y15", "may", False, None), ("A siRNA reduced B, as Fig. S12 shows", "", "", False, "loss_of_function"),
    ("overexpression of A raised B", "", "", False, "gain_of_function"), ("A does not bind B", "", "", True, None), ("serine 727 of B is not a site of A", "S727", "", True, None),
    ("A is thought to signal. Presumably to many, B is not known", "", "is thought to,presumably,presumably to", False, None),
]


@query("SELECT s_suppkey AS id, " + ", ".join("CASE s_suppkey % 7 " + " ".join(f"WHEN {i} THEN " + ("NULL" if d[j] is None else str(d[j]).upper() if j == 3 else f"'{d[j]}'") for i, d in enumerate(_DETECTED)) + f" END AS {n}" for j, n in ((1, "sites"), (2, "hedges"), (3, "negated"), (4, "perturbation"))) + " FROM {supplier}")
def detector_sentences(v):
    return _named(v, [d[0] for d in _DETECTED], 7).select("id", F.array_join("ctx.sites", ",").alias("sites"), F.array_join("ctx.hedges", ",").alias("hedges"), "ctx.negated", F.col("ctx.subject_perturbation").alias("perturbation"))


def _store(v) -> store.Store:
    """A new store in the folder that driver and executors share, or a local one where none is named."""
    spark = v("region").sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='evidentia-')}"
    return store.Store(spark, f"{shared}/store-{uuid.uuid4().hex}").create()


@query("SELECT CAST(stmt_hash AS VARCHAR) AS stmt_hash, CAST(max_by(supp % 50, position) AS DOUBLE) AS published_belief FROM {evidence} GROUP BY 1")
def upsert_latest(v):
    """Three batches of a table's rows, of each key the last one by position."""
    s, rows = _store(v), v("evidence").select(F.col("stmt_hash").cast("string").alias("stmt_hash"), (F.col("supp") % 50).cast("double").alias("published_belief"), "position")
    for part in ("position <= 2", "position = 3", "position > 3"):
        s.upsert("statement", rows.where(part), order="position")
    return s.read("statement").select("stmt_hash", "published_belief")


@query("SELECT CAST(target_id AS VARCHAR) AS target_id, CASE target_id % 2 WHEN 0 THEN 'replaced' ELSE gold END AS gold FROM {truth}")
def label_antijoin_upsert(v):
    """Labels loaded twice into one truth set: the second load replaces those with its keys."""
    s = _store(v)
    s.register_truth_set("gold", "Gold")
    labels = v("truth").select(F.lit("evidence").alias("target_kind"), F.col("target_id").cast("string").alias("target_id"), F.lit("verdict").alias("field"), F.col("gold").alias("value_text"))
    s.load_labels(labels, "gold")
    s.load_labels(labels.where("cast(target_id as long) % 2 = 0").withColumn("value_text", F.lit("replaced")), "gold")
    return s.read("truth_label").select("target_id", F.col("value_text").alias("gold"))


@query("SELECT o_orderkey AS from_hash, coalesce(CAST(c_custkey + 1000000000 AS VARCHAR), concat('id', CAST(o_custkey AS VARCHAR))) AS to_hash FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def edge_resolution(v):
    edges = v("orders").select(F.col("o_orderkey").alias("from_hash"), F.concat(F.lit("id"), F.col("o_custkey").cast("string")).alias("to_id"), F.lit("supports").alias("kind"))
    known = v("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("source_uuid"), (F.col("c_custkey") + 1000000000).cast("string").alias("stmt_hash"))
    return corpus.resolve_edges(edges, known, "d").select("from_hash", "to_hash")


@query("SELECT s_suppkey AS id, lower(lpad(to_hex(s_suppkey), 16, '0')) AS hex_key, substr(sha256(concat(s_name, '|', CAST(s_nationkey AS VARCHAR))), 1, 16) AS content_key FROM {supplier}")
def content_keys(v):
    return v("supplier").select(F.col("s_suppkey").alias("id"), hex16(F.col("s_suppkey")).alias("hex_key"), short_sha(F.col("s_name"), F.col("s_nationkey")).alias("content_key"))


@query("""WITH n AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z]+|\\d+') AS t FROM {part}), m AS (SELECT id, list_distinct(list_filter(t, lambda x: regexp_matches(x, '^\\d+$') OR length(x) > 1 AND x NOT IN (""" + ", ".join(f"'{g}'" for g in entities.GENERIC) + """))) AS t FROM n) SELECT id, len(t) AS n, array_to_string(list_sort(t), ' ') AS words FROM m""")
def token_overlap(v):
    t = entities.tokens(F.col("p_name"))
    return rounded(v("part").select(F.col("p_partkey").alias("id"), F.size(t).alias("n"), F.array_join(F.array_sort(t), " ").alias("words")))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'MISMATCH' ELSE 'UNRESOLVABLE' END AS status FROM {supplier}""")
def entity_verify(v):
    s = v("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("raw_text"))
    own, other = F.struct(F.lit("X").alias("entry"), F.lit("HGNC").alias("db"), F.col("id").cast("string").alias("i")), F.struct(F.lit("Y").alias("entry"), F.lit("HGNC").alias("db"), F.lit("0").alias("i"))
    found = F.when(F.col("id") % 4 == 0, F.array(own, other)).when(F.col("id") % 4 == 1, F.array(other, own)).when(F.col("id") % 4 == 2, F.array(other)).otherwise(F.filter(F.array(own), lambda x: F.lit(False)))
    cand = s.select(F.col("raw_text").alias("text"), F.posexplode(found).alias("position", "c")).select("text", "position", "c.entry", "c.db", F.col("c.i").alias("id"), F.lit(0.9).alias("score"))
    rows = s.select("id", "raw_text", F.lit("Z").alias("name"), F.lit(None).cast("string").alias("canonical"), F.lit("HGNC").alias("db"), F.col("id").cast("string").alias("db_id"), F.array(F.lit("unlike")).alias("all_names"))
    families = s.select(F.lit("HGNC:-1").alias("child"), F.lit("FPLX:-1").alias("parent")).limit(1)
    return entities.verify(rows, cand, families).select("id", "status")


@query()
def clause_split(v):
    return v("documents").select("doc_id", F.array_join(context.clauses(F.col("text")), " / ").alias("clauses"))


@query()
def nominalisations(v):
    return v("sentence").select("evidence_hash", F.array_join(context.nominalisations(F.col("text")), ";").alias("phrases"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN concat('GA', s_suppkey, '-induced phosphorylation of GB', s_suppkey) WHEN 1 THEN concat('GA', s_suppkey, '-mediated degradation of GB', s_suppkey, ';GB', s_suppkey, '-dependent activation of GA', s_suppkey) ELSE '' END AS phrases FROM {supplier}""")
def nominal_phrases(v):
    said = ["A-induced phosphorylation of B", "A-mediated degradation of B and B-dependent activation of A", "A phosphorylates B"]
    return _named(v, said, 3).select("id", F.array_join("nominalised", ";").alias("phrases"))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN concat('GA', s_suppkey, ' binds to GB', s_suppkey, '. / Then GB', s_suppkey, ' binds GA', s_suppkey, '!') WHEN 1 THEN concat('GA', s_suppkey, ' binds GB', s_suppkey) ELSE concat('Is GA', s_suppkey, ' found? No.') END AS clauses FROM {supplier}""")
def sentence_clauses(v):
    said = ["A binds to B. Then B binds A! It is so.", "A binds B", "Is A found? No."]
    return _named(v, said, 3).select("id", F.array_join(context.clauses(F.col("text")), " / ").alias("clauses"))


@query("SELECT evidence_hash, CAST('' AS VARCHAR) AS sites, CASE verb WHEN 6 THEN 'may' ELSE '' END AS hedges, verb = 5 AS negated, CAST(NULL AS VARCHAR) AS perturbation FROM {sentence}")
def offset_detectors(v):
    return _pairs(v).select("evidence_hash", F.array_join("ctx.sites", ",").alias("sites"), F.array_join("ctx.hedges", ",").alias("hedges"), "ctx.negated", F.col("ctx.subject_perturbation").alias("perturbation"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS stmt_hash, concat('{"belief":', CASE WHEN o_orderkey % 2 = 0 THEN '0.25' ELSE '1' END, ',"id":"x"}') AS value FROM {orders}""")
def export_json(v):
    s = v("orders").select(F.col("o_orderkey").cast("string").alias("stmt_hash"), F.lit('{"belief":1,"id":"x"}').alias("raw_json"))
    return store.export_beliefs(s, s.where("cast(stmt_hash as long) % 2 = 0").withColumn("belief", F.lit(0.25)), only_scored=False)


@query()
def model_card(v):
    from ..operators import reads, validity

    step = v("step").where("run_id = 'run2'")
    metrics = validity.metric_rows(validity.calibration(step, v("statement")), "run2").withColumn("slice_json", F.lit(None).cast("string"))
    return store.model_card(v("run").where("run_id = 'run2'"), metrics, reads.truth_coverage(v("target_label"), v("statement"), v("evidence"), v("agent")))


def _tail(spark, sf_dir):
    """The live tail run to its end over the events file: counts by hour and type."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    events = tail.event_stream(spark, path + "*", schema)
    name = f"tail_{uuid.uuid4().hex}"
    counts = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


QUERIES["events_live_tail"] = _tail
ORACLE_SQL["events_live_tail"] = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"
