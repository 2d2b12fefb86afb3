"""Sources: nested statement JSON, JSON lines, key files, file discovery."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import short_sha
from ..operators.claims import agent_hash, agent_rows, statement_key

_AGENT = "struct<name:string,db_refs:map<string,string>,mods:string,mutations:string,bound_conditions:string,activity:string,location:string>"
EVIDENCE = "struct<source_api:string,pmid:string,source_id:string,text:string,source_hash:bigint,epistemics:map<string,boolean>,annotations:string,text_refs:map<string,string>>"
#: The schema of nested statements; fields that a file lacks are null.
STATEMENT = (
    f"type string, enz {_AGENT}, sub {_AGENT}, subj {_AGENT}, obj {_AGENT}, members array<{_AGENT}>, residue string, position string, belief double,"
    f" evidence array<{EVIDENCE}>, supports array<string>, supported_by array<string>, id string, matches_hash string"
)


def read_statements(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Statements of JSON files (a list of objects each; gzip by extension), spread over partitions.

    Such a file is one split; it is dealt out anew before anything else is done to its rows.
    """
    df = spark.read.schema(STATEMENT).option("multiLine", True).json(path)
    return df.repartition(partitions) if partitions else df


def read_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """JSON lines: good rows, and one row of counts (n_lines, bad_json, and missing by field).

    Blank lines are no lines. A row with a missing field is not good.
    """
    fields = T.StructType.fromDDL(schema)
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", fields.add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    good = ~bad
    for f in required:
        good = good & F.col(f"r.{f}").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = parsed.agg(F.count(F.lit(1)).alias("n_lines"), count(bad).alias("bad_json"), *[count(~bad & F.col(f"r.{f}").isNull()).alias(f"missing_{f}") for f in required])
    return parsed.where(good).select("r.*").drop("_bad"), counts


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation texts: ``evidence_text``, else ``evidence``, rows without either dropped."""
    df = spark.read.text(path).where(F.trim("value") != "")
    text = F.coalesce(F.nullif(F.get_json_object("value", "$.evidence_text"), F.lit("")), F.nullif(F.get_json_object("value", "$.evidence"), F.lit("")))
    return df.select(text.alias("text"), "value").where("text is not null")


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last in order."""
    names = rows.columns
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("r.*")


def evidence_index(statements: DataFrame) -> DataFrame:
    """Evidence by source hash: (source_hash, stmt_hash, ev_index, agents); rows without a hash dropped."""
    rows = statements.select(statement_key(F.col("matches_hash")).alias("stmt_hash"), names(statements).alias("agents"), F.posexplode("evidence").alias("ev_index", "e"))
    return rows.select("e.source_hash", "stmt_hash", "ev_index", "agents").where("source_hash is not null")


def names(statements: DataFrame) -> Column:
    """The names of a nested statement's agents, in order of their roles."""
    one = F.filter(F.array("enz.name", "sub.name", "subj.name", "obj.name"), lambda n: n.isNotNull())
    return F.when(F.size(F.coalesce("members", F.array())) > 0, F.transform("members", lambda m: m["name"])).otherwise(one)


def tables(statements: DataFrame, dump: str) -> dict[str, DataFrame]:
    """Nested statements as the rows of the corpus tables, in bulk.

    A belief of 0 or none is 1. Evidence keys are content hashes; evidence that two
    statements share keeps the last statement. Edges name statements by key where the other
    end is in the corpus, else by its id.
    """
    s = statements.withColumn("stmt_hash", statement_key(F.col("matches_hash")))
    empty = F.array().cast("array<string>")
    belief = F.when(F.coalesce("belief", F.lit(0.0)) == 0, 1.0).otherwise(F.col("belief"))
    statement = s.select("stmt_hash", F.col("id").alias("source_uuid"), F.col("type").alias("stmt_type"), belief.alias("published_belief"), F.size(F.coalesce("supports", empty)).alias("supports_count"), F.size(F.coalesce("supported_by", empty)).alias("supported_by_count"), F.to_json(F.struct(*statements.columns)).alias("raw_json"), F.lit(dump).alias("source_dump_id"))
    ev = s.select("stmt_hash", F.posexplode(F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>"))).alias("pos", "e"))
    refs = lambda k: F.try_element_at("e.epistemics", F.lit(k))
    ev = ev.select(
        F.coalesce(F.lower(F.lpad(F.hex("e.source_hash"), 16, "0")), short_sha(F.col("e.source_api"), F.col("e.pmid"), F.col("e.text"))).alias("evidence_hash"),
        "stmt_hash", "e.source_api", "e.source_id", "e.pmid", "e.text", refs("direct").alias("is_direct"), refs("negated").alias("is_negated"), refs("curated").alias("is_curated"),
        F.to_json("e.epistemics").alias("epistemics_json"), F.col("e.annotations").alias("annotations_json"), F.to_json("e").alias("raw_json"), "pos",
    )
    evidence = last_by_key(ev, "evidence_hash", "stmt_hash").drop("pos")
    agents = agent_rows(s)
    agents = agents.withColumn("agent_hash", agent_hash(F.col("role"), F.col("name"), F.col("db_refs"))).withColumn("db_refs_json", F.to_json("db_refs")).drop("db_refs")
    edges = None
    for kind in ("supports", "supported_by"):
        part = s.select(F.col("stmt_hash").alias("from_hash"), F.explode(kind).alias("to_id"), F.lit(kind).alias("kind"))
        edges = part if edges is None else edges.unionByName(part)
    return {"statement": statement, "evidence": evidence, "agent": agents.dropDuplicates(["stmt_hash", "agent_hash", "role", "role_index"]), "supports_edge": resolve_edges(edges, statement, dump)}


def resolve_edges(edges: DataFrame, statement: DataFrame, dump: str) -> DataFrame:
    """Edges with their other end's key where that statement is known, else its id; each once."""
    known = statement.select(F.col("source_uuid").alias("to_id"), F.col("stmt_hash").alias("to_known")).where("to_id is not null").dropDuplicates(["to_id"])
    out = edges.join(known, "to_id", "left").select("from_hash", F.coalesce("to_known", "to_id").alias("to_hash"), "kind", F.lit(dump).alias("source_dump_id"))
    return out.dropDuplicates(["from_hash", "to_hash", "kind"])


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Data files below a folder: path, kind, length, time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(folder).select("path", "length", "modificationTime")
    kind = F.when(F.col("path").rlike(r"\.jsonl(\.gz)?$"), "jsonl").when(F.col("path").rlike(r"\.json\.gz$"), "json.gz").when(F.col("path").rlike(r"\.json$"), "json")
    return files.withColumn("kind", kind).where("kind is not null")


def duplicate_files(spark: SparkSession, folder: str, head: int = 16_384) -> DataFrame:
    """Files with a fingerprint of their length and head; of equal ones the first by path is canonical."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(folder)
    print_ = F.substring(F.sha2(F.concat(F.encode(F.concat(F.col("length").cast("string"), F.lit("|")), "UTF-8"), F.substring("content", 1, head)), 256), 1, 16)
    rows = files.select("path", "length", print_.alias("fingerprint"))
    groups = rows.groupBy("fingerprint").agg(F.min("path").alias("canonical"), F.count(F.lit(1)).alias("n"))
    return rows.join(groups, "fingerprint").withColumn("is_duplicate", F.col("path") != F.col("canonical"))


def preview(statements: DataFrame, sample: int = 3) -> DataFrame:
    """Number of records, their sources, and a few as text."""
    rows = statements.select(F.to_json(F.struct(*statements.columns)).alias("line"), F.transform(F.coalesce("evidence", F.array().cast(f"array<{EVIDENCE}>")), lambda e: e["source_api"]).alias("apis"))
    few = rows.select("line").limit(sample).agg(F.collect_list("line").alias("samples"))
    counts = rows.agg(F.count(F.lit(1)).alias("n_records"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("apis")))).alias("sources"))
    return counts.crossJoin(few)  # a row each


TOKENS = {"run_id": re.compile(r"^[0-9a-f]{32}$"), "stmt_hash": re.compile(r"^[0-9a-f]{16}$"), "model": re.compile(r"^[A-Za-z0-9._:/-]{1,80}$"), "version": re.compile(r"^[A-Za-z0-9._-]{1,40}$")}


def checked(kind: str, token: str) -> str:
    """The token, if it has the form of its kind; else an error."""
    if not TOKENS[kind].fullmatch(token):
        raise ValueError(f"not a {kind}: {token!r}")
    return token
