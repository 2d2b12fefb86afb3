"""Queries of the training-data operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linecrf, packing, pieces, rabitq, secrets, sharding, simhash, spotsigs, urls, winnow
from .common import cut, table


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rabitq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector among all others, by largest inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    fitted = rabitq.fit(vectors)
    indexed = cut(rabitq.index(vectors, fitted), "rabitq-index")
    return rabitq.search(indexed.where("vec_id % 20 = 0").select("vec_id", "vector"), indexed, fitted)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = linecrf.learn(docs, table(spark, sf_dir, "labels"))
    scored = linecrf.score(docs, model)
    return scored.select("doc_id", linecrf.held_out(F.col("doc_id")).alias("held_out"), "score", linecrf.predicted(F.col("score")).alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token piece of every document and its place in a sequence of 2048."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near these are."""
    found = spotsigs.edited_pairs(table(spark, sf_dir, "documents"), whole=True)
    prints = [spotsigs.as_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.learn(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("spans")).alias("spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoding of every document under the 32k piece vocabulary, as digests."""
    return pieces.digest_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without line runs that stand in an earlier place."""
    return winnow.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in one of 16 shards for every document, along a Hilbert curve."""
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op7_secret_automata": op7_secret_automata,
    "op8_sentencepiece": op8_sentencepiece,
    "op1_rabitq_neighbours": op1_rabitq_neighbours,
    "op2_url_rules": op2_url_rules,
    "op3_line_crf": op3_line_crf,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op9_winnowed_lines": op9_winnowed_lines,
    "op10_hilbert_shards": op10_hilbert_shards,
    "op5_spotsigs": op5_spotsigs,
    "op6_simhash_components": op6_simhash_components,
}

ORACLE_SQL: dict[str, str] = {}
