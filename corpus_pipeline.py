"""The corpus pipeline: documents through five stages, each one operator of ``evidentia.llm``.

Columns of ``documents`` beyond ``doc_id``, ``text`` and ``n_chars`` pass through the first four
stages untouched, whatever their names (``n_lines`` and ``n_removed`` become those of the lines
stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import linecrf, packing, secrets, similar, winnow
from evidentia.llm.common import cut, table
from evidentia.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learnt from the labels, holds to be good.

    A null or empty text is scored as one line without words; very long texts are scored whole;
    repeated rows and ties of ids are each scored; without labels or rows the result is empty.
    """
    model = linecrf.learn(docs, table(spark, sf_dir, "labels"))
    return linecrf.score(docs, model, out="__score").where(F.col("__score") >= linecrf.GOOD).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line runs that stand earlier; those that lose all their lines go.

    Null and empty texts stay as they are; very long texts are read whole; repeated rows are one
    document and stay as often as they stand there; an empty table gives an empty result.
    """
    done = winnow.dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies; rows without an id stay.

    Near copies: all texts whose sets of five-word shingles are alike by 0.8 or more (Jaccard).
    Null, empty and wordless texts are one group; very long texts are compared whole; of
    repeated rows one stays; an empty table gives an empty result.
    """
    return similar.without_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark.

    Null texts stay null; very long texts are scanned whole; repeated rows are each scanned; an
    empty table gives an empty result.
    """
    clean = secrets.redact(docs, secrets.learn(docs))
    return clean.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece of every document and its place in a sequence of 2048.

    Null and empty texts are documents of one id; very long ones are cut into pieces; repeated
    rows are each packed; an empty table gives an empty result.
    """
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near copies", near_copies), ("secrets", secret_scan), ("packing", pack)]

#: SQL can express neither the field nor the automata; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
