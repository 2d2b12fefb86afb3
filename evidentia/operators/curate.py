"""Curations of evidence, exclusions from held-out sets, and what a claim's type admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curated(evidence: DataFrame, curations: DataFrame, key: str = "source_hash") -> DataFrame:
    """Every curation beside the evidence that it is about: many to many, rows without a key on either side dropped.

    Columns that both sides have are the evidence's; the curation's get the prefix ``curation_``.
    """
    both = [c for c in curations.columns if c in evidence.columns and c != key]
    return evidence.where(F.col(key).isNotNull()).join(curations.withColumnsRenamed({c: f"curation_{c}" for c in both}), key)


def excluded(*sets: DataFrame) -> DataFrame:
    """The union of exclusion sets of one shape, each key once; nulls exclude nothing."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s.select(*out.columns))
    return out.na.drop().distinct()


def available(rows: DataFrame, keys: DataFrame, pairs: DataFrame, key: str = "source_hash", order: str | None = None) -> DataFrame:
    """Rows that may be held out: their key and their (subject, object) are not excluded, they have a text and a known side.

    Of rows with one key the first by ``order`` stays.
    """
    left = rows.join(keys.select(key), key, "left_anti").join(pairs.select("subject", "object"), ["subject", "object"], "left_anti")
    left = left.where((F.coalesce("text", F.lit("")) != "") & ~((F.col("subject") == "?") & (F.col("object") == "?")))
    names = rows.columns
    return left.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(order or key, *[c for c in names if c not in (order, key)])).alias("r")).select("r.*")


def verdict_truth_sets(labels: DataFrame) -> DataFrame:
    """Truth sets that have verdicts on evidence, each once."""
    return labels.where("target_kind = 'evidence' and field = 'verdict'").select("truth_set_id").distinct()


# The binding domains that a type admits; other types admit any.
DOMAINS = {"Complex": ["protein"], "Translocation": ["membrane", "complex"]}


def binding_domains(stmt_type: Column) -> Column:
    """The binding domains that a claim's type admits, an empty array for any."""
    out = F.array().cast("array<string>")
    for kind, domains in DOMAINS.items():
        out = F.when(stmt_type == kind, F.array(*map(F.lit, domains))).otherwise(out)
    return out


def acceptable_sites(residue: Column, position: Column) -> Column:
    """The site that a claim names, as an array of at most one."""
    site = F.concat(F.coalesce(residue, F.lit("")), F.coalesce(position, F.lit("")))
    return F.when(site != "", F.array(site)).otherwise(F.array().cast("array<string>"))
