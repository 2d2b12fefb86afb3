"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex16(n: Column) -> Column:
    """A signed 64-bit number as 16 hex digits, two's complement."""
    return F.lpad(F.lower(F.hex(n)), 16, "0")


def short_sha(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of parts joined by ``|``; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def lookup(key: Column, table: dict[str, float], default: Column | float | None = None) -> Column:
    """A value of a fixed table; null (or ``default``) for keys it lacks."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), key), F.lit(default) if not isinstance(default, Column) else default)


def json_text(doc: Column, path: str) -> Column:
    """A JSON path as text; a JSON null is a null."""
    return F.get_json_object(doc, path)


def json_number(doc: Column, path: str) -> Column:
    return json_text(doc, path).try_cast("double")


def vote(probe: Column, answer: Column) -> Column:
    """The signed vote of a probe's answer, -1 to 1; unknown answers and abstention are 0."""
    # Votes by answer.
    role = {"present_as_mediator": 0.3, "present_as_decoy": -0.5, "absent": -1.0}
    subject = role | {"present_as_subject": 1.0, "present_as_object": -1.0}
    obj = role | {"present_as_object": 1.0, "present_as_subject": -1.0}
    axis = {"direct_sign_match": 1.0, "via_mediator": 0.5, "via_mediator_partial": 0.2, "direct_sign_mismatch": -1.0, "direct_axis_mismatch": -0.7, "direct_partner_mismatch": -0.7, "no_relation": -1.0}
    scope = {"asserted": 1.0, "hedged": -0.3, "negated": -1.0}
    by = {"subject_role": subject, "object_role": obj, "relation_axis": axis, "scope": scope}
    out = F.lit(0.0)
    for name, table in by.items():
        out = F.when(probe == name, lookup(answer, table, 0.0)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def confidence_weight(confidence: Column) -> Column:
    # Weights by confidence.
    return lookup(confidence, {"high": 1.0, "medium": 0.7, "low": 0.4}, 0.0)


def role_order(role: Column) -> Column:
    """Where an agent's role stands in a listing."""
    return F.when(role.isin("subj", "enz"), 0).when(role.isin("obj", "sub"), 1).when(role == "member", 2).otherwise(3)


def belief_class(x: Column) -> Column:
    return F.when(x >= 0.7, "high").when(x <= 0.3, "low").when(x.isNotNull(), "mid")


def belief_phrase(x: Column) -> Column:
    return (
        F.when(x.isNull(), "not scored").when(x >= 0.85, "strongly supported").when(x >= 0.7, "supported")
        .when(x >= 0.5, "leaning supported").when(x >= 0.3, "leaning unsupported").otherwise("unsupported")
    )
