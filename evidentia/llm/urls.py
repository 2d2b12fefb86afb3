"""URL filters: host and path rules, and association rules mined from the URLs they label.

DataFrame operations only: Spark's FP-growth mines token combinations, an inverted index
matches them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The production rules: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Share of the labelled URLs that a token combination must be in, and of those with it that
#: must have the verdict. Both hold for tables of any size.
SUPPORT, CONFIDENCE = 0.02, 0.8


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What stands between the host and ``? #`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, path segments, query names, a fragment."""
    tagged = lambda tag, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(f"{tag}:"), x))
    at = F.instr(url, "://")
    scheme = F.when(at > 0, F.array(F.concat(F.lit("s:"), F.substring(url, 1, at - 1)))).otherwise(F.array().cast("array<string>"))
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    fragment = F.when(F.contains(url, F.lit("#")), F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    ending = F.array(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return F.array_distinct(F.coalesce(F.concat(scheme, tagged("h", F.split(host, r"\.")), tagged("p", F.split(path, "/")), tagged("e", ending), tagged("q", names), fragment), F.array().cast("array<string>")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules ``antecedent, verdict, confidence, support, key`` of labelled token sets.

    ``labelled``: ``tokens`` (distinct strings) and ``verdict``. A rule with its verdict is in
    at least ``support`` of the rows and has the verdict in ``confidence`` of those with its
    tokens; a rule with a shorter one inside that has the same verdict and no less confidence
    is pruned. ``key`` is its rarest token, under which the index holds it. How many rules
    there are depends on ``support``, not on the number of rows. No rows: no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double, key string")
    if labelled.isEmpty():
        return empty
    mark = "verdict:"
    items = labelled.select(F.array_append("tokens", F.concat(F.lit(mark), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(mark)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(mark))))
    rules = cut(rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(mark) + 1, 99).alias("verdict"), "confidence", "support"), "url-rules")
    parts = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t"))
    # a rule that lies inside another shares a token with it; both sides are mined rules
    inner = rules.select(F.col("antecedent").alias("small"), "verdict", F.col("confidence").alias("c"), F.explode("antecedent").alias("t"))
    beaten = parts.join(inner, ["t", "verdict"]).where((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
    kept = rules.join(beaten.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    rarest = kept.select("antecedent", F.explode("antecedent").alias("t")).distinct().join(counts, "t").groupBy("antecedent").agg(F.min_by("t", F.struct("freq", "t")).alias("key"))
    return cut(kept.join(rarest, "antecedent").select("antecedent", "verdict", "confidence", "support", "key"), "url-index")


def match(urls: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """The best mined rule of each URL: ``key, mined`` (antecedent, verdict, confidence).

    ``urls`` has ``key`` and ``tokens``. Tokens meet the rules whose rarest token they are,
    and the rest of such a rule is then looked up; most confidence wins, then support, then
    the longer rule, then ``block``.
    """
    tokenised = urls.select(key, "tokens", F.explode("tokens").alias("key_token"))
    held = tokenised.join(rules, tokenised["key_token"] == rules["key"]).where(F.size(F.array_except("antecedent", "tokens")) == 0)
    worth = F.struct("confidence", "support", F.size("antecedent"), F.col("verdict") == "block", F.array_join("antecedent", " "))
    return held.groupBy(key).agg(F.max_by(F.struct("antecedent", "verdict", "confidence"), worth).alias("mined"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """A verdict for each row: ``page_id, host, path, rule, verdict, mined``.

    The longest rule that fits decides. URLs that a rule decides are the labels from which
    token combinations are mined; they judge the others, and where no combination fits
    the verdict is ``default``. Equal token sets are matched once, however many rows have
    them. Null URLs and those without ``://`` have an empty host and path and fit no rule;
    repeated rows and null ids are each judged; an empty table gives an empty result.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("ruled"), F.array_sort(tokens(F.col("url"), F.col("host"), F.col("path"))).alias("tokens"))
    rows = cut(rows.select("page_id", "host", "path", "ruled", "tokens"), "url-tokens")
    mined = mine(rows.where("ruled is not null").select("tokens", F.col("ruled.verdict").alias("verdict")), support, confidence)
    others = rows.where("ruled is null").withColumn("set_of", F.array_join("tokens", "\n"))
    best = match(others.select("set_of", "tokens").dropDuplicates(["set_of"]), mined, "set_of")
    ruled = rows.where("ruled is not null").withColumn("mined", F.lit(None).cast(best.schema["mined"].dataType))
    joined = others.join(best, "set_of", "left").drop("set_of").unionByName(ruled)
    verdict = F.coalesce(F.col("ruled.verdict"), F.col("mined.verdict"), F.lit(default))
    return joined.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), F.array_join("mined.antecedent", " ").alias("mined"))
