"""SpotSigs fingerprints: chains of content words that follow common words.

DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

#: Common words of English, German, French and Spanish.
ANCHORS = {
    "en": "the of and to a in is that for it was on with be as by this are at from",
    "de": "der die das und in den von zu sich mit auf des für ist nicht im dem ein eine als",
    "fr": "de la le et les des en un du une que pour est qui dans par pas au sur avec",
    "es": "de la que el en y los se del las por un no con su una es para al lo",
}
#: Content words in a chain.
CHAIN = 3
#: Lots of the doc_id order for each shuffle partition.
LOTS = 4
_MARK = "\x01"


def _alternatives(words: set[str]) -> str:
    """A pattern for whole words that tries only those with the right first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by.items()))


def signatures(text: Column, chain: int = CHAIN, anchors: dict[str, str] = ANCHORS, whole: bool = False) -> Column:
    """The text's fingerprint set: sorted distinct 64-bit hashes of its chains.

    Letters and digits make words, lower-cased. Wherever common words (or the start of the
    text) are followed by content words, the next ``chain`` of these, common words between
    them left out, are a chain; at the text's end it may be shorter. A text with words but no
    chain, or with ``whole`` one without a common word, has the hash of all its words; one without words (or null) has the empty set.
    """
    words = set(" ".join(anchors.values()).split())
    common = f" (?:{_alternatives(words)})(?= )"
    link = rf" [^ {_MARK}]+{_MARK}*+"
    runs = rf"{_MARK}++(?=((?:{link}){{1,{chain}}}))"

    def chains(plain: Column) -> Column:
        # a common word becomes a mark, and keeps the space before what follows
        marked = F.concat(F.lit(_MARK), F.regexp_replace(plain, common, _MARK))
        found = F.regexp_extract_all(marked, F.lit(runs), F.lit(1))
        return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.xxhash64(F.translate(c, _MARK, "")))))

    def or_whole(hashed: Column, plain: Column) -> Column:
        every = F.when(F.trim(plain) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(plain)))
        chained = F.size(hashed) > 0
        return F.when(chained & F.rlike(plain, F.lit(common)) if whole else chained, hashed).otherwise(every)

    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return _let(F.regexp_replace(spaced, " {2,}", " "), lambda plain: _let(chains(plain), lambda hashed: or_whole(hashed, plain)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets, 1 for two empty ones.

    The smaller size over the larger bounds it from above: where that is under ``least``
    the sets are not compared and 0 is returned.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small / large < least), F.lit(0.0))
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def as_text(fingerprint: Column) -> Column:
    """A fingerprint set as a string of its numbers in order."""
    return F.array_join(fingerprint.cast("array<string>"), " ")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lots: int = LOTS) -> tuple[DataFrame, Window]:
    """``doc_id, text, lot, turn`` and the window in which the next row is the next document.

    Rows are dealt by cuts of the doc_id (approximate quantiles, ``lots`` for each shuffle
    partition, whatever the number of rows; a lot is sorted, not held) and each lot also gets a copy (``turn`` over 0) of the first document of
    the lot after it, the last lot that of the first. So no task sees the whole order, and
    only one shuffle moves the texts. Ties stand by text; null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    n = lots * partitions(spark)
    cuts = sorted(set(docs.select(F.col(doc_id).cast("long").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    # a binary search in the cuts, through a table of them: the lot is how many lie below
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    lot = F.when(F.col("key") <= F.lit(int(cuts[0])), 0).otherwise(_below(bounds, F.col("key"), len(cuts))) if cuts else F.lit(0)
    keyed = rows.withColumn("key", key).withColumn("lot", lot.cast("int"))
    firsts = cut(keyed.groupBy("lot").agg(F.min("key").alias("first")), "spotsigs-lots")  # a row for each lot
    around = Window.orderBy("lot")
    before = firsts.select("lot", "first", F.lag("lot").over(around).alias("earlier"), F.max("lot").over(Window.partitionBy()).alias("last"))
    given = F.when(F.col("earlier").isNotNull(), F.struct(F.col("earlier").alias("lot"), F.lit(1).alias("turn"))).otherwise(F.struct(F.col("last").alias("lot"), F.lit(2).alias("turn")))
    own = F.struct("lot", F.lit(0).alias("turn"))
    dealt = keyed.join(F.broadcast(before), "lot").withColumn("at", F.explode(F.when(F.col("key") == F.col("first"), F.array(own, given)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "key", "at.lot", "at.turn")
    return dealt, Window.partitionBy("lot").orderBy("turn", "key", "text")


def _below(bounds: Column, key: Column, n: int) -> Column:
    """How many of ``n`` sorted bounds are less than ``key``: a binary search."""
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.coalesce(F.get(bounds, at + s - 1), F.lit((1 << 63) - 1)) < key), at + s).otherwise(at))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lots: int = LOTS, whole: bool = False) -> DataFrame:
    """Fingerprints of every document and of its edited text, held against each other.

    The edited text has, for the last quarter of its code points (rounded down), as many from
    the start of the next document in ascending doc_id (or all of it, if shorter); after the
    last comes the first. Returns ``doc_id, n_chars, edited, fingerprint,
    edited_fingerprint, near_edited, near_next``; the last two are Jaccard likeness of the
    document's set to that of its edited text and of the next document. A null text counts as
    empty, and two texts without words are alike (1.0). A single document is its own next
    one; rows with equal ids stand in the order of their texts; an empty table gives an
    empty result.
    """
    rows, order = in_order(docs, doc_id, text, lots)
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("fingerprint", signatures(F.col("text"), whole=whole))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("turn = 0")
    n = F.length("text")
    swapped = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - swapped), F.substring(F.col("next_text"), F.lit(1), swapped))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.withColumn("edited_fingerprint", signatures(F.col("edited"), whole=whole))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership ``doc_id, class_id`` and links ``a, b, likeness`` between classes.

    A class is the documents with one fingerprint, named by its smallest doc_id (null ids
    belong to classes but name none). Links are all pairs of classes whose sets are alike
    by ``least`` or more. Sets are partitioned by length: likeness is at most the shorter
    length over the longer, so a set meets only its own partition and the next longer one.
    Within these an index holds each set under the rarest signatures that it cannot miss
    in a match, and what meets there is compared. Texts without words link to nothing.
    """
    prints = docs.select(F.col(doc_id).cast("long").alias("doc_id"), signatures(F.col(text), whole=whole).alias("sigs"))
    prints = cut(prints.withColumn("print_id", F.xxhash64("sigs")), "spotsigs-prints")
    named = prints.groupBy("print_id", "sigs").agg(F.min("doc_id").alias("class_id"))
    named = cut(named.where("class_id is not null"), "spotsigs-classes")
    members = prints.join(named.select("print_id", "sigs", "class_id"), ["print_id", "sigs"]).select("doc_id", "class_id")
    sig = named.where(F.size("sigs") > 0).select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = sig.groupBy("sig").count()
    ranked = sig.join(counts, "sig").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("rare"))
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(least) + 1e-12)).cast("int")
    indexed = ranked.select("class_id", "n", part.alias("part"), F.explode(F.slice("rare", F.lit(1), kept)).alias("r")).select("class_id", "n", "part", F.col("r.sig").alias("sig"))
    longer = indexed.select(F.col("class_id").alias("b"), F.col("n").alias("m"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "sig")
    met = indexed.withColumnRenamed("class_id", "a").join(longer, ["part", "sig"]).where("(n < m or n = m and a < b) and n >= m * %r - 1e-9" % least)
    met = met.select("a", "b").distinct()
    sets = named.select("class_id", "sigs")
    pairs = met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    alike = pairs.withColumn("likeness", likeness(F.col("sa"), F.col("sb"), least)).where(F.col("likeness") >= least)
    return members, alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
