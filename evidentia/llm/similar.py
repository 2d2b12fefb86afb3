"""Near copies: texts whose sets of five-word shingles are alike, every pair of them.

A filter over the sets leaves the texts that can be like another at all. SimHash links among
these, checked on the texts, form groups; a prefix filter in the order of exact frequencies
then finds where texts of unlike groups can still be alike, and these are compared in blocks
out of which only the links of a forest come.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions
from .components import connected_components
from .simhash import MAX_RUN, _signed, links, shingles, simhash_of, words_of

#: Members of sets, both sides together, that a task compares at once; larger blocks are cut up.
BLOCK = 1 << 21
#: Up to here the frequency of a shingle is counted exactly; all more frequent ones are ordered alike.
OFTEN = 1024


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words``."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(words, k)], dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets of hashes; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _digest(words: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def spare(n: int, similarity: float) -> int:
    """How many of its ``n`` members a set can have that a like set lacks."""
    return n - math.ceil(n * similarity - 1e-9)


def needed(n: int, similarity: float) -> int:
    """How many of the first ``spare + needed`` members of a set (in any order that all share) a like set has.

    The first ``needed`` common members stand among these in both sets.
    """
    return max(1, spare(n, similarity) // 2)


def _prints(docs: DataFrame, shingle_words: int, seed: int, set_words: int, similarity: float) -> DataFrame:
    """``doc_id, text_hash, digest, fp, n, prefix``: a hash of the word sequence, the SimHash, the set's size and its smallest members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, fps, sizes, prefixes = [], [], [], []
            for raw in b.column(2):
                words = words_of(raw.as_py())
                digests.append(_digest(words))
                fps.append(_signed(simhash_of(shingles(words, shingle_words), seed)))
                hashes = shingle_set(words, set_words)
                n = len(hashes)
                sizes.append(n)
                prefixes.append(hashes[: spare(n, similarity) + needed(n, similarity)].view(np.int64))
            arrays = [pa.array(digests, pa.string()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["doc_id", "text_hash", "digest", "fp", "n", "prefix"])

    given = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"))
    out = given.withColumns({"digest": F.lit(""), "fp": F.lit(0).cast("long"), "n": F.lit(0), "prefix": F.array(F.lit(0).cast("long"))}).schema
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, out)


def _shared(members: DataFrame) -> DataFrame:
    """``id, times`` of rows ``key, id``: how often a key of the id is another id's, too, summed up later.

    Keys stream past in order; of a key only the last row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids):
            names, times = np.unique(ids, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(times.astype(np.int64))], names=["id", "times"])

        keys, ids, met = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((keys, ids)))
            met = np.append(met, np.zeros(len(ids) - len(met), bool))
            other = (keys[1:] == keys[:-1]) & (ids[1:] != ids[:-1])
            met[1:] |= other
            met[:-1] |= other
            yield out(ids[:-1][met[:-1]])
            keys, ids, met = keys[-1:], ids[-1:], met[-1:]
        yield out(ids[met])

    dealt = members.select("key", "id").repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, "id long, times long")


def _often(members: DataFrame, often: int = OFTEN) -> DataFrame:
    """``id, key, often`` of the rows ``key, id`` whose key several rows have: how many, ``often`` at most.

    At most ``often`` rows of a key are held until that is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, keys, n):
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(n.astype(np.int32))], names=["id", "key", "often"])

        keys, ids, full = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            k, i = (b.column(x).to_numpy(zero_copy_only=False) for x in range(2))
            if full is not None:  # the key is known to be frequent
                same = int(np.searchsorted(k, full, side="right"))
                if same:
                    yield out(i[:same], k[:same], np.full(same, often))
                if same == len(k):
                    continue
                k, i, full = k[same:], i[same:], None
            keys, ids = np.concatenate([keys, k]), np.concatenate([ids, i])
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(starts, len(keys)))
            last = int(n[-1])
            if last >= often:
                full, held = keys[-1], 0
            else:
                n, held = n[:-1], last
            rows = np.repeat(np.minimum(n, often), n)
            several = rows > 1
            done = len(keys) - held
            if several.any():
                yield out(ids[:done][several], keys[:done][several], rows[several])
            keys, ids = keys[done:], ids[done:]
        if len(keys) > 1:
            yield out(ids, keys, np.full(len(keys), len(keys)))

    dealt = members.select("key", "id").repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "id long, key long, often int")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``digest, hashes`` of texts: their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(raw.as_py()) for raw in b.column(0)]
            arrays = [pa.array([_digest(w) for w in words], pa.string()), pa.array([shingle_set(w, k).view(np.int64) for w in words], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["digest", "hashes"])

    return docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "digest string, hashes array<long>")


def _list(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of longs as arrays of unsigned ones, without copies."""
    values, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` whose sets are alike by ``similarity`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(x, y) >= similarity for x, y in zip(_list(batch.column(2)), _list(batch.column(3)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hashes = sets.select("id", "hashes")
    full = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b").where(F.least(F.size("x"), F.size("y")) >= F.lit(similarity) * F.greatest(F.size("x"), F.size("y")))
    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _spare(n: Column, similarity: float) -> Column:
    return (n - F.ceil(n * F.lit(similarity) - F.lit(1e-9))).cast("int")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``id, root, n, key, place`` of ``id, root, n, hashes``: the members that can be a like pair's first common one.

    In the order of frequency, rare ones first, that is one of the first ``spare + 1`` of both
    sets. Members that no other set has come first and are only counted.
    """
    often = _often(sets.select("id", F.explode("hashes").alias("key")))
    known = often.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "key"))).alias("members"))
    own = F.col("n") - F.size("members")
    open_ = known.join(sets.select("id", "root", "n"), "id").withColumn("own", own).withColumn("left", _spare(F.col("n"), similarity) + 1 - F.col("own")).where("left > 0")
    first = open_.select("id", "root", "n", "own", F.posexplode(F.slice("members", F.lit(1), F.col("left"))).alias("at", "member"))
    return first.select("id", "root", "n", F.col("member.key").alias("key"), (F.col("own") + F.col("at")).alias("place"))


def _islands(prefixes: DataFrame, similarity: float) -> DataFrame:
    """Edges ``u, v`` that connect all rows of a key that can be alike and are of unlike groups.

    A set of ``n`` members whose first common one stands at ``place`` has at most
    ``n - place`` in common with another, which bounds the other's size from above. Rows
    of a key in the order of their sizes whose bounds reach on to the next row form a run;
    no row can be like one outside its run. So the edges are as many as the rows, however
    frequent a key.
    """
    share = similarity / (1 + similarity)
    reach = (F.col("n") - F.col("place")) / F.lit(share) - F.col("n") + F.lit(1e-6)
    order = Window.partitionBy("key").orderBy("n", "id")
    before = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = prefixes.withColumn("reach", reach).withColumn("new", F.when(before >= F.col("n"), 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("key", "run")
    edges = runs.select(F.col("id").alias("u"), F.min("id").over(run).alias("v"), F.min("root").over(run).alias("lo"), F.max("root").over(run).alias("hi"))
    return edges.where("lo < hi").select("u", "v")


def forest(sets: list[np.ndarray], sides: np.ndarray, roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what likeness connects among sets, beyond what equal ``roots`` connect already.

    With two ``sides``, only pairs of one and the other are compared.
    """
    n = np.array([len(s) for s in sets])
    names, tree = np.unique(roots, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    by = np.argsort(member, kind="stable")
    holders, counts = owner[by], np.bincount(member)
    begin = np.cumsum(counts) - counts
    at = np.cumsum(n) - n
    two, found = sides.min() != sides.max(), []
    for i in range(len(sets)):
        own = member[at[i] : at[i] + n[i]]
        lens = counts[own]
        flat = np.repeat(begin[own] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        both = np.bincount(holders[flat], minlength=len(sets))
        near = np.flatnonzero(both >= similarity * (n + n[i] - both))
        near = near[(near > i) & ((sides[near] != sides[i]) | (not two))]
        for j in near.tolist():
            a, b = find(tree[i]), find(tree[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def _links_in_blocks(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` among ``id, root, block, hashes``, within each block, as forests.

    A block with more than ``block`` set members is cut by id hash, and each pair of its
    parts is compared by itself, so what a task holds is bounded.
    """
    size = members.groupBy("block").agg(F.ceil(F.sum(F.size("hashes")) / F.lit(block / 2)).cast("int").alias("parts"))
    cut_up = members.join(size.withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts"))), "block").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = cut_up.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "id", "root", "hashes")

    def links_of(t: pa.Table) -> pa.RecordBatch:
        sides = t["part"].to_numpy()
        found = forest(_list(t["hashes"].combine_chunks()), sides, t["root"].to_numpy(), similarity) if len(t) > 1 else []
        ids = t["id"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array([ids[x[i]] for x in found], pa.int64()) for i in range(2)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            if not b.num_rows:
                continue
            names = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(starts, starts[1:]):
                if held and name != tuple(names[s]):
                    yield links_of(pa.Table.from_batches(held))
                    held = []
                name = tuple(names[s])
                held.append(b.slice(s, e - s))
        if held:
            yield links_of(pa.Table.from_batches(held))

    on = ["block", "lo", "hi"]
    return dealt.repartition(partitions(members.sparkSession), *on).sortWithinPartitions(*on, "id").mapInArrow(run, "u long, v long")


def similar_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, set_words: int = 5,
    shingle_words: int = 3, seed: int = 42, radius: int = 3, blocks: int = 6, shared: int = 3, max_run: int = MAX_RUN, block: int = BLOCK,
) -> DataFrame:
    """Groups of near copies: ``doc_id, text_hash, component_id, component_hash``, a row for each row with a doc_id.

    Texts with one sequence of words (ASCII white space, A-Z lower-cased) are one class.
    Classes link when the sets of their ``set_words``-word shingles are alike by
    ``similarity`` or more (Jaccard, on whole texts). ``component_id`` is the smallest doc_id
    reachable over links, the row's own included, and ``component_hash`` tells its row from others of that id. All links count, whatever the edit, up to
    collisions of 64-bit hashes:

    1. Of a set's smallest hashes (three tenths of it, at 0.8) a like set has a third or more.
       Classes of which others have fewer are like no other and play no further part.
    2. The others' SimHash fingerprints (``shingle_words`` words) are linked within ``radius``
       bits by pigeonhole blocks (``simhash.links``), and each link is checked on the sets.
    3. Prefix filter in the order of exact frequencies: two like sets share a member of their
       rarest ones. Where one is shared by classes of unlike groups whose sizes allow
       likeness, these form a block, and blocks are compared whole.

    Nothing grows with the square of a group but the arithmetic inside a block's parts: keys
    yield as many edges as rows, blocks the links of a forest.

    Null, empty and wordless texts are one class. Rows without a doc_id are left out; rows that
    share one each count by their text. Very long texts have large sets, as they are. Other
    columns play no part, whatever their names. An empty table gives an empty result.
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    rows = cut(_prints(given, shingle_words, seed, set_words, similarity), "similar-docs")
    classes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "similar-classes")  # the numbering is fixed once it is written

    firsts = classes.select("digest", F.col("first_id").alias("doc_id"), "id")
    members = rows.select("doc_id", "digest", "prefix").join(firsts, ["doc_id", "digest"]).select("id", F.explode("prefix").alias("key"))
    times = _shared(members).groupBy("id").agg(F.sum("times").alias("times")).join(classes, "id")
    least = F.greatest(F.lit(1), F.floor(_spare(F.col("n"), similarity) / 2))
    open_ = cut(times.where(F.col("times") >= least).drop("times"), "similar-open")
    roots = None
    if not open_.isEmpty():
        texts = given.join(open_.select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        sets = _sets(texts, set_words).join(open_.select("digest", "id", "fp", "n"), "digest").dropDuplicates(["id"])
        sets = cut(sets.select("id", "fp", "n", "hashes"), "similar-sets")

        prints = sets.groupBy("fp").agg(F.min("id").alias("id"))
        at = lambda side, name: prints.select(F.col("fp").alias(side), F.col("id").alias(name))
        pairs = links(cut(prints, "similar-prints").select("fp"), radius, blocks, shared, max_run).select("u", "v").distinct()
        pairs = pairs.join(at("u", "a"), "u").join(at("v", "b"), "v").select("a", "b")
        same = sets.select("id", "fp").join(prints.withColumnRenamed("id", "a"), "fp").where("a <> id").select("a", F.col("id").alias("b"))
        edges = cut(_alike(pairs.unionByName(same), sets, similarity), "similar-edges").toDF("u", "v")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("root"))  # one name only within a group, if not one for it all

        grouped = sets.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        blocks_of = connected_components(_islands(_prefixes(grouped, similarity), similarity), "similar-near").toDF("id", "block")
        more = _links_in_blocks(blocks_of.join(grouped.select("id", "root", "hashes"), "id"), similarity, block)
        roots = connected_components(edges.unionByName(cut(more, "similar-more")), "similar-cc").toDF("id", "root")
        classes = classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    else:
        classes = classes.withColumn("root", F.col("id"))
    named = classes.groupBy("root").agg(F.min("first").alias("first"))
    ids = classes.select("digest", "root").join(named, "root").select("digest", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("component_hash"))
    return rows.select("doc_id", "text_hash", "digest").join(ids, "digest").select("doc_id", "text_hash", "component_id", "component_hash")


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one of the smallest doc_id.

    Rows that share that id and are alike, or are repeated, are one document, too, and the one
    with the smallest text hash stays. Rows without an id stay.
    """
    groups = similar_groups(docs, doc_id, text, **options)
    first = groups.where("doc_id = component_id and text_hash = component_hash").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
    first = cut(first, "similar-first")
    keyed = docs.where(F.col(doc_id).isNotNull()).withColumns({"__id": F.col(doc_id), "__hash": text_hash(F.col(text))})
    once = keyed.join(first.where("n = 1"), ["__id", "__hash"], "left_semi")
    repeated = keyed.join(first.where("n > 1"), ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])  # only these are shuffled
    return once.unionByName(repeated).select(*docs.columns).unionByName(docs.where(F.col(doc_id).isNull()))
