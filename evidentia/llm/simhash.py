"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .components import connected_components

BITS = 64
#: Shingles whose bits are counted at once: 64 bytes each.
CHUNK = 1 << 16
#: A run of fingerprints that share a key and exceeds this is split by further blocks.
MAX_RUN = 4096


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A-Z lower-cased, cut at ASCII white space."""
    return raw.lower().split() if raw else []


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Every run of ``k`` words, joined by spaces; of fewer words the whole sequence, of none nothing."""
    if not words:
        return []
    k = min(k, len(words))
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[: len(words) - k])]
    return [line[a:b] for a, b in zip(starts, ends[k - 1 :])]


def simhash(raw: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text, A-Z lower-cased, cut at ASCII white space.

    Every shingle counts as often as it stands there. Fewer words than a shingle has: the
    whole sequence is the one shingle. No words (or null): 0.
    """
    return simhash_of(shingles(words_of(raw), shingle_words), seed)


def simhash_of(parts: list[bytes], seed: int = 42) -> int:
    """64-bit SimHash of shingles, repeats included; of none 0."""
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    n = len(parts)
    for c in range(0, n, CHUNK):
        h = np.array([digest(x, seed) for x in parts[c : c + CHUNK]], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle_words: int = 3) -> DataFrame:
    """``keep`` and ``fp``, the SimHash as a signed long, for every row of ``docs``.

    A null text counts as empty: fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(len(keep))
            fp = np.array([simhash(x.as_py(), shingle_words) for x in raw], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    picked = docs.select(*keep, F.col(text).cast("binary").alias("__raw"))
    schema = picked.drop("__raw").withColumn("fp", F.lit(0).cast("long")).schema
    return picked.mapInArrow(run, schema)


def block_masks(bits: list[int], blocks: int, shared: int) -> list[int]:
    """Masks of every choice of ``shared`` of ``blocks`` blocks that the bit positions form.

    Two fingerprints that differ in at most ``blocks - shared`` of these bits agree on at
    least one mask.
    """
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << p for p in bits[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(x: np.ndarray, radius: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """Links that connect what the Hamming radius connects among distinct fingerprints.

    All close pairs and False while they are few; else a spanning forest and True, so that
    the number of links stays in proportion to ``len(x)``.
    """
    out, found = [], 0
    for i in range(0, len(x) - 1, 128):
        part = x[i : i + 128]
        a, b = np.nonzero(np.bitwise_count(part[:, None] ^ x[None, i + 1 :]) <= radius)
        later = b >= a  # columns begin one row further on
        a, b = a[later], b[later]
        found += len(a)
        if found > 4 * len(x):
            return _spanning(x, radius), True
        if len(a):
            out.append((part[a], x[i + 1 + b]))
    return out, False


def _spanning(x: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """At most ``len(x) - 1`` links from the first fingerprint of each component to the others."""
    rest, out = x, []
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front = np.array([seed], dtype=x.dtype)
        while len(front) and len(rest):
            found = []
            for i in range(0, len(front), 64):
                near = (np.bitwise_count(rest[None, :] ^ front[i : i + 64, None]) <= radius).any(axis=0)
                if near.any():
                    found.append(rest[near])
                    rest = rest[~near]
                if not len(rest):
                    break
            front = np.concatenate(found) if found else rest[:0]
            if len(front):
                out.append((np.full(len(front), seed, dtype=x.dtype), front))
    return out


#: Runs up to this size are compared all at once, each row with the rows after it.
SHORT = 8


def _first_only(u, v, combo, masks: np.ndarray | None):
    """The pairs ``u, v`` that agree on no mask before the one of their ``combo``."""
    if masks is None or not len(u):
        return u, v
    first = (((u ^ v)[:, None] & masks[None, :]) == 0).argmax(axis=1)
    return u[first == combo], v[first == combo]


def _pairs_in_runs(combo, key, fp, radius: int, limit: int | None, masks: np.ndarray | None):
    """Links within runs of equal (combo, key), links of forests, and the rows of runs over ``limit``.

    With ``masks``, a pair is only a link under the first mask on which it agrees.
    """
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (combo[1:] != combo[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(fp)))
    left = np.repeat(np.where(sizes <= SHORT, starts + sizes, 0), sizes) - np.arange(len(fp))  # rows to the end of a short run
    links, forests = [], []
    for d in range(1, SHORT):
        at = np.flatnonzero(left > d)
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        links.append(_first_only(fp[near], fp[near + d], combo[near], masks))
    heavy = np.zeros(len(fp), dtype=bool)
    for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT]):
        if limit and n > limit:
            heavy[s : s + n] = True
        else:
            found, dense = forest(fp[s : s + n], radius)
            if dense:
                forests += found
            else:
                links += [_first_only(u, v, combo[s], masks) for u, v in found]
    return links, forests, heavy


def _link_pass(keyed: DataFrame, radius: int, limit: int | None, masks: np.ndarray | None = None) -> DataFrame:
    """One pass over rows (combo, key, fp) sorted by key: rows (combo, u, v).

    combo -1: a link; -2: a link of a forest that stands for the close pairs of its run. Else the row ``u`` of a run of more than ``limit`` fingerprints under
    that combo, which is to be split further; such runs stream through, unbuffered.
    """
    schema = "combo int, u long, v long"

    def run(batches):
        held: list[tuple] = []
        count, streaming = 0, None

        def emit(links, forests, extra):
            us = [a for a, _ in links + forests] + [extra[1]]
            vs = [b for _, b in links + forests] + [extra[1]]
            cs = [np.full(len(a), -1) for a, _ in links] + [np.full(len(a), -2) for a, _ in forests] + [extra[0]]
            if sum(map(len, us)):
                arrays = [np.concatenate(cs).astype(np.int32), np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["combo", "u", "v"])

        for b in batches:
            c, k, f = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f = f.view(np.uint64)
            if not len(c):
                continue
            if streaming is not None:
                same = (c == streaming[0]) & (k == streaming[1])
                if same.any():
                    yield from emit([], [], (c[same], f[same]))
                if same.all():
                    continue
                c, k, f, streaming = c[~same], k[~same], f[~same], None
            # what is held is the beginning of this batch's first run, or a run before it
            held.append((c, k, f))
            count += len(c)
            c, k, f = (np.concatenate([x[i] for x in held]) for i in range(3))
            tail = (c == c[-1]) & (k == k[-1])
            if not tail.all():
                links, forests, heavy = _pairs_in_runs(c[~tail], k[~tail], f[~tail], radius, limit, masks)
                yield from emit(links, forests, (c[~tail][heavy], f[~tail][heavy]))
            held, count = [(c[tail], k[tail], f[tail])], int(tail.sum())
            if limit and count > limit:
                yield from emit([], [], (c[tail], f[tail]))
                held, count, streaming = [], 0, (c[-1], k[-1])
        if held:
            c, k, f = (np.concatenate([x[i] for x in held]) for i in range(3))
            links, forests, heavy = _pairs_in_runs(c, k, f, radius, limit, masks)
            yield from emit(links, forests, (c[heavy], f[heavy]))

    n = partitions(keyed.sparkSession)
    dealt = keyed.repartition(n, "combo", "key").sortWithinPartitions("combo", "key")
    return dealt.mapInArrow(run, schema)


def links(distinct: DataFrame, radius: int = 3, blocks: int = 6, shared: int = 3, max_run: int = MAX_RUN) -> DataFrame:
    """Links ``u, v, dense`` that connect all fingerprints at most ``radius`` bits apart.

    ``distinct``: one column ``fp``, each value once. ``blocks - shared >= radius``, so by
    the pigeonhole principle a close pair agrees on ``shared`` whole blocks: rows are dealt
    by each choice of blocks and only compared within a key. A key with more than
    ``max_run`` fingerprints is split again by blocks of the bits that its key leaves
    open, twice at most: then at most 2^16 values (of the default setting) share a key.
    Where a key holds many close pairs, links of a spanning forest stand for them, marked
    ``dense``; other pairs are met once a level, under the first key that they share.
    """
    if blocks - shared < radius:
        raise ValueError("blocks - shared must be at least the radius")
    masks = block_masks(list(range(BITS)), blocks, shared)
    rows, found = distinct.select("fp"), []
    combos = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])
    keyed = rows.select("fp", F.explode(combos).alias("k")).select("k.combo", "k.key", "fp")
    for level in range(3):
        first = np.array(masks, dtype=np.uint64) if level == 0 else None
        out = cut(_link_pass(keyed, radius, max_run if level < 2 else None, first), "simhash-links")
        found.append(out.where("combo < 0").select("u", "v", (F.col("combo") == -2).alias("dense")))
        heavy = out.where("combo >= 0")
        if level == 2 or heavy.isEmpty():
            break
        finer = []
        for m in masks:
            open_bits = [p for p in range(BITS) if not m >> p & 1]
            finer.append([m | x for x in block_masks(open_bits, blocks, shared)])
        nested = F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in f]) for f in finer])
        keyed = heavy.select(F.col("u").alias("fp"), "combo", F.posexplode(F.get(nested, F.col("combo"))).alias("i", "mask")).select(
            (F.col("combo") * len(finer[0]) + F.col("i")).cast("int").alias("combo"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
        )
        masks = [x for f in finer for x in f]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = 3, radius: int = 3, blocks: int = 6, shared: int = 3, max_run: int = MAX_RUN
) -> DataFrame:
    """Near-duplicate components of ``docs``: ``doc_id, fp, component_id``, a row for each row.

    Documents link when their SimHash fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest doc_id reachable over links, the document's own
    included (null only if every doc_id there is null). Null and empty texts have
    fingerprint 0 and link like any other; equal texts share a fingerprint and are compared
    once. Other columns of ``docs``, whatever their names, play no part. An empty table
    gives an empty result.
    """
    rows = cut(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle_words=shingle_words), "simhash-docs")
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = cut(connected_components(links(each, radius, blocks, shared, max_run).select("u", "v"), "simhash-cc"), "simhash-roots")
    known = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = known.join(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(linked, "fp").select("doc_id", "fp", "component_id")
