"""Contamination of evaluation texts by examples: equal, contained, sharing a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm.common import cut

WINDOW, STEP = 50, 5
#: Characters of an example that containment is looked up by.
LEAST = 30


def normalised(text: Column) -> Column:
    """Single spaces, no sentence marks at the end, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[.,;:!? ]+$", ""))


def exact(examples: DataFrame, evals: DataFrame) -> DataFrame:
    """Pairs (example_id, eval_id) of equal normalised texts."""
    a = examples.select("example_id", normalised(F.col("text")).alias("t"))
    return a.join(evals.select("eval_id", normalised(F.col("text")).alias("t")), "t").where("t <> ''").select("example_id", "eval_id")


#: Characters of a text whose windows are made at once.
CHUNK = 4096


def _shingles(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, at, w``: every window of ``size`` characters of a text, and where it starts.

    Texts are first cut into overlapping chunks, so a row's windows are bounded whatever the
    text's length, and a chunk's windows come from one pass over it.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - size, F.lit(0)), F.lit(CHUNK))
    chunks = rows.where(F.length(text) >= size).select(key, text, F.explode(starts).alias("from"))
    chunks = chunks.select(key, "from", F.substring(F.col(text), F.col("from") + 1, F.lit(CHUNK + size - 1)).alias("c"))
    windows = F.regexp_extract_all("c", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))
    return chunks.select(key, "from", F.posexplode(windows).alias("i", "w")).select(key, (F.col("from") + F.col("i")).alias("at"), "w")


def _unmatched(examples: DataFrame, evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(example_id, t) of examples that no evaluation text equals, and (eval_id, u), normalised."""
    a = examples.select("example_id", normalised(F.col("text")).alias("t"))
    b = evals.select("eval_id", normalised(F.col("text")).alias("u")).where("u <> ''")
    return a.join(b.select(F.col("u").alias("t")), "t", "left_anti"), b


def contained(examples: DataFrame, evals: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs of an example of ``least`` characters or more and an evaluation text, of which one stands in the other.

    A contained text is looked up by the hash of its first ``least`` bytes, a shorter one by that
    of all, among the hashes of the other side's windows. Each side is read against a filter of
    fixed size made from the other's hashes, so only what may meet is written, joined and then
    compared in full. Runs when called. Examples that some evaluation text equals are reported by
    ``exact`` alone.
    """
    spark = examples.sparkSession
    share = spark.sparkContext.broadcast
    a = examples.select("example_id", normalised(F.col("text")).alias("t")).where(F.length("t") >= least)
    b = evals.select("eval_id", normalised(F.col("text")).alias("u")).where("u <> ''")
    heads = _hashes(a, "example_id", "t", [(INSIDE, "head", least, None)])
    windows = _hashes(a, "example_id", "t", [(AROUND, "windows", least, None)])
    asked = cut(_hashes(b, "eval_id", "u", [(INSIDE, "windows", least, share(_bits(heads))), (AROUND, "head", least, share(_bits(windows))), (SHORT, "whole", least, None)]), "contained-asked")
    short = asked.where(F.col("kind") == SHORT)
    sizes = sorted(n for (n,) in short.select("size").distinct().collect())  # fewer than ``least`` numbers
    found = [(AROUND, "windows", least, share(_bits(asked.where(F.col("kind") == AROUND))))]
    if sizes:
        bits = share(_bits(short))
        found += [(SHORT, "windows", n, bits) for n in sizes]
    known = heads.unionByName(_hashes(a, "example_id", "t", found))
    met = cut(known.join(asked, ["kind", "size", "h"]).select("example_id", "eval_id").distinct(), "contained-met")
    met = F.broadcast(met) if met.count() <= FEW else met.hint("merge")
    told = evals.join(met, "eval_id").select("example_id", "eval_id", normalised(F.col("text")).alias("u")).join(a, "example_id")
    told = told.select("example_id", "eval_id", F.sha2("t", 256).alias("of"), (F.col("t") == F.col("u")).alias("same"), (F.contains("u", F.col("t")) | F.contains("t", F.col("u"))).alias("inside"))
    told = cut(told.where("inside"), "contained-told")
    return told.where("not same").join(told.where("same").select("of"), "of", "left_anti").select("example_id", "eval_id").distinct()


#: Kinds of hashes that can meet: an example in an evaluation text, the other way round, a text shorter than a window.
INSIDE, AROUND, SHORT = 0, 1, 2
#: Pairs of ids that are broadcast rather than joined by sorting.
FEW = 1 << 16
#: Filters have at most two to this power bits.
BITS = 26
#: Bytes whose windows are hashed at once.
BLOCK = 1 << 16
_ODD = 0x9E3779B97F4A7C15
#: Powers of an odd number and of its inverse, modulo 2 ** 64.
_UP, _DOWN = (np.cumprod(np.r_[np.uint64(1), np.full(BLOCK + 4096, x, np.uint64)]) for x in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)))


def _mixed(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every window of ``size`` of some bytes, ``BLOCK`` windows at most."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * _DOWN[: n + 1 - size] + np.uint64(size * _ODD % (1 << 64))
    for shift, times in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(times)
    return h ^ (h >> np.uint64(32))


def _may(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter may have: all that are in it, and a few others."""
    last = np.uint64(len(bits) * 8 - 1)
    has = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    at = np.flatnonzero(has(h & last))
    return at[has((h[at] >> np.uint64(32)) & last) == 1]


def _bits(hashes: DataFrame) -> np.ndarray:
    """A filter of the hashes, two bits each: as long as they are few, 1,000 bits for each."""
    place = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32)))
    words = hashes.select(place.alias("p")).select(F.expr(f"(p & {(1 << BITS) - 1}L) div 64").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    size = 1 << min(max(16, (1000 * max(got.num_rows, 1)).bit_length()), BITS)
    out = np.zeros(size // 64, np.uint64)
    np.bitwise_or.at(out, got["w"].to_numpy() & (len(out) - 1), got["bits"].to_numpy().view(np.uint64))
    return out.view(np.uint8)


def _hashes(rows: DataFrame, key: str, text: str, wanted: list[tuple]) -> DataFrame:
    """``key, kind, size, h``: hashes of texts' windows of ``size`` bytes, or of the first alone, or of whole texts that are shorter.

    ``wanted`` has a kind, which of these, a size and a broadcast filter, or None where all are wanted, for each.
    """

    def of(data: np.ndarray, ends: np.ndarray, what: str, size: int, bits: np.ndarray | None) -> Iterator[tuple]:
        starts, n = ends[:-1], np.diff(ends)
        if what == "windows":
            for lo in range(int(ends[0]), int(ends[-1]) - size + 1, BLOCK):
                h = _mixed(data[lo : min(lo + BLOCK + size - 1, int(ends[-1]))], size)
                at = np.arange(len(h)) if bits is None else _may(h, bits)
                row = np.searchsorted(ends, lo + at, side="right") - 1
                good = lo + at + size <= ends[row + 1]
                yield row[good], np.full(good.sum(), size), h[at[good]]
            return
        for m in [size] if what == "head" else range(1, size):
            row = np.flatnonzero(n >= m if what == "head" else n == m)
            for k in range(0, len(row), BLOCK // size):
                own = row[k : k + BLOCK // size]
                h = _mixed(data[starts[own][:, None] + np.arange(m)].ravel(), m)[::m]
                at = np.arange(len(h)) if bits is None else _may(h, bits)
                yield own[at], np.full(len(at), m), h[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            if not b.num_rows:
                continue
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            for kind, what, size, bits in wanted:
                for row, sizes, h in of(data, ends, what, size, bits.value if bits else None):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.full(len(row), kind, np.int32)), pa.array(sizes.astype(np.int32)), pa.array(h.view(np.int64))], names=[key, "kind", "size", "h"])

    schema = f"{key} {dict(rows.dtypes)[key]}, kind int, size int, h long"
    return rows.select(key, text).mapInArrow(run, schema).distinct()


def shared_windows(examples: DataFrame, evals: DataFrame, size: int = WINDOW, step: int = STEP) -> DataFrame:
    """Pairs of which a window of the example (every ``step`` characters) stands in the evaluation text.

    Examples that some evaluation text equals are reported by ``exact`` alone.
    """
    a, b = _unmatched(examples, evals)
    a, b = a.where(F.length("t") >= size), b.where(F.length("u") >= size)
    probes = _shingles(a, "example_id", "t", size).where(F.col("at") % step == 0).select("example_id", "w").distinct().withColumn("k", F.xxhash64("w"))
    shingles = _shingles(b, "eval_id", "u", size).select("eval_id", F.xxhash64("w").alias("k"))
    met = probes.join(shingles, "k").select("example_id", "eval_id", "w").distinct()
    return met.join(b, "eval_id").where(F.contains("u", F.col("w"))).select("example_id", "eval_id").distinct()


def same_pair(examples: DataFrame, evals: DataFrame) -> DataFrame:
    """Pairs about the same two entities (columns a, b), in either order and case."""
    pair = F.array_sort(F.array(F.lower("a"), F.lower("b")))
    return examples.withColumn("p", pair).select("example_id", "p").join(evals.withColumn("p", pair).select("eval_id", "p"), "p").select("example_id", "eval_id")


def prompt_examples(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Example sentences quoted in prompts, a row each."""
    found = F.regexp_extract_all(F.col(text), F.lit(r'(?:Sentence|Evidence|Text):\s*"([^"]+)"'), F.lit(1))
    return prompts.select("*", F.posexplode(found).alias("position", "example"))
