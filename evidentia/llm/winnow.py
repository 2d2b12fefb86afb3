"""Line dedup: winnowed fingerprints of line runs, matched, extended and cut out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A gram is the shortest run of lines from a line on with so many words; every repeated run
#: of lines with so many words is found.
GRAM_WORDS, RUN_WORDS = 25, 50


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hashes (signed) and word counts of the lines that are not blank, white space at their ends aside."""
    hashes, words = [], []
    for line in text.split("\n"):
        if n := len(line.split()):
            h = xxhash.xxh64_intdigest(line.strip())
            hashes.append(h - (1 << 64) if h >> 63 else h)
            words.append(n)
    return hashes, words


def _ends(words: list[int], least: int) -> list[int]:
    """For each line, the last line of the shortest run from it on with ``least`` words, or -1."""
    out, e, total = [], 0, 0
    for s in range(len(words)):
        while total < least and e < len(words):
            total += words[e]
            e += 1
        out.append(e - 1 if total >= least else -1)
        total -= words[s]
    return out


def _hash(hashes: list[int]) -> int:
    h = xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in hashes))
    return h - (1 << 64) if h >> 63 else h


def windows_of(words: list[int], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(first, last line) of the shortest runs with ``run_words`` words from a line on, and up to a line.

    Every line of a run with so many words or more is in one of these that lies whole in the
    run: its own line's shortest run backwards, or else that of the run's first line onwards.
    """
    n = len(words)
    onwards = [(s, e) for s, e in enumerate(_ends(words, run_words)) if e >= 0]
    backwards = [(n - 1 - e, n - 1 - s) for s, e in enumerate(_ends(words[::-1], run_words)) if e >= 0]
    return sorted({*onwards, *backwards})


def winnow(hashes: list[int], words: list[int], gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> dict[int, list[tuple[int, int]]]:
    """Selected grams, each with the windows (hash, first line) that selected it.

    Of the grams that lie whole in a window, the smallest is selected. Both depend on the
    lines of the window alone, so two texts that share a run with ``run_words`` words or more
    share all its windows and select grams that both have.
    """
    gram_end = _ends(words, gram_words)
    grams: dict[int, int] = {}
    chosen: dict[int, list[tuple[int, int]]] = {}
    for s, last in windows_of(words, run_words):
        least = None
        for i in range(s, last + 1):
            if not 0 <= gram_end[i] <= last:
                break
            if i not in grams:
                grams[i] = _hash(hashes[i : gram_end[i] + 1])
            if least is None or grams[i] < least:
                least = grams[i]
        chosen.setdefault(least, []).append((_hash(hashes[s : last + 1]), s))
    return chosen


def extend(own: list[int], other: list[int], at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of lines (first, last) of ``own`` around matched lines (own, other), as long as lines agree."""
    out: set[tuple[int, int, int]] = set()
    for p, q in at:
        if any(a <= p <= b and p - q == d for a, b, d in out):
            continue
        a, b = p, p
        while a and a - p + q > 0 and own[a - 1] == other[a - 1 - p + q]:
            a -= 1
        while b + 1 < len(own) and b + 1 - p + q < len(other) and own[b + 1] == other[b + 1 - p + q]:
            b += 1
        out.add((a, b, p - q))
    return [(a, b) for a, b, _ in out]


def fingerprints(docs: DataFrame, doc_id: str, text: str, gram_words: int, run_words: int) -> DataFrame:
    """``doc_id, key, hashes, grams`` of every row: line hashes, selected grams and their windows."""
    schema = "doc_id long, key binary, hashes array<long>, grams array<struct<gram:long,windows:array<struct<window:long,line:int>>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = pa.struct([("window", pa.int64()), ("line", pa.int32())])
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("windows", pa.list_(window))]))
        for b in batches:
            lines, grams = [], []
            for t in b.column(2):
                hashes, words = line_hashes(t.as_py() or "")
                lines.append(hashes)
                found = winnow(hashes, words, gram_words, run_words)
                grams.append([{"gram": g, "windows": [{"window": w, "line": i} for w, i in ws]} for g, ws in found.items()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int64())), pa.array(grams, kind)], names=["doc_id", "key", "hashes", "grams"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(doc_id, text).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _key(doc_id: str, text: str) -> Column:
    """A name of the row: 128 bits of its id and text, so that rows of unlike texts never meet under one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS, rows_a_lot: int = 4096) -> DataFrame:
    """``key, runs``: of rows with repeated lines, the runs (first, last line) seen before.

    Selected grams that stand but once are passed over. The windows of the others are matched
    with their first occurrence, by doc_id (null first) and line: a combinable minimum,
    however frequent a window. The line hashes of matched rows, not their texts, are then
    laid side by side and the match is extended both ways. A row that is the first of many
    is laid out in as many lots as its matches need.
    """
    rows = cut(fingerprints(docs, doc_id, text, gram_words, run_words), "winnow-lines")
    grams = rows.select("doc_id", "key", F.explode("grams").alias("g")).select("doc_id", "key", "g.gram", "g.windows")
    times = grams.groupBy("gram").agg(F.sum(F.size("windows")).alias("n")).where("n > 1").select("gram")
    windows = grams.join(times, "gram").select("doc_id", "key", F.explode("windows").alias("w")).select("doc_id", "key", "w.window", "w.line")
    windows = cut(windows, "winnow-windows")
    first = cut(windows.groupBy("window").agg(F.min(F.struct("doc_id", "key", "line")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1"), "winnow-first")
    lots = first.groupBy(F.col("f.key").alias("other")).agg(F.ceil(F.sum("n") / F.lit(rows_a_lot)).cast("int").alias("lots"))
    known = first.select("window", F.col("f.key").alias("other"), F.col("f.line").alias("place")).join(lots, "other")
    later = windows.join(known, "window").where("not (key = other and line = place)")
    pairs = later.groupBy("key", "other").agg(F.first("lots").alias("lots"), F.collect_set(F.struct(F.col("line").alias("own"), F.col("place").alias("other"))).alias("at"))
    pairs = pairs.withColumn("lot", F.pmod(F.xxhash64("key"), "lots").cast("int")).drop("lots")
    lines = rows.select("key", "hashes").dropDuplicates(["key"])
    others = lots.join(lines.select(F.col("key").alias("other"), F.col("hashes").alias("other_hashes")), "other").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    beside = cut(pairs, "winnow-pairs").join(lines, "key").join(others, ["other", "lot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for b in batches:
            runs = [[{"first": x, "last": y} for x, y in extend(o.as_py(), f.as_py(), [(m["own"], m["other"]) for m in at.as_py()])] for at, o, f in zip(b.column(1), b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind)], names=["key", "runs"])

    found = beside.select("key", "at", "hashes", "other_hashes").mapInArrow(run, "key binary, runs array<struct<first:int,last:int>>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def without(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the lines of the runs, how many lines are not blank, how many went."""
    gone = {i for r in runs for i in range(r["first"], r["last"] + 1)}
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip():
            if n not in gone:
                kept.append(line)
            n += 1
        else:
            kept.append(line)
    return "\n".join(kept), n, len(gone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` without later repeats of line runs, and ``n_lines, n_removed`` (existing columns of these names go).

    Every run of whole lines with ``run_words`` words or more that stands earlier too (in a
    smaller doc_id, null being smallest, or further up in the same text) goes whole, with
    the lines around it that agree with the first occurrence of a part of it; the first
    occurrence of a line always stays. Blank lines and shorter repeats stay. A text may lose
    all its lines. Null texts stay null with 0 lines; very long texts are read whole; rows
    with the same id and text are one document and treated alike; rows that share an id alone
    stand in the order of a hash of their texts; other columns stay as they are; an empty
    table gives an empty result.
    """
    runs = repeated_runs(docs, doc_id, text, gram_words, run_words)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*names, _key(doc_id, text).alias("__key"))
    joined = keyed.join(runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs")), "__key", "left").select(*names, "__runs")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0, 0) if t.as_py() is None else without(t.as_py(), r.as_py() or []) for t, r in zip(b.column(at), b.column(len(names)))]
            texts, n, gone = zip(*done) if done else ((), (), ())
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])

    out = docs.select(*names).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(run, out)
