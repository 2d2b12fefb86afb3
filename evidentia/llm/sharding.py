"""Sharding along a Hilbert curve over metadata, so that files can be pruned by any of it.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions

#: Bits of each of the three dimensions.
BITS = 5


def hilbert3(x: Column, y: Column, z: Column, bits: int = BITS) -> Column:
    """Index along the Hilbert curve of a cell of a cube with ``2**bits`` cells a side.

    The transposed form: for each bit from the top, undo the rotations that the bits
    above imply; Gray-code the axes; interleave. Cells next to each other on the curve share
    a face.
    """
    inner = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"))
    top = [1 << b for b in range(bits - 1, 0, -1)]

    def step(axis: str, q: Column, s: Column) -> Column:
        own, first, low = s[axis], s["x"], q - 1
        on = own.bitwiseAND(q) != 0
        moved = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(on, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(moved))
        new_own = F.when(on, own).otherwise(own.bitwiseXOR(moved))
        return F.struct((new_first).alias("x"), *[(new_own if a == axis else s[a]).alias(a) for a in ("y", "z")])

    def first_step(q: Column, s: Column) -> Column:
        on = s["x"].bitwiseAND(q) != 0
        return F.struct(F.when(on, s["x"].bitwiseXOR(q - 1)).otherwise(s["x"]).alias("x"), s["y"].alias("y"), s["z"].alias("z"))

    plan = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(a).alias("a")) for q in top for a in range(3)]) if top else F.array().cast("array<struct<q:int,a:int>>")
    turned = F.aggregate(
        plan, inner, lambda s, p: F.when(p["a"] == 0, first_step(p["q"], s)).when(p["a"] == 1, step("y", p["q"], s)).otherwise(step("z", p["q"], s))
    )
    return F.aggregate(F.array(turned), F.lit(0).cast("long"), lambda _, s: _interleaved(s, bits))


def _interleaved(s: Column, bits: int) -> Column:
    x = s["x"]
    y = s["y"].bitwiseXOR(x)
    z = s["z"].bitwiseXOR(y)
    flip = F.lit(0)
    for b in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(z.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for axis in (x, y, z):
            bit = F.shiftright(axis.bitwiseXOR(flip), b).bitwiseAND(F.lit(1))
            out = out * 2 + bit
    return out


def _first_of_cells(docs: DataFrame, column: str, bits: int) -> list[tuple[int, object]]:
    """(cell, its smallest value) of each of at most ``2**bits`` cells that hold about as many rows each.

    Whole values are ranked, by the counts of the distinct ones: range partitions of these and
    sums by partition, so neither a frequent value nor many values meet in one task.
    """
    spark = docs.sparkSession
    counts = docs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.repartitionByRange(partitions(spark), "value").sortWithinPartitions("value").withColumn("place", F.monotonically_increasing_id())
    counts = cut(counts, "hilbert-values").withColumn("part", F.shiftright("place", 33))  # the numbering is fixed once it is written
    sums = counts.groupBy("part").agg(F.sum("n").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("total"))  # a row for each partition
    ranked = counts.join(F.broadcast(before), "part").withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("place")) - F.col("n"))
    cells = ranked.groupBy(F.floor(F.col("at") * (1 << bits) / F.col("total")).cast("int").alias("cell")).agg(F.min("value").alias("first"))
    return sorted((r.cell, r.first) for r in cells.collect())


def _cell(value: Column, firsts: list[tuple[int, object]]) -> Column:
    """The cell of a value: that of the largest first value not above it; of null 0."""
    table = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(v).alias("first")) for c, v in firsts]) if firsts else F.array().cast("array<struct<cell:int,first:string>>")
    return F.coalesce(F.array_max(F.transform(F.filter(table, lambda c: c["first"] <= value), lambda c: c["cell"])), F.lit(0))


def with_index(docs: DataFrame, text: str, strings: tuple[str, str], bits: int = BITS) -> DataFrame:
    """``docs`` with ``size`` and ``hilbert``: the curve's index of (strings, size).

    Each dimension is cut into cells that hold about as many rows each, in the order of its whole
    values: a frequent value takes the place of several cells, and values that share a
    beginning, however long, are told apart. At most ``2**bits`` first values of each dimension
    reach the driver. Nulls lie in the lowest cell.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = docs.withColumn("size", F.octet_length(body).cast("long") + 1)
    firsts = [_first_of_cells(measured, c, bits) for c in (*strings, "size")]
    return measured.withColumn("hilbert", hilbert3(*[_cell(F.col(c), at) for c, at in zip((*strings, "size"), firsts)], bits))


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", strings: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """A shard and a slot for every row, equally many rows a shard.

    Returns ``doc_id, size, text_crc32, hilbert, shard, slot``. Rows stand in the order of
    their Hilbert index, then of their text's hash (equal texts with equal metadata stand
    together), then of doc_id; each shard is a run of that order, slots count from 0 in
    it, and shards differ by one row at most. ``size`` is the UTF-8 length and 1; a null text
    counts as empty. Null metadata and ids are the lowest values; repeated rows each get a
    slot; an empty table gives an empty result; with fewer rows than shards some are empty.

    The order is made by range partitions over the whole of it, so neither a hot source nor
    a group of copies meets in one task; positions come from counts by partition.
    """
    spark = docs.sparkSession
    rows = with_index(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(strings)]), "text", ("s0", "s1"))
    rows = rows.select("doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), "hilbert", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    order = ("hilbert", "h", "doc_id", "size")
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("h").withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, "hilbert-order")  # the numbering is fixed once it is written
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    total = placed.count()
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + at)
    shard = F.floor(F.expr(f"rank * {shards} div {max(1, total)}")).cast("int")
    start = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - start).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = 16, doc_id: str = "doc_id", **options) -> None:
    """Writes ``docs`` to ``path`` as one folder a shard, rows by slot.

    Rows find their slot by ``doc_id``, which must be unique and not null here.
    """
    placed = assign(docs, shards, doc_id, **options).select(F.col("doc_id").alias(doc_id), "shard", "slot")
    placed = docs.join(placed, doc_id)
    placed.repartitionByRange(max(shards, partitions(docs.sparkSession)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
