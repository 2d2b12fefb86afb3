import zlib

from evidentia.llm import sharding
from pyspark.sql import functions as F


def test_curve_steps_to_neighbours(spark):
    n = 8
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n % n).alias("y"), F.floor(F.col("id") / n**2).alias("z"))
    got = cells.select("x", "y", "z", sharding.hilbert3(F.col("x"), F.col("y"), F.col("z"), 3).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(n**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(got, got[1:]))


def test_shards(spark):
    texts = [f"text {i} " + "é" * (i * 7 % 50) for i in range(90)] + ["hot"] * 45 + [None, ""]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}", 1, "x") for i, t in enumerate(texts)] + [(None, "x", "en", "src1", 1, "x"), (3, "y", "en", "src1", 1, "x"), (3, "y", "en", "src1", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, size string")
    got = sharding.assign(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(key((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(key((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for s in range(16):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        for r in sorted(by[s], key=lambda r: r.slot):
            assert r.hilbert >= last
            last = r.hilbert
    assert sharding.assign(df.limit(0)).count() == 0
    assert {(r.shard, r.slot) for r in sharding.assign(df.limit(3)).collect()} == {(0, 0), (5, 0), (10, 0)}


def test_files_are_pruned(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int"))).alias("text"), F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr"])), (F.col("id") % 4 + 1).cast("int")).alias("lang"), F.concat(F.lit("src"), F.floor(F.col("id") / 4) % 10).alias("source"))
    sharding.write(df, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 4000 and back.select("doc_id").distinct().count() == 4000
    touched = lambda c, v: back.where(F.col(c) == v).select("shard").distinct().count()
    assert touched("lang", "de") <= 9 and touched("source", "src3") <= 13


def test_sources_that_begin_alike(spark):
    rows = [(i, "t" * (i % 11), "en", f"https://host.example/{i % 8}/" + "x" * 3000) for i in range(800)] + [(800 + i, "é" * 200_000, None, None) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.with_index(df, "text", ("lang", "source")).select("source", "size", "hilbert").collect()
    by = {}
    for r in got:
        by.setdefault(r.source, set()).add(r.hilbert)
    assert len(by) == 9 and all(not a & b for i, a in by.items() for j, b in by.items() if i != j)
    assert max(r.size for r in got) == 400_001


def test_curve_of_the_query(spark):
    n = 2**sharding.BITS
    cells = spark.range(n**3).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n % n).alias("y"), F.floor(F.col("id") / n**2).alias("z"))
    got = cells.select("x", "y", "z", sharding.hilbert3(F.col("x"), F.col("y"), F.col("z")).alias("h")).orderBy("h").collect()
    assert [r.h for r in got] == list(range(n**3))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) == 1 for a, b in zip(got, got[1:]))


def test_cells_hold_about_as_many_rows(spark):
    df = spark.range(4000).select(F.concat(F.lit("same beginning "), F.lpad((F.col("id") * 7 % 1000).cast("string"), 4, "0")).alias("c"))
    firsts = sharding._first_of_cells(df, "c", 3)
    assert [c for c, _ in firsts] == list(range(8))
    counts = {r.cell: r["count"] for r in df.groupBy(sharding._cell(F.col("c"), firsts).alias("cell")).count().collect()}
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 8
