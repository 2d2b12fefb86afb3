import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from evidentia.llm import simhash
from evidentia.llm.components import connected_components
from pyspark.sql import functions as F


def plain(text, k=3):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


TEXTS = ["", None, "a", "A b", "one two three", "ONE two three", "É a\x1cb \x0b c d", "x " * 3000, "one two three four five", "one  two\tthree four five", "one two three four six"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.simhash(text.encode() if text is not None else None) == plain(text)


@pytest.mark.parametrize("max_run", [4096, 3])
def test_links_against_all_pairs(spark, max_run):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    centre = rnd.getrandbits(64)
    for f in [*list(fps)[:40], *[centre] * 60]:
        for _ in range(rnd.randrange(1, 7)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps, key=simhash._signed)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for radius, blocks, shared in ((3, 6, 3), (6, 8, 2))[: 1 if max_run == 3 else 2]:
        roots = {r.node: r.root for r in connected_components(simhash.links(df, radius, blocks, shared, max_run)).collect()}
        got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
        want = [simhash._signed(fps[i]) for i in classes(fps, radius)]
        assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark):
    rows = [(10 - i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "one two three", "x", "y"), (3, "", "x", "y"), (3, "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = simhash.near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    fps = [plain(r[1]) for r in rows]
    cls = classes(fps, 3)
    first = {}
    for c, r in zip(cls, rows):
        if r[0] is not None:
            first[c] = min(r[0], first.get(c, 99))
    want = sorted((str(r[0]), simhash._signed(f), first[c]) for r, f, c in zip(rows, fps, cls))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_hash_is_sparks(spark):
    for s in ("", "a b c", "é" * 50):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] == simhash._signed(xxhash.xxh64_intdigest(s.encode(), 42))


def test_forest_is_linear():
    x = np.arange(256, dtype=np.uint64)
    links, dense = simhash.forest(x, 3)
    assert dense
    assert sum(len(a) for a, _ in links) == 255
