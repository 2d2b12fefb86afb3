import math

import numpy as np

from evidentia.llm import rabitq
from pyspark.sql import functions as F


def brute(rows, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 5:
            continue
        scores = []
        for j, w in ok:
            if j != i and len(v) == len(w):
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                scores.append((-total, j))
        for r, (s, j) in enumerate(sorted(scores)[:k]):
            out.setdefault(i, []).append((r + 1, j, -s))
    return out


def search(df, k, **blocks):
    fitted = rabitq.fit(df)
    indexed = rabitq.index(df, fitted)
    got = rabitq.search(indexed.where("vec_id % 5 = 0"), indexed, fitted, k, **blocks)
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 24)) + rng.standard_normal((6, 24))[rng.integers(0, 6, 600)] * 2
    x *= rng.uniform(0.2, 3, (600, 1))
    x[50:150] = x[7]  # a hot vector
    x = x.astype(np.float32).astype(float)
    odd = [(900, None), (905, [0.0] * 24), (910, [float("nan")] * 24), (915, [1.0] * 23 + [None]), (920, [float("inf")] * 24), (925, []), (None, [1.0] * 24), (930, [1.0, 2.0]), (935, [3.0, -1.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = brute(rows, 10)
    for blocks in ({}, {"candidates_per_block": 100, "queries_per_block": 50}):
        got = search(df, 10, **blocks)
        assert got.keys() == want.keys()
        hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
        assert hits >= 0.99 * sum(map(len, want.values()))
        assert sum(got[q] == want[q] for q in want) >= 0.97 * len(want)
    assert got[930] == [(1, 935, 1.0)] and got[905 - 905][0][0] == 1
    assert search(df.limit(0), 10) == {}
    few = df.where(F.col("vec_id") < 4)
    assert search(few, 10) == brute([r for r in rows if r[0] is not None and r[0] < 4], 10)


def test_bound_holds():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((20, 64))
    norm = np.sqrt((x**2).sum(1))
    turn = rabitq.rotation(64)
    bits = turn.shape[1]
    t = (x / norm[:, None]) @ turn
    agree = np.abs(t).sum(1) / np.sqrt(bits)
    estimate = (q @ turn) @ np.sign(t).T / np.sqrt(bits) / agree * norm
    error = norm * np.sqrt(1 - agree**2) / agree / np.sqrt(bits - 1) * rabitq.EPSILON * np.sqrt((q**2).sum(1))[:, None]
    assert (np.abs(estimate - q @ x.T) <= error).mean() > 0.98
