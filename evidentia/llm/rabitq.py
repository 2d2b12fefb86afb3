"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's residual from its centre is rotated at random, into ``EXPAND`` times its dimensions,
and kept as one sign bit for each of these, with its length and its agreement with its own signs. From these an unbiased
estimate of an inner product and an error bound follow; only vectors whose bound lets them
be among the nearest are scored on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates, and of queries: what one task holds.
CANDIDATES, QUERIES = 8192, 4096
#: Bits of a code for each component: vectors are rotated into so many times their dimensions.
EXPAND = 4
#: Width of the error bound in units of its scale: at 2.5 it fails for about 1 in 100 vectors
#: that are near the edge, far less than the recall asked for.
EPSILON = 2.5
#: Rows that centres are fitted on (those with the smallest id hashes), and their number.
SAMPLE, CENTRES = 4096, 16
#: Pairs (query, candidate) whose exact scores are computed at once.
EXACT = 1 << 19


def rotation(dim: int, expand: int = EXPAND, seed: int = 11) -> np.ndarray:
    """A random rotation of ``dim`` dimensions into ``expand`` times as many, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim * expand, dim)))
    return (q * np.sign(np.diag(r))).T


def centres(x: np.ndarray, k: int = CENTRES, rounds: int = 8) -> np.ndarray:
    """k-means centres, begun from evenly spread rows of ``x``."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, c)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = x[own == i].mean(axis=0)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor zero and holds finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Centres by dimension, from at most ``sample`` rows."""
    rows = usable(vectors, vector).select(F.xxhash64(vec_id).alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.v), []).append(r.v)
    return {d: centres(np.array(v)) for d, v in by.items()}


def index(vectors: DataFrame, fitted: dict[int, np.ndarray], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Codes of every usable row: ``vec_id, vector, centre, code, norm, agreement``.

    ``code`` has the packed sign bits of the rotated residual from the nearest centre,
    ``norm`` the residual's length, ``agreement`` the inner product of its direction with
    that of its signs. A dimension that the sample lacks has the origin as its centre.
    """
    names = ["vec_id", "vector", "centre", "code", "norm", "agreement"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = lists.take(pa.array(at))
                x = own.flatten().to_numpy().reshape(-1, d)
                c = fitted.get(int(d), np.zeros((1, d)))
                near = nearest_centre(x, c)
                rest = x - c[near]
                norm = np.sqrt((rest**2).sum(axis=1))
                turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ rotation(int(d))
                bits = turned > 0
                agreement = np.where(norm > 0, np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), 1.0)
                codes = [row.tobytes() for row in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), own, pa.array(near.astype(np.int32)), pa.array(codes, pa.binary()), pa.array(norm), pa.array(agreement)], names=names)

    picked = usable(vectors, vector).select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>")).where(F.col(vec_id).isNotNull())
    return picked.mapInArrow(run, "vec_id long, vector array<double>, centre int, code binary, norm double, agreement double")


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of the components.

    The order is fixed, so equal vectors score equally wherever they stand.
    """
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * x[:, d]
    return total


def _matrix(t: pa.Table, name: str, d: int) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy().reshape(-1, d)


def _nearest_in_block(q_ids, q, x_ids, x, centre, codes, norm, agreement, c, k, epsilon):
    """(query position, candidate position, score) of each query's ``k`` nearest of the block.

    The best by estimate are scored first; their ``k``-th score is the bar that another
    candidate's upper bound must reach for it to be scored, too.
    """
    d = q.shape[1]
    turn = rotation(d)
    bits = turn.shape[1]
    signs = np.unpackbits(np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -1), axis=1, count=bits).astype(np.float32) * 2 - 1
    scale = (norm / (agreement * np.sqrt(bits))).astype(np.float32)
    error = (norm * np.sqrt(np.maximum(0, 1 - agreement**2)) / agreement / np.sqrt(max(1, bits - 1)) * epsilon).astype(np.float32)
    turned, base = (q @ turn).astype(np.float32), (q @ c.T).astype(np.float32)
    length = np.sqrt((q**2).sum(axis=1)).astype(np.float32)
    signs, first = signs.T, min(4 * k, len(x_ids))

    def scored(rows, columns):
        parts = [exact(q[rows[i : i + EXACT]], x[columns[i : i + EXACT]]) for i in range(0, len(rows), EXACT)]
        return np.concatenate(parts) if parts else np.zeros(0)

    for lo in range(0, len(q), 256):
        estimate = (turned[lo : lo + 256] @ signs) * scale + base[lo : lo + 256][:, centre]
        own = q_ids[lo : lo + 256, None] == x_ids[None, :]
        estimate[own] = -np.inf
        best = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
        at = np.repeat(np.arange(len(estimate)), first)
        score = scored(lo + at, best.ravel()).reshape(-1, first)
        score[np.take_along_axis(own, best, axis=1)] = -np.inf
        bar = -np.partition(-score, k - 1, axis=1)[:, k - 1] if first >= k else np.full(len(score), -np.inf)
        bar = bar - 1e-5 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))  # single precision of the estimates
        estimate += length[lo : lo + 256, None] * error
        reach = (estimate >= bar.astype(np.float32)[:, None]) & ~own
        np.put_along_axis(reach, best, np.take_along_axis(~own, best, axis=1), axis=1)
        rows, columns = np.nonzero(reach)
        score = scored(lo + rows, columns)
        order = np.lexsort((x_ids[columns], -score, rows))
        rows, columns, score = rows[order], columns[order], score[order]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        yield lo + rows[top], columns[top], score[top]


def search(queries: DataFrame, indexed: DataFrame, fitted: dict[int, np.ndarray], k: int = 20, epsilon: float = EPSILON, candidates_per_block: int = CANDIDATES, queries_per_block: int = QUERIES) -> DataFrame:
    """Each query's ``k`` nearest: ``query_id, rank, vec_id, score``, largest inner product first.

    ``queries`` has ``vec_id, vector`` like ``indexed``, whose rows are the candidates; a
    candidate of the query's own id, or of another dimension, is none of its. Ties go to the
    smaller vec_id. Both sides are dealt by id hash into blocks of bounded size, and each
    pair of blocks is one group: estimates from the codes choose what the group scores on
    the original components, and only ``k`` a query leave it. A query with fewer candidates
    has them all; one with none has no row; empty tables give an empty result; each repeated
    row is a candidate of its own.
    """
    n, m = indexed.count(), queries.count()
    spark = indexed.sparkSession
    across, down = max(1, -(-n // candidates_per_block)), max(1, -(-m // queries_per_block))
    lots = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    block = lambda size: F.pmod(F.xxhash64("vec_id"), F.lit(size)).cast("int")
    left = queries.select(F.col("vec_id").alias("query_id"), "vector", block(down).alias("down"), lots(across).alias("across"))
    right = indexed.withColumn("across", block(across)).withColumn("down", lots(down))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and x.num_rows:
            dims_q, dims_x = (np.diff(t["vector"].combine_chunks().offsets.to_numpy()) for t in (q, x))
            for d in np.intersect1d(dims_q, dims_x):
                qs, xs = q.filter(pa.array(dims_q == d)), x.filter(pa.array(dims_x == d))
                q_ids, x_ids = qs["query_id"].to_numpy(), xs["vec_id"].to_numpy()
                c = fitted.get(int(d), np.zeros((1, d)))
                for i, j, s in _nearest_in_block(q_ids, _matrix(qs, "vector", d), x_ids, _matrix(xs, "vector", d), xs["centre"].to_numpy(), xs["code"].to_pylist(), xs["norm"].to_numpy(), xs["agreement"].to_numpy(), c, k, epsilon):
                    out.append((q_ids[i], x_ids[j], s))
        return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    found = left.groupBy("down", "across").cogroup(right.groupBy("down", "across")).applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
