"""Quality of documents from a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are learnt from, at most, and their lines.
SAMPLE, LINES = 4000, 200_000
#: A document is good from this score on.
GOOD = 0.7

#: Bytes by class: upper, lower, digit, space, sentence marks, bars, exclamation marks, other signs.
_CLASS = bytes(
    b"U"[0] if 65 <= c <= 90 else b"L"[0] if 97 <= c <= 122 or c >= 128 else b"D"[0] if 48 <= c <= 57 else b" "[0] if c in (9, 10, 11, 12, 13, 32) else b"."[0] if chr(c) in ".,;:?'\"()-" else b"|"[0] if c == 124 else b"!"[0] if c == 33 else b"S"[0]
    for c in range(256)
)
#: Features of a line and the edges between their levels; a level is how many edges lie below
#: or at the value.
EDGES = {
    "words": (1, 4, 9, 21, 61),
    "upper": (0.1, 0.3, 0.7),
    "signs": (1e-9, 0.02, 0.1),
    "exclaim": (1e-9, 0.2),
    "bars": (1e-9, 0.1),
    "digits": (1e-9, 0.1, 0.3),
    "distinct": (0.2, 0.5, 0.8, 1.0),
    "again": (1e-9, 0.1),
    "seen": (1, 2),
    "stop": (1,),
    "length": (3, 9),
}
_START = np.cumsum([0, *(len(e) + 1 for e in EDGES.values())])
WIDTH = int(_START[-1])
_EDGES = [np.array(e) for e in EDGES.values()]


def line_values(lines: list[str]) -> list[tuple]:
    """The features' values of each line of one text."""
    times = Counter(lines)
    out = []
    for line in lines:
        words = line.split()
        n, size = len(words), max(1, len(line))
        kinds = line.encode().translate(_CLASS)
        raw = max(1, len(kinds))
        upper, lower = kinds.count(b"U"), kinds.count(b"L")
        out.append((
            n, upper / max(1, upper + lower), kinds.count(b"S") / raw, kinds.count(b"!") / max(1, n), kinds.count(b"|") / max(1, n), kinds.count(b"D") / raw,
            len(set(words)) / n if n >= 8 else 0.9, sum(map(eq, words, words[1:])) / max(1, n - 1), times[line] - 1 if n else 0,
            1 if line.rstrip()[-1:] in ".?!" else 0, size / max(1, n),
        ))
    return out


def levels(values: list[tuple]) -> np.ndarray:
    """Columns of a line's active features: one for each feature."""
    v = np.array(values, dtype=float).reshape(-1, len(_EDGES))
    return np.stack([np.searchsorted(e, v[:, i], side="right") + _START[i] for i, e in enumerate(_EDGES)], axis=1)


def read(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels of all lines of texts, the length of each line, and how many lines each text has."""
    values, lengths, counts = [], [], []
    for t in texts:
        lines = t.split("\n")
        values += line_values(lines)
        lengths += [len(x) + 1 for x in lines]
        counts.append(len(lines))
    return levels(values), np.array(lengths, dtype=float), np.array(counts)


def unary(x: np.ndarray, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds of good of each line from its own and its neighbours' features.

    ``w`` has rows for the line itself, the one before and the one after; a missing
    neighbour has a weight of its own, in the last column.
    """
    u = w[0][x].sum(axis=1)
    ends = np.cumsum(counts)
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[ends - counts], last[ends - 1] = True, True
    before, after = w[1][x].sum(axis=1), w[2][x].sum(axis=1)
    u[1:] += np.where(first[1:], 0, before[:-1])
    u[:-1] += np.where(last[:-1], 0, after[1:])
    return u + first * w[1][-1] + last * w[2][-1]


def marginals(u: np.ndarray, counts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of good of each line, expected steps between states, and the log partition sum.

    Forward-backward over all texts at once: position by position, texts that are that long.
    ``t[a, b]`` is the log weight of state ``b`` (1: good) after ``a``.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more lines than the position
    step = np.exp(t - t.max())
    forward, backward, scale = np.zeros((len(u), 2)), np.ones((len(u), 2)), np.zeros(len(u))
    weight = np.stack([np.exp(-np.maximum(u, 0)), np.exp(np.minimum(u, 0))], axis=1)
    top = np.maximum(u, 0)
    for i in range(longest):
        at = starts[: alive[i]] + i
        f = weight[at] if i == 0 else (forward[at - 1] @ step) * weight[at]
        scale[at] = f.sum(axis=1)
        forward[at] = f / scale[at][:, None]
    for i in range(longest - 2, -1, -1):
        at = starts[: alive[i + 1]] + i
        b = (backward[at + 1] * weight[at + 1]) @ step.T
        backward[at] = b / scale[at + 1][:, None]
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(u), bool)
    inner[(np.cumsum(counts) - counts)] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] * step[None] * (weight[at] * backward[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    log_z = float(np.log(scale).sum() + top.sum() + len(at) * t.max())
    return p[:, 1], pair.sum(axis=0), log_z


@dataclass
class Model:
    """Weights of line features and of steps, and the document's calibration."""

    w: np.ndarray
    t: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: list[str]) -> list[float]:
        """Score of each text, 0 to 1."""
        x, lengths, counts = read(texts)
        p, _, _ = marginals(np.clip(unary(x, counts, self.w), -30, 30), counts, self.t)
        return (1 / (1 + np.exp(-(self.slope * log_odds(p, lengths, counts) + self.shift)))).tolist()


def log_odds(p: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean marginal of each text, within 6 of 0."""
    starts = np.cumsum(counts) - counts
    share = np.add.reduceat(p * lengths, starts) / np.add.reduceat(lengths, starts)
    share = np.clip(share, 1e-12, 1 - 1e-12)
    return np.clip(np.log(share / (1 - share)), -6, 6)


def train(x: np.ndarray, lengths: np.ndarray, counts: np.ndarray, good: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Model:
    """The field's weights by gradient ascent (Adam) on the likelihood of the lines' labels.

    Each line has the label of its document; the two labels weigh equally. The calibration
    is a logistic regression of the documents' labels on the log odds of their mean marginal,
    shifted so that the score ``GOOD`` divides the learnt documents with the fewest errors.
    """
    line_good = np.repeat(good, counts).astype(float)
    share = max(1e-9, min(1 - 1e-9, line_good.mean()))
    weight = np.where(line_good > 0, 0.5 / share, 0.5 / (1 - share))
    w, t = np.zeros((3, WIDTH + 1)), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    starts = np.cumsum(counts) - counts
    inner[starts] = False
    steps = np.zeros((2, 2))
    steps[0, 0], steps[1, 1] = ((line_good == g)[inner].sum() for g in (0, 1))
    moments = [np.zeros((2, *a.shape)) for a in (w, t)]
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[starts], last[starts + counts - 1] = True, True
    for r in range(1, rounds + 1):
        p, pairs, _ = marginals(np.clip(unary(x, counts, w), -30, 30), counts, t)
        gap = (line_good - p) * weight
        gw = np.zeros_like(w)
        np.add.at(gw[0], x.ravel(), np.repeat(gap, x.shape[1]))
        np.add.at(gw[1], x[:-1].ravel(), np.repeat(np.where(first[1:], 0, gap[1:]), x.shape[1]))
        np.add.at(gw[2], x[1:].ravel(), np.repeat(np.where(last[:-1], 0, gap[:-1]), x.shape[1]))
        gw[1][-1], gw[2][-1] = gap[first].sum(), gap[last].sum()
        for a, g, m in ((w, gw / len(x) - decay * w, moments[0]), (t, (steps - pairs) / len(x) - decay * t, moments[1])):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            a += 0.1 * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-9)
    p, _, _ = marginals(np.clip(unary(x, counts, w), -30, 30), counts, t)
    z = log_odds(p, lengths, counts)
    slope, shift = _logistic(z, good.astype(float))
    return Model(w, t, slope, shift + np.log(GOOD / (1 - GOOD)) - _cut(slope * z + shift, good))


def _cut(z: np.ndarray, good: np.ndarray) -> float:
    """The value that divides good from bad with the fewest errors, midway between its neighbours."""
    order = np.argsort(z, kind="stable")
    z, good = z[order], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum((1 - good)[::-1])[::-1], [0]])
    between = np.concatenate([[True], z[1:] > z[:-1], [True]])  # equal values stay together
    best = np.flatnonzero(between & (errors == errors[between].min()))
    low, high = (z[i - 1] if i else z[0] - 1 for i in best), (z[i] if i < len(z) else z[-1] + 1 for i in best)
    _, middle = max((b - a, (a + b) / 2) for a, b in zip(low, high))
    return float(middle)


def _logistic(z: np.ndarray, y: np.ndarray, rounds: int = 30, decay: float = 1e-2) -> tuple[float, float]:
    """Slope (positive) and shift of a one-variable logistic regression, labels weighing equally."""
    share = max(1e-9, min(1 - 1e-9, y.mean()))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    a, x = np.array([0.5, 0.0]), np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ a))
        g = x.T @ (weight * (y - p)) - decay * a
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(2)
        a = a + np.linalg.solve(h, g)
    return max(0.1, float(a[0])), float(a[1])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    Those with the smallest id hashes are taken, in that order, until they have ``lines``
    lines; only their line features reach the driver. Without both labels there, every
    score is 0.5.
    """
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias("label"))
    known = known.withColumn("h", F.xxhash64(doc_id)).orderBy("h", doc_id).limit(sample)
    rows = docs.select(doc_id, F.col(text).alias("text")).join(known, doc_id).select("h", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read([t.as_py() or ""]) for t in b.column(2)]
            columns = [pa.array([f[0].ravel().astype(np.int16).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), *columns], names=["h", "label", "x", "lengths"])

    got = rows.mapInArrow(run, "h long, label int, x binary, lengths binary").orderBy("h", F.xxhash64("x")).limit(sample).collect()
    taken, n = [], 0
    for r in got:
        n += len(r.lengths) // 8
        if taken and n > lines:
            break
        taken.append(r)
    good = np.array([r.label for r in taken])
    if len(set(good.tolist())) < 2:
        return Model(np.zeros((3, WIDTH + 1)), np.zeros((2, 2)), 0.0, 0.0)
    lengths = [np.frombuffer(r.lengths) for r in taken]
    x = np.concatenate([np.frombuffer(r.x, dtype=np.int16).reshape(-1, len(EDGES)) for r in taken]).astype(np.int64)
    return train(x, np.concatenate(lengths), np.array(list(map(len, lengths))), good)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score of quality, 0 to 1, for every row (an existing ``out`` column goes).

    Each line of the whole text is labelled good or bad in the light of its neighbours; the
    marginal probabilities of good, weighted by the lines' lengths, make the document's
    score. Nothing but the text is looked at. A null or empty text is one empty line.
    Equal texts score equally; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != out]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                s = model.scores([t.as_py() or "" for t in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*names, out])

    picked = docs.select(*names)
    return picked.mapInArrow(run, picked.withColumn(out, F.lit(0.0)).schema)


def predicted(score: Column, good: float = GOOD) -> Column:
    return F.when(score >= good, 1).otherwise(0)
