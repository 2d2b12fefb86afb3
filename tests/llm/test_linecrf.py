import random
import zlib
from itertools import product

import numpy as np

from evidentia.llm import linecrf


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 5, 2])
    u, t = rng.normal(0, 3, counts.sum()), rng.normal(0, 1, (2, 2))
    p, pairs, log_z = linecrf.marginals(u, counts, t)
    want, steps, z_all, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        total, good, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(n)):
            weight = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            total += weight
            good += weight * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += weight
        want += (good / total).tolist()
        steps += pair / total
        z_all += np.log(total)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, steps) and np.isclose(log_z, z_all)


def corpus(n=240):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("aeinorst", k=rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(rnd.randrange(5, 20))) + "." for _ in range(rnd.randrange(1, 9))]
        bad = i % 5 == 0
        if bad:
            kind = i // 5 % 4
            junk = [lambda x: " ".join(f"{w}$$$" for w in x.split()), lambda x: " ".join(f"{w.upper()}!!" for w in x.split()), lambda x: x.replace(" ", " | "), lambda x: " ".join([x.split()[0]] * 30)][kind]
            lines = lines[:1] + [junk(x) for x in lines]
        rows.append((i, "\n".join(lines)))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(i, t, 3) for i, t in rows] + [(900, None, 3), (901, "", 3), (None, "a line of words here.", 3)], "doc_id long, text string, score int")
    model = linecrf.learn(df, spark.createDataFrame([*labels, (5, None), (7, 3)], "doc_id long, quality int"))
    scored = linecrf.score(df, model)
    assert scored.columns == ["doc_id", "text", "score"]
    got = {r.doc_id: r.score for r in scored.collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 30 and sum((got[i] >= linecrf.GOOD) == (i % 5 != 0) for i in out) >= 0.97 * len(out)
    assert got[None] >= 0.7
    assert linecrf.score(df.limit(0), model).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = linecrf.learn(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert linecrf.score(df, model).first().score == 0.5


def test_long_text():
    rng = np.random.default_rng(0)
    model = linecrf.Model(rng.normal(0, 5, (3, linecrf.WIDTH + 1)), np.array([[3.0, -3], [-3, 3]]), 1.0, 0.0)
    text = "\n".join(["good words."] * 3000 + ["X$ " * 50] * 3000)
    one, two = model.scores([text, "a"]), model.scores(["a", text])
    assert one == two[::-1] and 0 <= one[0] <= 1
