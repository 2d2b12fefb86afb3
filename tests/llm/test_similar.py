import random
import re
from itertools import combinations

import pytest

from evidentia.llm import similar

WORDS = [f"w{i}" for i in range(400)]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def parts(w, k):
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def groups(texts):
    """For each text the index of the first one of its group, over all pairs."""
    ws = [words(t) for t in texts]
    sets = [set(parts(w, 5)) for w in ws]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if ws[i] == ws[j] or sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, component_id string")
    return {r.doc_id: r.component_id for r in similar.similar_groups(df, **kw).collect()}


def base(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def edited(rnd, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS)
    return w


@pytest.mark.parametrize("max_run, block", [(4096, similar.BLOCK), (8, 2000)])
def test_against_all_pairs(spark, max_run, block):
    rnd = random.Random(3)
    texts = ["", None, " \n", "a", "A", "a b c d", "a b c d e", "a b c e d"]
    for _ in range(6):
        w = base(rnd, 150)
        texts += [" ".join(edited(rnd, w, e)) for e in (0, 0, 1, 2, 3, 6)]
    hot = base(rnd, 200)  # a dense run: many close texts, some of them unlike each other
    texts += [" ".join(edited(rnd, hot, e)) for e in [1] * 25 + [3] * 20 + [8] * 15]
    rnd.shuffle(texts)
    found = got(spark, [(i, t, "x", "y") for i, t in enumerate(texts)], max_run=max_run, block=block)
    want = groups(texts)
    assert [found[i] for i in range(len(texts))] == want
    assert len(set(want)) > 20


def test_edits_within_reach_are_found(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        w = base(rnd, 300)
        rows += [(2 * i, " ".join(w), "", ""), (2 * i + 1, " ".join(edited(rnd, w, 3)), "", "")]
    found = got(spark, rows)
    assert all(found[2 * i] == 2 * i for i in range(60))
    assert sum(found[2 * i + 1] == 2 * i for i in range(60)) >= 57


def test_one_fingerprint_of_many_texts(spark):
    # the words' order does not touch one-word fingerprints: each pair of rows is alike, the rest is not
    rnd = random.Random(4)
    w = base(rnd, 120)
    rows = []
    for i in range(12):
        rnd.shuffle(w)
        swapped = w[1::-1] + w[2:]
        rows += [(2 * i, " ".join(w), "", ""), (2 * i + 1, " ".join(swapped), "", "")]
    found = got(spark, rows, shingle_words=1)
    assert found == {i: i // 2 * 2 for i in range(24)}


def test_ids_and_edges(spark):
    rows = [(5, "One two three", "", ""), (3, "one  two\nthree", "", ""), (3, "other words", "", ""), (None, "one two three", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, component_id string")
    found = sorted((r.doc_id, r.component_id) for r in similar.similar_groups(df).collect())
    assert found == [(3, 3), (3, 3), (5, 3)]
    assert similar.similar_groups(df).columns == ["doc_id", "text_hash", "component_id", "component_hash"]
    again = df.unionByName(spark.createDataFrame([(3, "One two three", "", ""), (3, "other words", "", ""), (9, "OTHER words", "", "")], df.schema))
    kept = sorted((str(r.doc_id), r.text.lower().split()) for r in similar.without_copies(again).collect())
    assert kept == [("3", ["one", "two", "three"]), ("3", ["other", "words"]), ("None", ["one", "two", "three"])]
    assert similar.similar_groups(df.limit(0)).count() == 0


def test_every_kind_of_edit_is_found(spark):
    # pairs alike by 0.8 to 0.85: a block replaced, an end added, an end cut off; few are near in SimHash
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(60):
        n = rnd.randrange(60, 400)
        w = base(rnd, n)
        m = n // 12
        at = rnd.randrange(n - m)
        other = [w[:at] + base(rnd, m) + w[at + m :], w + base(rnd, n // 5), w[: n - n // 6]][i % 3]
        a, b = set(parts(w, 5)), set(parts(other, 5))
        rows += [(2 * i, " ".join(w), "", ""), (2 * i + 1, " ".join(other), "", "")]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i if len(a & b) >= 0.8 * len(a | b) else 2 * i + 1}
    assert sum(i != j for i, j in want.items()) >= 45
    assert got(spark, rows) == want
