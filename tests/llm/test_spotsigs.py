import random
import re
from itertools import combinations

import pytest

from evidentia.llm import queries, spotsigs
from pyspark.sql import functions as F

STOP = set(" ".join(spotsigs.ANCHORS.values()).split())


def plain(text, chain=3):
    """The chains of a text, as tuples of words."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in STOP]
    at, found, after = 0, set(), True
    for w in words:
        if w in STOP:
            after = True
        else:
            if after:
                found.add(tuple(content[at : at + chain]))
            after = False
            at += 1
    return found or ({("all", *words)} if words else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=60, seed=4):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "und", "la", "is"] + [f"w{i}" for i in range(40)]
    out = [" ".join(rnd.choices(vocabulary, k=rnd.randrange(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):
        words = out[i].split()
        words[len(words) // 2] = "zz"
        out[i + 1] = " ".join(words)
    return [*out, "", None, "the of", "The, of.", "é" * 3000, "one", "Größe für 中文 x", "the " * 4000 + "end", "a|b||c  the\n\nq"]


def test_signatures(spark):
    rows = list(enumerate(texts()))
    got = {r.i: set(r.s) for r in spark.createDataFrame(rows, "i int, t string").select("i", spotsigs.signatures(F.col("t")).alias("s")).collect()}
    want = {i: plain(t) for i, t in rows}
    assert {i: len(s) for i, s in got.items()} == {i: len(s) for i, s in want.items()}
    for i, j in combinations(range(0, len(rows), 2), 2):
        assert len(got[i] & got[j]) == len(want[i] & want[j])


@pytest.mark.parametrize("lots", [1, 4])
def test_edited(spark, lots):
    rows = [(i * 3 - 9, t, 1) for i, t in enumerate(texts())] + [(0, "tie the tie", 1), (0, "tie the tie", 1), (None, "first of all", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lot int").repartition(5)
    got = spotsigs.edited_pairs(df, lots=lots).collect()
    ordered = sorted(rows, key=lambda r: (-(10**9) if r[0] is None else r[0], (r[1] or "").encode()))
    want = []
    for r, after in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = r[1] or "", after[1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + u[:m]
        want.append((str(r[0]), len(t), edited, round(likeness(plain(t), plain(edited)), 9), round(likeness(plain(t), plain(u)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert spotsigs.edited_pairs(df.limit(0)).count() == 0
    one = spotsigs.edited_pairs(df.where("doc_id = -9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_similar_classes(spark):
    rows = [(i, t) for i, t in enumerate(texts(90))] + [(500, texts()[0]), (None, texts()[0])]
    members, links = spotsigs.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), least=0.6)
    sets = {i: plain(t) for i, t in rows if i is not None}
    name = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    assert {r.doc_id: r.class_id for r in members.collect() if r.doc_id is not None} == name
    want = {(a, b) for a, b in combinations(sorted(set(name.values())), 2) if sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.6}
    assert len(want) > 5
    assert {(r.a, r.b) for r in links.collect()} == want


def test_text_without_common_words_counts_whole(spark, tmp_path):
    rows = [(1, "alpha beta gamma " + "delta " * 20), (2, "alpha beta gamma " + "omega " * 20), (3, "alpha beta the gamma"), (4, "the of"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in df.select("doc_id", spotsigs.signatures(F.col("text"), whole=True).alias("s")).collect()}
    assert [len(got[i]) for i in range(1, 6)] == [1, 1, 2, 1, 0] and got[1] != got[2]
    members, _ = spotsigs.similar_classes(df.where("doc_id < 3"), whole=True)
    assert {r.doc_id: r.class_id for r in members.collect()} == {1: 1, 2: 2}
    df.where("doc_id < 3").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op5_spotsigs(spark, str(tmp_path)).collect()}
    assert found[1].fingerprint != found[2].fingerprint and found[1].near_next == 0.0
