import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import linecrf, secrets
from tests.llm.test_similar import groups
from tests.llm.test_winnow import brute

HEX40 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("aeinorstl", k=rnd.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = [line(30), line(35)]
    rows = []
    for i in range(120):
        lines = [line(rnd.randrange(6, 20)) for _ in range(rnd.randrange(2, 7))]
        if i % 6 == 0:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        elif i % 10 == 1:
            lines += passage
        elif i % 10 == 2:
            lines.append(f'x token = "{HEX40[i // 10 :]}" y')
        rows.append((i, "\n".join(lines)))
    long = " ".join(word() for _ in range(400))
    rows += [(200, long), (201, long.replace(long.split()[200], "zzzz", 1)), (202, rows[2][1]), (203, ""), (204, "words " * 5000)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(120) if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, at = [docs], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/stage{i}")
        at = spark.read.parquet(f"{folder}/stage{i}")
        out.append(at)
    return folder, out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage(spark, stages):
    folder, out = stages
    given, good, lined, single, clean = map(texts, out[:5])
    assert all(df.columns == out[0].columns for df in out[1:5])
    assert all(r.n_chars == len(r.text) for df in out[1:5] for r in df.collect())
    model = linecrf.learn(out[0], spark.read.parquet(f"{folder}/labels.parquet"))
    assert good == {i: t for i, t in given.items() if model.scores([t])[0] >= linecrf.GOOD}
    assert {i for i in given if i < 120 and i % 6} <= good.keys() and not {i for i in range(0, 120, 6)} & good.keys()
    must, may = (brute(sorted(good.items()), n) for n in (50, 1))
    for i, t in good.items():
        all_lines = [x for x in t.split("\n") if x.strip()]
        kept = lined[i].split("\n") if i in lined and lined[i] else []
        assert not any(all_lines[j] in kept for j in must[i])
        assert all(x in kept for j, x in enumerate(all_lines) if j not in may[i])
        assert (i in lined) == (bool(kept) or not all_lines)
    ids = sorted(lined)
    roots = [ids[c] for c in groups([lined[i] for i in ids])]
    assert single == {i: lined[i] for i, r in zip(ids, roots) if i == r}
    assert 201 in lined and 201 not in single
    for i, t in single.items():
        spans = secrets.base_spans(t)
        assert bool(spans) == ("[SECRET]" in clean[i]) and not secrets.base_spans(clean[i]) and (spans or clean[i] == t)


def test_packing_holds_all(spark, stages):
    folder, out = stages
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    bins = defaultdict(int)
    for r in out[5].collect():
        pieces[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id] += r.length
    for i, t in texts(out[4]).items():
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        assert sum(x for _, x in pieces[i]) == n
        assert np.array_equal(np.cumsum([0, *(x for _, x in sorted(pieces[i]))])[:-1], [s for s, _ in sorted(pieces[i])])
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1
    run = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out[5].collect())


def test_odd_rows_pass_every_stage(spark, stages, tmp_path):
    folder, out = stages
    good = " ".join(["plain", "words", "of", "a", "good", "text"] * 3)
    kinds = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, text_hash long, block int, length string, bucket int"
    more = ("x", "y", 1, 2, "z", 3)
    odd = [(1, None), (2, ""), (None, "no id here"), (None, None), (7, good), (7, good), (8, good.upper()), (7, "another text of the same id " * 3), (9, " \n\t\n"), (10, "long " * 30_000 + "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, None, "s", 0, *more) for i, t in odd], kinds)
    rows = lambda df: sorted(((str(r.doc_id), str(r.text)) for r in df.collect()))
    assert corpus_pipeline.quality(spark, df, folder).columns == df.columns
    lined = corpus_pipeline.lines(spark, df, folder)
    assert lined.columns == df.columns and lined.count() == len(odd)
    assert [(r.digest, r.key, r.text_hash, r.block, r.length, r.bucket) for r in lined.collect()] == [more] * len(odd)
    single = corpus_pipeline.near_copies(spark, df, folder)
    assert rows(single) == sorted([("1", "None"), ("None", "no id here"), ("None", "None"), ("7", good), ("7", odd[7][1]), ("10", odd[9][1])]) and single.columns == df.columns
    clean = corpus_pipeline.secret_scan(spark, df, folder)
    assert rows(clean) == rows(df) and clean.columns == df.columns
    packed = corpus_pipeline.pack(spark, df, folder).groupBy("doc_id").sum("length").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t in odd:
        want[i] = want.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert {r.doc_id: r[1] for r in packed} == want
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), folder).count() == 0
