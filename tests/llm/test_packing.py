import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from evidentia.llm import packing

FILE = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "a b", "it's 12 o'clock", "<|endoftext|> x", "a<|endoftext|><|endoftext|>  b <|endoftext", "é 中文 \U0001f600\x00", "word " * 5000, "x" * 9000, " \n\n  \t y", "a b"]


def library(text):
    t = Tokenizer.from_file(FILE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_bins_are_whole_and_few():
    rnd = random.Random(1)
    for sizes in ([rnd.randrange(1, 2049) for _ in range(3000)], [1000] * 50, [2048] * 5, [], [1500, 1400, 548, 648], [rnd.randrange(600, 900) for _ in range(300)]):
        bins = packing.pack(sizes, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 2048))
    assert len(packing.pack([1500, 1400, 548, 648], 2048)) == 2


def optimum(sizes, limit):
    """The fewest bins, by trying every bin for every item."""
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted({b for b in bins if b + sizes[i] <= limit}):
            k = bins.index(b)
            put(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1 :]])
        put(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    put(0, [])
    return best[0] if sizes else 0


def triples(rnd, n, limit=1000):
    """Sizes that fill ``n`` bins exactly, by three."""
    cuts = [(rnd.randrange(200, 500), rnd.randrange(200, 300)) for _ in range(n)]
    return [x for a, b in cuts for x in (a, b, limit - a - b)]


def test_search_closes_the_gap_that_best_fit_leaves():
    rnd = random.Random(2)
    small = [triples(rnd, 3) for _ in range(60)] + [[rnd.randrange(150, 900) for _ in range(rnd.randrange(4, 10))] for _ in range(60)]
    fit, search, best = (sum(f(s) for s in small) for f in (lambda s: len(packing.best_fit(s, 1000)), lambda s: len(packing.pack(s, 1000)), lambda s: optimum(s, 1000)))
    assert fit - best >= 15 and search - best <= (fit - best) // 4
    many = triples(rnd, 600)  # 600 bins hold them
    assert len(packing.best_fit(many, 1000)) >= 630 and len(packing.pack(many, 1000)) <= 612
    sizes = [x for _ in range(200) for x in (rnd.randrange(300, 500), rnd.randrange(200, 400), rnd.randrange(500, 700), rnd.randrange(150, 300))]
    start = [[i] for i in range(len(sizes))]  # one document a bin: the search alone packs them
    assert len(packing.local_search(start, sizes, 1000)) <= 1.02 * -(-sum(sizes) // 1000)


def test_what_buckets_leave_is_packed_again(spark):
    df = spark.createDataFrame([(i, "word " * 700) for i in range(40)], "doc_id long, text string")
    got = packing.pack_documents(df, FILE, bucket=4).collect()
    assert len(got) == 40 and len({r.sequence_id for r in got}) == 20
    df = spark.createDataFrame([(i, "word " * (600 if i % 3 else 1300)) for i in range(90)], "doc_id long, text string")
    got = packing.pack_documents(df, FILE, bucket=7).collect()
    assert len(got) == 90 and len({r.sequence_id for r in got}) <= 48


def test_search_empties_a_bin():
    sizes = [6, 3, 5, 4, 1, 1]  # 9 + 9 + 2 of 10: two full bins hold all
    bins = packing.local_search([[0, 1], [2, 3], [4, 5]], sizes, 10)
    assert sorted(sum(sizes[i] for i in b) for b in bins) == [10, 10]
    bins = packing.local_search([[0], [1], [2], [3]], [7, 5, 5, 3], 10)
    assert sorted(sum([7, 5, 5, 3][i] for i in b) for b in bins) == [10, 10]
    sizes = [5, 4, 6, 3, 2]  # swaps: 5 and 3 for the 6 that stands alone
    bins = packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)
    assert len(bins) == 2


def test_documents(spark):
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "s", 1), (2, "a b", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, length int")
    got = packing.pack_documents(df, FILE, bucket=7).collect()
    want = sorted((str(r[0]), i, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], dtype="<u4").tobytes())) for r in rows for ids in [library(r[1])] for i, (lo, hi) in enumerate(cuts(len(ids))))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(df.limit(0), FILE).count() == 0


def cuts(n, limit=2048):
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first)] + [(x, x + limit) for x in range(first, n, limit)]


def test_payload(spark):
    df = spark.createDataFrame([(1, "it's " * 3000)], "doc_id long, text string")
    got = packing.pieces(df, FILE, payload=True).collect()
    assert [i for r in sorted(got, key=lambda r: r.piece) for i in r.ids] == library("it's " * 3000)
