import random

from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import winnow


def make(n=60, seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    line = lambda lo, hi: " ".join(word() for _ in range(rnd.randrange(lo, hi)))
    passages = [[line(5, 25) for _ in range(rnd.randrange(4, 9))] for _ in range(4)] + [[line(60, 70)]]
    docs = []
    for i in range(n):
        lines = [line(1, 20) for _ in range(rnd.randrange(0, 8))]
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            at = rnd.randrange(len(lines) + 1)
            lines[at:at] = p
        if i % 7 == 0:
            lines.insert(0, "a short line everywhere")
        docs.append("\n".join(lines))
    docs[20] = docs[3]
    docs[21] = docs[4] + "\n\n" + docs[4]
    return docs


def brute(docs, words):
    """Lines in a run with so many words that stands in an earlier place: all runs of any length compared."""
    seen, out = {}, {}
    for key, text in docs:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        gone = set()
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                if sum(len(x.split()) for x in lines[s : e + 1]) >= words:
                    run = "\n".join(lines[s : e + 1])
                    if run in seen:
                        gone |= set(range(s, e + 1))
                    seen.setdefault(run, (key, s))
        out[key] = gone
    return out


def test_long_repeats_go_and_first_ones_stay(spark):
    docs = list(enumerate(make()))
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], "doc_id long, text string, n_removed int, key string").repartition(3)
    got = {r.doc_id: r for r in winnow.dedup_lines(df).collect()}
    must, may = brute(docs, 50), brute(docs, 1)
    kept_lines = set()
    missed = total = 0
    for i, t in docs:
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        left = [x.strip() for x in got[i].text.split("\n") if x.strip()]
        assert got[i].n_lines == len(lines) and got[i].n_removed == len(lines) - len(left)
        kept_lines |= set(left)
        total += len(must[i])
        gone = [x for j, x in enumerate(lines) if j in must[i] and x in left and lines.count(x) == 1]
        missed += len(gone)
        assert len(lines) - len(left) <= len(may[i])  # only lines that stand earlier go
    assert total > 50 and missed == 0
    assert kept_lines == {x.strip() for _, t in docs for x in t.split("\n") if x.strip()}
    assert got[20].text == "" and got[0].text.startswith("a short line everywhere") and got[7].text.startswith("a short line everywhere")


def test_runs_around_a_passage_that_stands_alone_earlier(spark):
    line = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    w, x, y, z = line("w", 50), line("x", 20), line("y", 20), line("z", 20)
    docs = [(1, w), (2, "\n".join([w, x, y])), (3, "\n".join([w, x, y])), (4, "\n".join([x, w])), (5, "\n".join([z, x, w, y, z])), (6, "\n".join([y, z, w, x, y]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in winnow.dedup_lines(df).collect()}
    assert got == {1: 0, 2: 1, 3: 3, 4: 1, 5: 2, 6: 3} == {i: len(x) for i, x in brute(docs, 50).items()}
    many = docs + [(i, docs[1][1]) for i in range(7, 60)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    runs = winnow.repeated_runs(df, rows_a_lot=4)  # the second document is laid out in many lots
    assert runs.count() == 58


def test_rows_of_one_id(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    df = spark.createDataFrame([(1, long), (1, long + "\nmore"), (1, long)], "doc_id long, text string")
    got = sorted((len(r.text), r.n_removed) for r in winnow.dedup_lines(df).collect())
    assert got in ([(0, 6), (0, 6), (len(long) + 5, 0)], [(4, 6), (len(long), 0), (len(long), 0)])


def test_odd_rows(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(None, long), (5, None), (6, ""), (7, "\n \n"), (8, long), (8, long), (9, "x " * 30000), (10, long + "\nend"), (11, "one\n\n" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.n_removed) for r in winnow.dedup_lines(df).where("doc_id <> 5 or doc_id is null").collect())
    assert got == [(-1, long, 0), (6, "", 0), (7, "\n \n", 0), (8, "", 6), (8, "", 6), (9, "x " * 30000, 0), (10, "end", 6), (11, "one\n", 6)]
    assert winnow.dedup_lines(df.where("doc_id = 5")).first().text is None
    assert winnow.dedup_lines(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.lists(st.integers(1, 30), max_size=5), st.lists(st.integers(1, 30), max_size=5))
def test_guarantee(shared, before, after):
    lines = lambda ns, tag: [" ".join(f"{tag}{i}-{j}" for j in range(n)) for i, n in enumerate(ns)]
    a = "\n".join(lines(before, "b") + lines(shared, "s"))
    b = "\n".join(lines(shared, "s") + lines(after, "a"))
    one, two = (winnow.winnow(*winnow.line_hashes(t)) for t in (a, b))
    if sum(shared) >= 50:
        assert one.keys() & two.keys()
        both = {w for g in one.keys() & two.keys() for w, _ in one[g]}
        first = {w: s for ws in two.values() for w, s in ws if w in both}
        spans = winnow.windows_of(winnow.line_hashes(b)[1])
        assert {i for s, e in spans if s in first.values() and e < len(shared) for i in range(s, e + 1)} == set(range(len(shared)))
