import random
import re
from itertools import combinations

from evidentia.llm import urls


def plain(url, rules=urls.RULES):
    low = {ord(a): b for a, b in zip(urls.UPPER, urls.LOWER)}
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    h = re.split("[/?#]", rest, maxsplit=1)[0]
    p = re.split("[?#]", rest[len(h) :], maxsplit=1)[0]
    h = h.translate(low)
    fit = [(len(a + b), a + b, v) for v, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
    return (h, p, max(fit)[1], max(fit)[2]) if fit else (h, p, None, None)


URLS = [
    None, "", "example.com/en/", "http://", "http://com/", "http://com", "https://EXAMPLE.com/en/1?x=/fr/", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://notexample.com/en/x",
    "http://xcom/", "http://a.net/es/1", "http://a.net/ES/1", "http://a.net/fr/#x", "http://a.net?/fr/", "http://a.net#/fr/", "ftp://É.NET/fr/", "http://a://b.com/", "http://exa\nmple.com/en/\nx", "http://net/es/" + "x" * 5000, "x://a.org/es/1", "x://b.org/en/1",
]


def test_rules(spark):
    rows = [(i, u, "h", "t") for i, u in enumerate(URLS)] + [(None, "http://a.net/es/1", "h", "t"), (3, "http://a.net/es/1", "h", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, tokens string")
    got = urls.judge(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((key((r.page_id, r.host, r.path, r.rule)) for r in got)) == sorted(key((i, *plain(u)[:3])) for i, u, _, _ in rows)
    for r in got:
        if r.rule is not None:
            assert r.verdict == {h + p: v for v, h, p in urls.RULES}[r.rule]
        else:
            assert r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(df.where("page_id = 20")).collect()} == {"allow"}


def test_mined_rules_against_counts(spark):
    rows = [(["a", "b", "c"], "block")] * 30 + [(["a", "b"], "block")] * 10 + [(["a", "d"], "allow")] * 40 + [(["b"], "allow")] * 5 + [(["rare"], "block")]
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), r.key) for r in urls.mine(df, support=0.1, confidence=0.8).collect()}
    want = {}
    for size in (1, 2, 3):
        for combo in combinations("abcd", size):
            own = [v for t, v in rows if set(combo) <= set(t)]
            for v in ("allow", "block"):
                if own.count(v) >= 0.1 * len(rows) and own.count(v) / len(own) >= 0.8:
                    c = own.count(v) / len(own)
                    if not any(set(o) < set(combo) and w == v and oc >= c for (o, w), oc in want.items()):
                        want[combo, v] = c
    assert {k: v[0] for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    matched = urls.match(spark.createDataFrame([(1, ["a", "b", "x"]), (2, ["d", "a"]), (3, ["x"])], "page_id long, tokens array<string>"), urls.mine(df, 0.1, 0.8))
    assert {r.page_id: r.mined.verdict for r in matched.collect()} == {1: "block", 2: "allow"}


def plain_tokens(url):
    """Tokens of a URL as the operator's docstring has them."""
    if url is None:
        return set()
    h, p, _, _ = plain(url)
    out = {f"h:{x}" for x in h.split(".") if x} | {f"p:{x}" for x in p.split("/") if x}
    if "://" in url:
        out.add("s:" + url.split("://", 1)[0])
    if m := re.search(r"(\.[A-Za-z0-9]+)$", p):
        out.add("e:" + m[1])
    if m := re.search(r"\?([^#]*)", url):
        out |= {"q:" + x.split("=")[0] for x in m[1].split("&") if x.split("=")[0]}
    return out | ({"f:"} if "#" in url else set())


def test_verdicts_by_value(spark):
    rnd = random.Random(5)
    hosts = ["example.com", "www.example.com", "a.net", "b.net", "c.org", "d.org", "com"]
    rows = []
    for i in range(400):
        path = "/".join([rnd.choice(["en", "fr", "es", "de"]), rnd.choice(["a", "b", "c"]) + rnd.choice(["", ".html", ".pdf"])])
        rows.append((i, f"{rnd.choice(['http', 'https'])}://{rnd.choice(hosts)}/{path}" + rnd.choice(["", "?id=1", "?id=1&x", "#t"])))
    rows += [(1000, None), (1001, "no scheme"), (1001, "no scheme"), (None, "http://z.org/fr/a")]
    support, confidence = 0.05, 0.7
    labelled = [(plain_tokens(u), plain(u)[3]) for _, u in rows if plain(u)[3]]
    rules = {}
    for size in range(1, 9):
        for combo in {c for t, _ in labelled for c in combinations(sorted(t), size)}:
            own = [v for t, v in labelled if t.issuperset(combo)]
            for v in ("allow", "block"):
                n, c = own.count(v), own.count(v) / len(own)
                if n >= support * len(labelled) and c >= confidence and not any(w == v and rc >= c and set(o) < set(combo) for (o, w), (rc, _) in rules.items()):
                    rules[combo, v] = c, n / len(labelled)
    want = []
    for i, u in rows:
        h, p, rule, verdict = plain(u)
        best = max(((c, n, len(combo), v == "block", " ".join(combo)) for (combo, v), (c, n) in rules.items() if plain_tokens(u).issuperset(combo)), default=None)
        mined = best[4] if best and rule is None else None
        want.append((i, h, p, rule, verdict or ("allow" if not best else "block" if best[3] else "allow"), mined))
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [tuple(r) for r in urls.judge(df, support=support, confidence=confidence).select("page_id", "host", "path", "rule", "verdict", "mined").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
