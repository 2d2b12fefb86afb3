"""Every registered query of the library's own against its SQL in DuckDB."""

import duckdb
import pytest

from evidentia.plans import catalogue, scoring  # noqa: F401
from evidentia.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"contamination_exact", "pair_match"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    assert got or name in MAY_BE_EMPTY
    if name in catalogue.ORACLE_SQL:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        have = [c[0] for c in cur.description]
        assert sorted(have) == columns
        order = [have.index(c) for c in columns]
        assert got == plain(tuple(r[i] for i in order) for r in cur.fetchall())


def test_views_round_alike(spark, duck):
    """Halves in decimals that doubles miss or reach only when multiplied: views have DuckDB's digits."""
    from evidentia.plans.bindings import rounding

    sql = "round(x / 500000, 4)"
    xs = [9725.0 + 50 * i for i in range(4000)] + [-9725.0, 0.0]
    want = duck.execute(f"select x, {sql} from (select unnest(?::DOUBLE[]) as x)", [xs]).fetchall()
    spark.createDataFrame([(x,) for x in xs], "x double").createOrReplaceTempView("halves")
    assert sorted(map(tuple, spark.sql(f"select x, {rounding(sql)} from halves").collect())) == sorted(want)
    assert dict(want)[9725.0] == 0.0194


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


def test_containment_writes_only_what_may_meet(spark, monkeypatch):
    """Against all pairs compared; of 300,000 windows hardly one that meets nothing is joined."""
    import random

    from evidentia.operators import contamination

    written = {}

    def counted(df, label, cut=contamination.cut):
        out = cut(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(contamination, "cut", counted)
    r = random.Random(5)
    said = lambda n: "".join(r.choice("abcdefgh é汉") for _ in range(n)).strip()
    evals = {i: said(n) for i, n in enumerate([1, 2, 8, 29, 30, 31, 70] * 3 + [3000] * 100)}
    examples = dict(enumerate([evals[50][100:140], evals[60], said(9) + evals[6] + said(9), said(20) + evals[3] + said(9), evals[70][5:34], said(50)]))
    known = spark.createDataFrame(list(examples.items()), "example_id long, text string")
    asked = spark.createDataFrame(list(evals.items()), "eval_id long, text string")
    plain_ = lambda df: {x[0]: x[2] for x in df.withColumn("n", contamination.normalised(df["text"])).collect()}
    t, u = plain_(known), plain_(asked)
    want = {(i, j) for i, x in t.items() for j, y in u.items() if y and len(x) >= 30 and x not in u.values() and (x in y or y in x)}
    assert {tuple(x) for x in contamination.contained(known, asked).collect()} == want
    assert {i for i, _ in want} >= {0, 2, 3}
    assert written["contained-asked"] < 200
