import gzip
import json

import pytest

from evidentia.sources import corpus, store
from evidentia.streaming import tail
from pyspark.sql import functions as F


def statement(i, belief=0.5, supports=(), n_ev=1, kind="Phosphorylation"):
    return {
        "type": kind, "enz": {"name": f"E{i}", "db_refs": {"HGNC": str(i)}}, "sub": {"name": f"S{i}", "db_refs": {}}, "belief": belief, "id": f"uuid{i}", "matches_hash": str(i - 1),
        "supports": list(supports), "supported_by": [], "evidence": [{"source_api": "reach", "text": f"t{i}-{j}", "source_hash": i * 10 + j, "epistemics": {"direct": True}} for j in range(n_ev)],
    }


@pytest.fixture()
def folder(tmp_path):
    data = [statement(0, belief=0, supports=["uuid1", "elsewhere"]), statement(1, n_ev=2), statement(2, n_ev=0)]
    (tmp_path / "a.json").write_text(json.dumps(data))
    (tmp_path / "c.json").write_text(json.dumps(data))
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump(data[1:], f)
    (tmp_path / "labels.jsonl").write_text('{"target": "5", "label": "x"}\n\n{bad\n{"target": "6"}\n{"label": "y"}\n')
    return str(tmp_path)


def test_sources(spark, folder):
    s = corpus.read_statements(spark, f"{folder}/a.json", 3)
    assert s.count() == 3 and corpus.read_statements(spark, f"{folder}/b.json.gz").count() == 2
    good, counts = corpus.read_lines(spark, f"{folder}/labels.jsonl", "target string, label string", ["target", "label"])
    assert [tuple(r) for r in good.collect()] == [("5", "x")]
    assert counts.first().asDict() == {"n_lines": 4, "bad_json": 1, "missing_target": 1, "missing_label": 1}
    assert {r.kind for r in corpus.discover(spark, folder).collect()} == {"json", "json.gz", "jsonl"}
    dup = {r.path.rsplit("/", 1)[1]: r.is_duplicate for r in corpus.duplicate_files(spark, folder).collect()}
    assert dup == {"a.json": False, "b.json.gz": False, "c.json": True, "labels.jsonl": False}
    p = corpus.preview(s).first()
    assert p.n_records == 3 and p.sources == ["reach"] and len(p.samples) == 3
    index = corpus.evidence_index(s).collect()
    assert {(r.source_hash, r.ev_index) for r in index} == {(0, 0), (10, 0), (11, 1)}
    assert corpus.checked("stmt_hash", "f" * 16) and pytest.raises(ValueError, corpus.checked, "run_id", "x")


def test_store(spark, folder, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/store").create().create()
    tables = corpus.tables(corpus.read_statements(spark, f"{folder}/a.json"), "dump")
    first = st.ingest(tables)
    assert first == {"statement": 3, "evidence": 3, "agent": 6, "supports_edge": 2}
    assert st.ingest(tables) == first  # a repeat changes nothing
    rows = {r.stmt_hash: r for r in st.read("statement").collect()}
    assert rows["f" * 16].published_belief == 1.0 and rows["0" * 16].published_belief == 0.5
    assert {r.to_hash for r in st.read("supports_edge").collect()} == {"0" * 16, "elsewhere"}
    v = st.version("statement")
    st.upsert("statement", st.read("statement").where("source_uuid = 'uuid1'").withColumn("published_belief", F.lit(0.9)))
    assert st.version("statement") == v + 1 and {r.published_belief for r in st.read("statement").collect()} == {1.0, 0.9, 0.5}
    st.replace("statement", "source_uuid = 'uuid2'")
    assert st.read("statement").count() == 2
    st.vacuum("statement")
    assert st.read("statement").count() == 2
    labels = spark.createDataFrame([("evidence", "a", "verdict", "correct"), ("evidence", "b", "verdict", "incorrect")], "target_kind string, target_id string, field string, value_text string")
    with pytest.raises(LookupError):
        st.load_labels(labels, "gold")
    st.register_truth_set("gold", "Gold")
    assert st.load_labels(labels, "gold") == (2, 2) and st.load_labels(labels.limit(1), "gold") == (1, 1)
    assert st.read("truth_label").count() == 2


def test_versions_are_whole(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/store").create()
    make = lambda *rows: spark.createDataFrame(rows, "key string, value string").coalesce(1)
    read = lambda: {r.key: r.value for r in st.read("schema_meta").where("key <> 'version'").collect()}
    st.upsert("schema_meta", make(("a", "1"), ("b", "1"), ("a", "2")))
    assert read() == {"a": "2", "b": "1"}  # of one key the last stays
    st.upsert("schema_meta", make(("a", "9"), ("a", "3")), order="value")
    assert read() == {"a": "9", "b": "1"}
    base = st.read("schema_meta")
    v = st.version("schema_meta")

    def dies(at):
        raise OSError("killed")

    # a writer that dies with its layer half written, and one that dies in the file of the next version
    (tmp_path / "store" / "schema_meta" / f"{v + 1:08d}-dead").mkdir()
    (tmp_path / "store" / "schema_meta" / "_versions" / f"{v + 1:08d}").write_text("0000")
    assert st.version("schema_meta") == v and read() == {"a": "9", "b": "1"}
    with pytest.raises(OSError):
        st.run("v", "m", dies)
    assert st.upsert("schema_meta", make(("c", "1"))) == v + 2 and read() == {"a": "9", "b": "1", "c": "1"}
    # a reader that began before a publish still reads its own version
    assert {r.key for r in base.collect()} == {"version", "a", "b"}
    # of two writers from one version the second fails, and leaves nothing
    seen, layers = st._current("schema_meta")
    st.upsert("schema_meta", make(("d", "1")))
    with pytest.raises(RuntimeError):
        st._publish("schema_meta", make(("e", "1")), layers, seen)
    assert read() == {"a": "9", "b": "1", "c": "1", "d": "1"}
    for i in range(store.LAYERS + 2):
        st.upsert("schema_meta", make(("n", str(i))))
        assert len(st._current("schema_meta")[1]) <= store.LAYERS
    assert read() == {"a": "9", "b": "1", "c": "1", "d": "1", "n": str(store.LAYERS + 1)}
    st.vacuum("schema_meta", keep=1)
    assert read()["n"] == str(store.LAYERS + 1) and not (tmp_path / "store" / "schema_meta" / f"{v + 1:08d}-dead").exists()


def test_keys_of_layers_are_not_broadcast(spark, tmp_path):
    """However small a layer's file is, its keys don't go through the driver."""
    s = store.Store(spark, f"file://{tmp_path}/b").create()
    for n in (1, 2, 3):
        s.upsert("statement", spark.range(4).select(F.concat(F.lit("k"), F.col("id") % (n + 1)).alias("stmt_hash"), F.lit(float(n)).alias("published_belief")))
    rows = s.read("statement")
    assert {r.stmt_hash: r.published_belief for r in rows.collect()} == dict.fromkeys(["k0", "k1", "k2", "k3"], 3.0)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_label_lines_and_run_hooks(spark, folder, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/store").create()
    st.register_truth_set("gold", "Gold")
    (tmp_path / "more.jsonl").write_text('{"target": "255", "label": "correct"}\n{"target": "00000000000000ff", "label": "incorrect"}\n{"target": "zz", "label": "x"}\n{"label": "y"}\n{oops\n')
    assert st.load_label_lines(f"file://{tmp_path}/more.jsonl", "gold") == {"n_lines": 5, "bad_json": 1, "missing_target": 1, "missing_label": 0, "bad_target": 1, "loaded": 2, "targets": 1}
    assert [(r.target_id, r.field) for r in st.read("truth_label").collect()] == [("00000000000000ff", "verdict")]
    steps = spark.createDataFrame([("s1", "e1", "aggregate", '{"score":0.9}', 12)], "stmt_hash string, evidence_hash string, step_kind string, output_json string, latency_ms int")
    called = []
    run = st.run("v1", "m", lambda r: steps, done=lambda r, n: called.append((r, n)), validity=lambda r: spark.createDataFrame([("mae", 0.5)], "metric_name string, value double"))
    assert called == [(run, 1)] and [(r.run_id, r.value, r.computed_at is None) for r in st.read("metric").collect()] == [(run, 0.5, False)]
    assert st.read("scorer_step").first().latency_ms == 12


def test_runs(spark, tmp_path):
    st = store.Store(spark, f"file://{tmp_path}/store").create()
    steps = spark.createDataFrame([("s1", "e1", "aggregate", '{"score":0.9}'), ("s1", "e2", "aggregate", '{"score":null}')], "stmt_hash string, evidence_hash string, step_kind string, output_json string")
    with pytest.raises(ValueError):
        st.run("v1", "m", lambda r: steps, estimate=5.0, limit=1.0)
    assert st.read("score_run").count() == 0
    one = st.run("v1", "m", lambda r: steps)
    two = st.run("v2", "m", lambda r: steps)
    again = st.run("v1", "m", lambda r: steps)  # the same key: rows move to the new run
    assert {r.run_id for r in st.read("scorer_step").select("run_id").distinct().collect()} == {two, again} and one not in {two, again}
    with pytest.raises(ZeroDivisionError):
        st.run("v3", "m", lambda r: 1 / 0)
    assert sorted(r.status for r in st.read("score_run").collect()) == ["failed", "succeeded", "succeeded", "succeeded"]
    st.require_run(two)
    with pytest.raises(LookupError):
        st.require_run("none")


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([("a", '{"id": "x", "belief": 0.3, "type": "T"}'), ("b", '{"id": "y"}')], "stmt_hash string, raw_json string")
    b = spark.createDataFrame([("a", 0.75)], "stmt_hash string, belief double")
    out = [json.loads(r.value) for r in store.export_beliefs(s, b).collect()]
    assert out == [{"id": "x", "belief": 0.75, "type": "T"}]
    assert store.export_beliefs(s, b.limit(0)).count() == 2
    both = b.unionByName(spark.createDataFrame([("b", 0.5)], "stmt_hash string, belief double"))
    assert [json.loads(r.value)["belief"] for r in store.export_beliefs(s, both).collect()] == [0.75, 0.5]
    metrics = spark.createDataFrame([("mae", float("nan"), None), ("bias", 0.5, None)], "metric_name string, value double, slice_json string")
    card = json.loads(store.model_card(spark.createDataFrame([("r",)], "run_id string"), metrics, spark.createDataFrame([("g", 3)], "truth_set_id string, n long")).first().value)
    assert card["format_version"] == 2 and [m["value"] for m in card["metrics"]] == [0.5, None]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    path = f"file://{tmp_path}/lines"
    assert store.append_new(rows.where("k = 1"), path, "k") == 1 and store.append_new(rows, path, "k") == 1 and spark.read.json(path).count() == 2


def test_stream(spark, tmp_path):
    src, schema = f"{tmp_path}/src", "id long, ts timestamp, event_type string, value double"
    rows = [(1, "2024-01-01 00:05:00", "a", 1.0), (1, "2024-01-01 00:06:00", "a", 2.0), (2, "2024-01-01 01:10:00", "b", 3.0)]
    make = lambda part: spark.createDataFrame(part, "id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    make(rows).coalesce(1).write.mode("append").parquet(src)
    seen: dict[int, float] = {}
    run = lambda: tail.upsert_stream(tail.event_stream(spark, src, schema), lambda b, n: seen.update({r.id: r.value for r in b.collect()}), "id", "ts", f"{tmp_path}/check").awaitTermination()
    run()
    assert seen == {1: 2.0, 2: 3.0}
    make([(2, "2024-01-01 02:00:00", "b", 9.0)]).write.mode("append").parquet(src)
    run()
    assert seen == {1: 2.0, 2: 9.0}
    q = tail.window_counts(tail.event_stream(spark, src, schema)).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check2").start()
    q.awaitTermination()
    assert {(r.event_type, r.n, r.total) for r in spark.table("w").collect()} >= {("a", 2, 3.0)}
    assert [n for n in range(1, 12) if tail.due(n, "score")] == [1, 2, 3, 4, 5, 10] and tail.due(100, "ingest") and not tail.due(150, "labels")
