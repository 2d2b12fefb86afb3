"""The corpus store: tables as snapshots, upserts by key, runs, exports.

A table is a folder of layers and of numbered versions. A version is a small file that names
the layers of which the table then consists, newest first: a row of a newer layer stands for
those of its key below. A writer makes a layer under a name of its own, and only then the file
of the next number, which is created once or not at all. So readers always see a whole
version, of two writers from one version the second fails, and what a writer that died has
left behind is nobody's version: the next one goes on past it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
#: The tables, their columns and keys.
TABLES: dict[str, tuple[str, list[str]]] = {
    "statement": ("stmt_hash string, source_uuid string, stmt_type string, published_belief double, supports_count int, supported_by_count int, raw_json string, source_dump_id string, loaded_at timestamp", ["stmt_hash"]),
    "evidence": ("evidence_hash string, stmt_hash string, source_api string, source_id string, pmid string, text string, is_direct boolean, is_negated boolean, is_curated boolean, epistemics_json string, annotations_json string, raw_json string", ["evidence_hash"]),
    "agent": ("stmt_hash string, agent_hash string, role string, role_index int, name string, db_refs_json string, mods_json string, mutations_json string, bound_conditions_json string, activity_json string, location string", ["stmt_hash", "agent_hash", "role", "role_index"]),
    "supports_edge": ("from_hash string, to_hash string, kind string, source_dump_id string", ["from_hash", "to_hash", "kind"]),
    "truth_set": ("id string, name string, source string, version string, description string, loaded_at timestamp", ["id"]),
    "truth_label": ("truth_set_id string, target_kind string, target_id string, relation_target_id string, field string, value_text string, value_json string, confidence double, provenance string", ["truth_set_id", "target_kind", "target_id", "field"]),
    "score_run": ("run_id string, scorer_version string, model_id string, started_at double, finished_at double, n_stmts long, status string, cost_estimate_usd double, cost_actual_usd double, notes string", ["run_id"]),
    "scorer_step": ("step_hash string, stmt_hash string, evidence_hash string, run_id string, scorer_version string, model_id string, step_kind string, by_rules boolean, input_json string, output_json string, latency_ms int, prompt_tokens int, out_tokens int, finish_reason string, error string, started_at timestamp", ["step_hash"]),
    "metric": ("run_id string, truth_set_id string, metric_name string, value double, slice_json string, computed_at timestamp", ["run_id", "truth_set_id", "metric_name", "slice_json"]),
    "schema_meta": ("key string, value string", ["key"]),
}
#: Layers of a table; one more and they are written as one.
LAYERS = 8
#: Columns that are set to the time of writing where they are null.
STAMPS = ("loaded_at", "computed_at")


class Store:
    """Versioned tables below a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> "Store":
        """Makes missing tables and notes the schema's version; may be repeated."""
        for name in TABLES:
            if self.version(name) < 0:
                self._publish(name, self.spark.createDataFrame([], TABLES[name][0]), [], -1)
        self.upsert("schema_meta", self.spark.createDataFrame([("version", VERSION)], TABLES["schema_meta"][0]))
        return self

    def _versions(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit())

    def _layers(self, name: str, version: int) -> list[str] | None:
        """The layers of a version, newest first; None for one that was begun and not written out."""
        stream = self._fs.open(self._path(f"{self.root}/{name}/_versions/{version:08d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1].split(",") if text.endswith("\n") else None

    def _current(self, name: str) -> tuple[int, list[str]]:
        for v in reversed(self._versions(name)):
            if (layers := self._layers(name, v)) is not None:
                return v, layers
        return -1, []

    def version(self, name: str) -> int:
        """The number of a table's current version, -1 if there is none: a change marks new data."""
        return self._current(name)[0]

    def _read(self, name: str, layers: list[str]) -> DataFrame:
        ddl, key = TABLES[name]
        out = None
        for layer in reversed(layers):
            rows = self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/{layer}")
            out = rows if out is None else _minus(out, rows, key).unionByName(rows)
        return out

    def read(self, name: str) -> DataFrame:
        v, layers = self._current(name)
        if v < 0:
            raise LookupError(f"no table {name}")
        return self._read(name, layers)

    def _publish(self, name: str, rows: DataFrame, below: list[str], seen: int) -> int:
        """Writes ``rows`` as a layer over those ``below`` and makes that the version after all that are begun.

        ``seen`` is the version on which the rows rest: if another one has come since, this fails.
        """
        v = max([-1, *self._versions(name)]) + 1
        layer = f"{v:08d}-{uuid.uuid4().hex}"
        for stamp in (c for c in STAMPS if c in rows.columns):
            rows = rows.withColumn(stamp, F.coalesce(stamp, F.current_timestamp()))
        rows.write.parquet(f"{self.root}/{name}/{layer}")
        try:
            if self.version(name) != seen:
                raise RuntimeError(f"another writer changed {name}")
            out = self._fs.create(self._path(f"{self.root}/{name}/_versions/{v:08d}"), False)
        except Exception as e:
            self._fs.delete(self._path(f"{self.root}/{name}/{layer}"), True)
            raise RuntimeError(f"another writer changed {name}") from e
        out.writeBytes(",".join([layer, *below]) + "\n")
        out.close()
        return v

    def upsert(self, name: str, rows: DataFrame, order: str | None = None) -> int:
        """Inserts rows, replacing those with the same key.

        Of rows with one key the last by ``order`` stays, by default the last one as they are
        read. Only these rows are written, but for each ``LAYERS``-th time, when all are.
        """
        ddl, key = TABLES[name]
        v, layers = self._current(name)
        names = self.spark.createDataFrame([], ddl).columns
        shaped = _shaped(rows.withColumn("__at", F.struct(*([F.col(order).alias("o")] if order else []), F.monotonically_increasing_id().alias("i"))), self.spark.createDataFrame([], ddl), "__at")
        last = shaped.groupBy(*key).agg(F.max_by(F.struct(*[c for c in names if c not in key]), "__at").alias("r")).select(*key, "r.*").select(*names)
        if len(layers) < LAYERS:
            return self._publish(name, last, layers, v)
        return self._publish(name, _minus(self._read(name, layers), last, key).unionByName(last), [], v)

    def replace(self, name: str, gone: str, rows: DataFrame | None = None) -> int:
        """Deletes what a predicate holds for (null: not) and appends rows, as one version."""
        v, layers = self._current(name)
        kept = self._read(name, layers).where(~F.coalesce(F.expr(gone), F.lit(False)))
        return self._publish(name, kept.unionByName(_shaped(rows, kept)) if rows is not None else kept, [], v)

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Removes versions older than the last ``keep``, and layers that no later version has.

        Layers of a number beyond the current version may be some writer's and stay.
        """
        current = self.version(name)
        known = [v for v in self._versions(name) if self._layers(name, v) is not None]
        used = {layer for v in known[-keep:] for layer in self._layers(name, v)}
        for v in (v for v in self._versions(name) if v < min(known[-keep:], default=0)):
            self._fs.delete(self._path(f"{self.root}/{name}/_versions/{v:08d}"), False)
        for f in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            layer = f.getPath().getName()
            if layer[:8].isdigit() and int(layer[:8]) <= current and layer not in used:
                self._fs.delete(f.getPath(), True)

    def ingest(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Upserts the corpus tables and returns how many rows each has."""
        for name, rows in tables.items():
            self.upsert(name, rows)
        return {name: self.read(name).count() for name in tables}

    def register_truth_set(self, set_id: str, name: str, source: str = "", version: str = "", description: str = "") -> None:
        self.upsert("truth_set", self.spark.createDataFrame([(set_id, name, source, version, description)], "id string, name string, source string, version string, description string"))

    def load_labels(self, labels: DataFrame, set_id: str) -> tuple[int, int]:
        """Replaces labels with the same natural key; the set must be registered. Returns rows and distinct targets."""
        if self.read("truth_set").where(F.col("id") == set_id).isEmpty():
            raise LookupError(f"no truth set {set_id}")
        rows = labels.withColumn("truth_set_id", F.lit(set_id))
        self.upsert("truth_label", rows)
        n = rows.agg(F.count(F.lit(1)), F.countDistinct("target_id")).first()
        return n[0], n[1]

    def run(self, version: str, model: str, score, estimate: float | None = None, limit: float | None = None, done=None, validity=None) -> str:
        """Scores by ``score(run_id)``, a function to step rows, between a run's beginning and end.

        An estimate over the limit is refused before anything is written. A run that fails is
        noted as failed and its error goes on. After one that succeeds, ``validity(run_id)``, a
        function to rows of ``metric``, is stored, and ``done(run_id, n_stmts)`` is called.
        """
        if limit is not None and estimate is not None and estimate > limit:
            raise ValueError(f"estimated cost {estimate} is over the limit {limit}")
        run_id = uuid.uuid4().hex
        row = {"run_id": run_id, "scorer_version": version, "model_id": model, "started_at": time.time(), "finished_at": None, "n_stmts": None, "status": "running", "cost_estimate_usd": estimate, "cost_actual_usd": None, "notes": None}
        note = lambda **x: self.upsert("score_run", self.spark.createDataFrame([tuple((row | x).values())], TABLES["score_run"][0]))
        note()
        status, n = "failed", None
        try:
            steps = score(run_id).withColumn("run_id", F.lit(run_id)).withColumn("scorer_version", F.lit(version)).withColumn("model_id", F.lit(model))
            self.upsert("scorer_step", steps.withColumn("step_hash", step_hash()))
            n = self.read("scorer_step").where(F.col("run_id") == run_id).agg(F.countDistinct("stmt_hash")).first()[0]
            status = "succeeded"
        finally:
            note(finished_at=time.time(), status=status, n_stmts=n)
        if validity:
            self.upsert("metric", validity(run_id).withColumn("run_id", F.lit(run_id)))
        if done:
            done(run_id, n)
        return run_id

    def load_label_lines(self, path: str, set_id: str, field: str = "verdict", kind: str = "evidence") -> dict[str, int]:
        """Labels from JSON lines (``target`` a decimal or hex hash, ``label``) into a registered set.

        Returns counts: lines, those that are no JSON or lack a field or have no such hash, rows and targets loaded.
        """
        from ..operators.claims import statement_key
        from .corpus import read_lines

        good, counts = read_lines(self.spark, path, "target string, label string, confidence double, provenance string", ["target", "label"])
        rows = good.withColumn("target_id", statement_key(F.col("target")))
        bad = rows.where("target_id is null").count()
        rows = rows.where("target_id is not null").select(F.lit(kind).alias("target_kind"), "target_id", F.lit(field).alias("field"), F.col("label").alias("value_text"), "confidence", "provenance")
        loaded, targets = self.load_labels(rows, set_id)
        return counts.first().asDict() | {"bad_target": bad, "loaded": loaded, "targets": targets}

    def require_run(self, run_id: str) -> None:
        if self.read("score_run").where(F.col("run_id") == run_id).isEmpty():
            raise LookupError(f"no run {run_id}")


def step_hash():
    """A step's key: statement, evidence, version, model and kind; not the run, so a repeat replaces."""
    return F.substring(F.sha2(F.concat_ws("|", "stmt_hash", F.coalesce("evidence_hash", F.lit("")), "scorer_version", F.coalesce("model_id", F.lit("")), "step_kind"), 256), 1, 16)


def _shaped(rows: DataFrame, like: DataFrame, *more: str) -> DataFrame:
    have = set(rows.columns)
    return rows.select(*more, *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def _minus(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key ``new`` lacks.

    Keys are never broadcast: Spark takes a layer for as small as its file's share of the key
    columns, and in the driver millions of them are many times that.
    """
    marks = new.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = c if same is None else same & c
    return rows.join(marks.hint("merge"), same, "left_anti")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, that with the largest ``order``."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def export_beliefs(statements: DataFrame, beliefs: DataFrame, only_scored: bool = True) -> DataFrame:
    """Statements' JSON with our belief in it, by statement key.

    ``only_scored``: without those that have none; if none at all has one, all are given.
    """
    joined = statements.select("stmt_hash", "raw_json").join(beliefs.select("stmt_hash", "belief"), "stmt_hash", "left")
    if only_scored and not beliefs.isEmpty():
        joined = joined.where("belief is not null")
    body = F.when(F.col("belief").isNull(), F.col("raw_json")).otherwise(_with_number(F.col("raw_json"), "belief", F.col("belief")))
    return joined.select("stmt_hash", body.alias("value")).orderBy("stmt_hash")


def _with_number(doc, name: str, value):
    """A JSON object's text with a top-level number replaced or, if missing, added first."""
    pattern = rf'("{name}"\s*:\s*)(-?[0-9.eE+-]+|null)'
    return F.when(F.get_json_object(doc, f"$.{name}").isNotNull(), F.regexp_replace(doc, F.lit(pattern), F.concat(F.lit("$1"), value.cast("string")))).otherwise(F.regexp_replace(doc, F.lit(r"^\s*\{"), F.concat(F.lit(f'{{"{name}":'), value.cast("string"), F.lit(","))))


def model_card(run: DataFrame, metrics: DataFrame, coverage: DataFrame) -> DataFrame:
    """One JSON document on a run: itself, its metrics (NaN as null) and truth coverage."""
    m = metrics.select("metric_name", F.when(~F.isnan("value"), F.col("value")).alias("value"), "slice_json").agg(F.array_sort(F.collect_list(F.struct("metric_name", "value", "slice_json"))).alias("metrics"))
    c = coverage.agg(F.array_sort(F.collect_list(F.struct("truth_set_id", "n"))).alias("coverage"))
    one = run.limit(1).select(F.struct(*run.columns).alias("run")).crossJoin(m).crossJoin(c)  # a row each
    return one.select(F.to_json(F.struct(F.lit(2).alias("format_version"), "run", "metrics", "coverage"), {"ignoreNullFields": "false"}).alias("value"))


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key the JSON lines at ``path`` lack: a run can be resumed."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        done = spark.read.schema(rows.select(key).schema).json(path).distinct()
        rows = rows.join(done, key, "left_anti")
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").json(path)
        return n
    finally:
        rows.unpersist()
