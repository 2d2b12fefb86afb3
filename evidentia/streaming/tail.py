"""The live tail: events upserted as they come, windowed counts, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def event_stream(spark: SparkSession, path: str, schema, files_at_once: int | None = None, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).load(path)


def window_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` are no longer counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def latest_by_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*")


def upsert_stream(events: DataFrame, upsert: Callable[[DataFrame, int], None], key: str, order: str, checkpoint: str, **options) -> StreamingQuery:
    """Gives each micro-batch's latest row by key to ``upsert(rows, batch number)``, which may meet a batch again."""
    writer = events.writeStream.option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, n: upsert(latest_by_key(batch, key, order), n)).start()


def due(n: int, kind: str) -> bool:
    """Whether the n-th item of a kind is worth a progress line: often at first, then less so."""
    if kind == "ingest":
        return n % (100 if n <= 1000 else 500 if n <= 10_000 else 2500) == 0
    if kind == "score":
        return n <= 5 or n % (5 if n <= 50 else 25) == 0
    return n % 200 == 0


class Progress(StreamingQueryListener):
    """Keeps what streaming queries report: rows and batches so far, by query."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        self.batches[key] = self.batches.get(key, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))


def cancel(query: StreamingQuery) -> None:
    query.stop()


def observed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row count that listeners see as it runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
