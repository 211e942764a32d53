"""K2, K3: Structured Streaming forms.

K2 — triage of arriving messages. A message delivered again (a replayed file, a producer that
sends twice) is dropped by its id while the state remembers it: ``dropDuplicatesWithinWatermark``
on the event time, or on the arrival time of its file where messages carry no time. The state
holds the ids of one ``remember`` period. ``row_number`` windows (top-k) are not allowed on a
streaming DataFrame, so each micro-batch then runs the batch triage (K1) through
``foreachBatch`` against the static, checkpointed index. Writes are idempotent per batch id:
every batch overwrites its own ``batch_id=<n>`` folder, so a replay after a failure rewrites
the same rows. Blank messages are rejected; k must be in 1..10. Messages without an id are never
duplicates. Of two different texts with one id in one batch either may stay.

K3 — decision-rate monitor: event-time windows with a watermark; state for a window is dropped
once the watermark passes its end, so state stays bounded. Every micro-batch writes the windows
it changed with their full counts (update mode), and ``read_monitor`` takes the last count of
each window: windows that are still open when the source ends are there too. A row that comes
later than the watermark allows is not counted.

The trigger is the caller's (default: all files there are, then stop).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.plans.triage import triage
from threadlens.session import cut_lineage, ensure_checkpoint_dir


ALL_THERE_IS = {"availableNow": True}


def _files(spark: SparkSession, source_dir: str, schema: str, glob: str | None, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        # a table is one file or a folder of files: a pattern finds both, a name only the folder
        name = glob if set(glob) & set("*?[{") else f"{glob[:-1]}[{glob[-1]}]"
        source_dir = f"{source_dir.rstrip('/')}/{name}"
    return reader.parquet(source_dir)


def drop_redelivered(stream: DataFrame, message_id: str, time: str, remember: str) -> DataFrame:
    """One row per message id within ``remember`` of ``time``; rows without an id all stay."""
    keyed = stream.withColumn("_key", F.coalesce(F.col(message_id).cast("string"), F.expr("uuid()")))
    return keyed.withWatermark(time, remember).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_triage_stream(spark: SparkSession, source_dir: str, schema: str, indexed_records: DataFrame,
                      out_dir: str | None = None, k: int = 3, message_id: str = "message_id",
                      text: str = "text", prepare=None, glob: str | None = None, event_time: str | None = None,
                      remember: str = "1 day", trigger: dict | None = None, files_per_batch: int | None = None,
                      **triage_kw) -> str:
    """Run K2 over the parquet files in ``source_dir`` until the trigger ends it; returns the
    output folder. ``prepare`` maps the source rows to messages and must keep ``event_time``
    (by default a column ``_arrived`` that is added and must be kept: the file's time)."""
    if not 1 <= k <= 10:
        raise ValueError("k must be between 1 and 10")
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"triage-{uuid.uuid4().hex}")
    index = indexed_records          # ``index_side`` output: already materialised
    n_index = index.count()
    stream = _files(spark, source_dir, schema, glob, files_per_batch)
    if event_time is None:
        event_time = "_arrived"
        stream = stream.select("*", F.col("_metadata.file_modification_time").alias(event_time))
    if prepare is not None:
        stream = prepare(stream)
    stream = stream.filter(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    stream = drop_redelivered(stream, message_id, event_time, remember)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch)     # the state is read once
        if batch_id and rows.isEmpty():
            return                    # a batch that only moves the watermark
        out = triage(rows, index, k=k, message_id=message_id, text=text, n_index=n_index, **triage_kw)
        out.write.mode("overwrite").parquet(os.path.join(base, "rows", f"batch_id={batch_id}"))

    q = (stream.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(**(trigger or ALL_THERE_IS)).start())
    q.awaitTermination()
    return os.path.join(base, "rows")


def decision_rate(events: DataFrame, decision, ts: str = "ts", window: str = "1 hour",
                  watermark: str | None = "10 minutes") -> DataFrame:
    """K3: rows per (event-time window, decision). Works on a batch or a
    streaming DataFrame; on a stream the watermark bounds the state."""
    e = events.withColumn("decision", decision)
    if watermark and e.isStreaming:
        e = e.withWatermark(ts, watermark)
    return (e.groupBy(F.window(ts, window).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "decision", "n_rows"))


def run_decision_monitor(spark: SparkSession, source_dir: str, schema: str, decision, out_dir: str | None = None,
                         glob: str | None = None, trigger: dict | None = None, files_per_batch: int | None = None, **kw) -> str:
    """K3 as a stream; returns the folder that ``read_monitor`` reads."""
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"monitor-{uuid.uuid4().hex}")
    agg = decision_rate(_files(spark, source_dir, schema, glob, files_per_batch), decision, **kw)

    def per_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(os.path.join(base, "rows", f"batch_id={batch_id}"))

    q = (agg.writeStream.outputMode("update").foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(base, "_checkpoint"))
         .trigger(**(trigger or ALL_THERE_IS)).start())
    q.awaitTermination()
    return os.path.join(base, "rows")


def read_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """The last count of every (window, decision); ``batch_id`` is the folder's name."""
    return (spark.read.parquet(folder).groupBy("window_start", "window_end", "decision")
            .agg(F.max_by("n_rows", "batch_id").alias("n_rows")))
