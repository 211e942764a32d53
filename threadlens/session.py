"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE re-plans joins and coalesces partitions at
# runtime, and its skew-join rule splits a hot join key (one conversation or one
# parent message holding a large share of rows) across several tasks.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "threadlens", extra: dict | None = None) -> SparkSession:
    """Return a session with the settings above (``getOrCreate`` keeps an
    existing cluster session and only fills in what is missing)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor (no effect on a cluster)
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``checkpoint()`` at the shared folder named by ``spark.checkpoint.dir``.

    On a cluster that setting must name shared storage; it is read from the
    session and never replaced. Only a local-mode session without the setting
    (tests, laptops) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder; iterative operators checkpoint there")
    path = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder (reliable, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held(rows: DataFrame) -> DataFrame:
    """``rows`` as a compressed table in the checkpoint folder, which knows its own size. A
    checkpoint is not compressed and keeps the size estimated for its plan: for a join the
    product of both sides, so the state of a loop that joins is held this way (else the
    estimate of every round multiplies that of the last and its digits fill the driver)."""
    spark = rows.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/held-{uuid.uuid4().hex}"
    with swept(spark):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_set_lock = threading.Lock()
_set_before: dict[tuple, list] = {}  # of a session and key: setting before, jobs that hold it


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """Jobs run inside have ``value`` for ``key``. The setting before comes back when the last of
    the jobs that a session runs at a time has ended."""
    with _set_lock:
        state = _set_before.setdefault((id(spark), key), [spark.conf.get(key, None), 0])
        state[1] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _set_lock:
            state[1] -= 1
            if state[1] == 0:
                before = _set_before.pop((id(spark), key))[0]
                spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def swept(spark: SparkSession):
    """Queries that end inside leave no shuffle files: a table that is written or collected
    needs them no more, and they would stay until the driver's memory is collected."""
    return _setting(spark, SWEEP, "true")


def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside send ``rows`` rows to a Python worker at once, not as many as 64 MB
    hold: a worker keeps the batch it works on and the next one."""
    return _setting(spark, ARROW_ROWS, str(rows))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``threadlens`` importable in Python workers (the blocked vector
    search and the full entity table run Python inside tasks): zip the package
    once per application and hand it to ``SparkContext.addPyFile``, which
    distributes it to every executor. The zip on the driver is only the
    source of that distribution."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "threadlens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
