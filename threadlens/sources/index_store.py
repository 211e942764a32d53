"""A4: persist / load a vector index as Parquet (vector_id, conversation_id,
embedding) plus a one-row metadata table, in versions; build on first load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.vectors import l2_normalize
from threadlens.operators.ordering import CHUNK_ROWS, ordinal_within

METRIC = "inner_product_normalized_cosine"


def index_table(records: DataFrame, id_col: str = "conversation_id", vec_col: str = "embedding",
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense 0-based ``vector_id`` in id order (chunked ordinal, no
    single-partition window), normalised embedding."""
    base = records.select(F.col(id_col).cast("long").alias("conversation_id"),
                          l2_normalize(vec_col).alias("embedding"), F.lit(0).alias("_g"))
    return (ordinal_within(base, "_g", "conversation_id", "_pos", chunk_rows)
            .select((F.col("_pos") - 1).cast("long").alias("vector_id"), "conversation_id", "embedding"))


def index_metadata(index: DataFrame) -> DataFrame:
    """dim, metric, ntotal in one aggregate."""
    return index.agg(F.max(F.size("embedding")).cast("int").alias("dim"), F.lit(METRIC).alias("metric"),
                     F.count(F.lit(1)).alias("ntotal"))


# --- versions ------------------------------------------------------------------
# path/versions/<id>/...   written once, never changed
# path/CURRENT-<number>    a small text file that names a version; the largest number counts
#
# A version is published by renaming one finished file into place, which file systems do as
# one step, so a reader finds either the version before or the new one, complete. A save that
# dies earlier leaves the index as it was.

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.split("-")[1]) for n in names if n.startswith("CURRENT-") and n.split("-")[1].isdigit())


def _folder(uri: str) -> str:
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def publish(spark: SparkSession, path: str, write) -> str:
    """Call ``write(folder)`` on a new version folder and make it the current one."""
    version = uuid.uuid4().hex
    root, fs = _fs(spark, path)
    fs.mkdirs(root)
    folder = _folder(fs.makeQualified(_fs(spark, f"{path}/versions/{version}")[0]).toString())
    write(folder)
    draft, _ = _fs(spark, f"{path}/draft-{version}")
    stream = fs.create(draft, True)
    stream.writeBytes(version)
    stream.close()
    while True:  # another writer may take the number first
        number = max([0, *_manifests(spark, path)]) + 1
        if fs.rename(draft, _fs(spark, f"{path}/CURRENT-{number}")[0]):
            return folder


def current(spark: SparkSession, path: str) -> str:
    """Folder of the current version."""
    numbers = _manifests(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no vector index at {path}")
    p, fs = _fs(spark, f"{path}/CURRENT-{numbers[-1]}")
    stream = fs.open(p)
    name = bytes(stream.readAllBytes()).decode()
    stream.close()
    return _folder(fs.makeQualified(_fs(spark, f"{path}/versions/{name}")[0]).toString())


def save_index(index: DataFrame, path: str) -> str:
    """Write ``index`` and its metadata as a new version; returns its folder."""
    spark = index.sparkSession

    def write(folder: str) -> None:
        index.write.parquet(f"{folder}/vectors")
        index_metadata(spark.read.parquet(f"{folder}/vectors")).write.parquet(f"{folder}/meta")

    return publish(spark, path, write)


def load_index(spark: SparkSession, path: str, build_from: DataFrame | None = None, **kw):
    """Return (index, metadata) of the current version; builds and saves one from
    ``build_from`` when no version has been published. Any other read error is raised: an
    index that is there is never replaced."""
    if not _manifests(spark, path):
        if build_from is None:
            raise FileNotFoundError(f"no vector index at {path}")
        save_index(index_table(build_from, **kw), path)
    folder = current(spark, path)
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/meta")
