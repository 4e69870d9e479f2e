"""Session and storage-location helpers.

The library never invents a machine-local scratch folder on a cluster: the
shared folder comes from ``spark.checkpoint.dir`` as configured by whoever
launched the session. Only tests and the local bench set their own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# of tables that a later step reads again
COMPRESSION = "zstd"
# whether a finished query's shuffle files go at once, not when the driver's
# garbage collection finds them
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "askbatch", extra: dict | None = None) -> SparkSession:
    """Session for tests and the local bench (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the session, if any."""
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set one only when unset.

    A local-mode session (tests, bench) without a configured folder gets a
    fresh temporary one. On a cluster an unset folder is an error, because a
    machine-local path would not survive the loss of an executor.
    """
    d = checkpoint_dir(spark)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at a shared folder")
        d = tempfile.mkdtemp(prefix="askbatch-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.conf.get(CHECKPOINT_CONF, None) or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_parallelism(df, min_partitions: int | None = None):
    """Round-robin repartition only when the scan yields too few partitions
    to keep every core busy (small files); large inputs keep their splits."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def checkpointed(df, name: str = "cut"):
    """Cut lineage by writing the frame as a parquet table under the
    session's shared checkpoint folder and reading it back.

    One job computes and writes it (a reliable RDD checkpoint of an uncached
    plan computes it twice); the table read back has file statistics, so a
    later size check or broadcast decision is cheap. Never a local
    checkpoint: the data must survive the loss of the executor that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=COMPRESSION)
    return spark.read.parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries that end inside leave no shuffle files. For steps that are cut
    to tables: nothing reads their shuffles again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


class CutTables:
    """Tables of `checkpointed` that leave the shared folder when the steps
    that read them are done. A folder that pyarrow cannot open keeps them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df, name: str):
        path = scratch_path(self.spark, name)
        with shuffles_freed(self.spark):
            df.write.parquet(path, compression=COMPRESSION)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name)
            try:
                filesystem, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                filesystem.delete_dir(at)
            except (pa.ArrowInvalid, OSError):
                continue


# Default limits for a broadcast side.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 256 << 20


def fits_broadcast(df, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a candidate broadcast side: row count and serialized size
    (JSON bytes of every row, an upper-side estimate) in one pass. Both must
    be under their limits, so a few very long rows cannot pass a row-only
    check."""
    from pyspark.sql import functions as F
    if max_rows <= 0:
        return False
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless they
    have it on PYTHONPATH already. Same as --py-files at submission."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    made = Path(tempfile.mkdtemp(prefix="askbatch-ship-")) / "askbatch.zip"
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted((root / "askbatch").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(made))
