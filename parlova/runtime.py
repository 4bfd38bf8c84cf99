"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


ARROW_BATCH_BYTES = 64 << 20


def build_session(app_name: str = "parlova", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts; on a cluster master and sizing come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (no cluster sizing)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Rows with long texts must not fill a batch by their number alone.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode with nothing configured.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlova-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    created = _scope.get()
    if created is not None:
        created.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Delete the intermediate tables made inside the block when it ends.

    Results that outlive the block must be written elsewhere before, or stored by the function that the
    block is given: what it stores belongs to the block around this one.
    """
    created: list[str] = []
    outer = _scope.get()
    token = _scope.set(created)

    def keep(*parts: DataFrame) -> DataFrame:
        inner = _scope.set(outer)
        try:
            return materialize(*parts)
        finally:
            _scope.reset(inner)

    try:
        yield keep
    finally:
        _scope.reset(token)
        _delete(spark, created)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside the block go when it ends, not when the driver collects its garbage.

    For queries that run once, such as the writing of a table: a second run would make the files again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(*parts: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    A lost executor then costs a re-read, not a recomputation; later readers get
    column pruning, filter pushdown and true size statistics. Several parts (same columns) are written one
    after the other into one table, so the shuffle files of one part at a time are on the disks.
    """
    spark = parts[0].sparkSession
    path = scratch_path(spark, "table")
    with shuffles_released(spark):
        for part in parts:
            part.write.mode("append").parquet(path, compression="zstd")
    stored = spark.read.schema(parts[0].schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once no result reads them any more."""
    for df in stored:
        _delete(df.sparkSession, [df._stored_at])
