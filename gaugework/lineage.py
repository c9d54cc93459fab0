"""Reliable lineage cuts and scratch tables in the folder that ``spark.checkpoint.dir`` names.

Everything written here must outlive an executor, so only ``checkpoint()`` and written tables in the
shared folder are used. A machine-local folder is chosen only for a local master with the setting unset.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    return tempfile.mkdtemp(prefix="gaugework-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably. Partition ids and the order inside partitions are fixed from here on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table that one job writes and another reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made inside drop their shuffle files when they are done, not when the driver happens to collect its garbage.

    For rounds: what a round leaves is checkpointed, so its shuffles are not read again; if they are, they are made anew.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def drop_checkpoint(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``cut_lineage`` gave and that nothing reads any more: a round's, once the next one's are written."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile() if df is not None else None
        if file is not None and file.isDefined():
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_place(df: DataFrame) -> DataFrame:
    """Keep a table where its last shuffle has put it; a lost block is computed anew from the source.

    The shuffles that filled it are dropped. They would be read for lost blocks alone, and are then made anew.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()  # filled before its first join: only then do the joins see that it is partitioned
    try:
        ids = kept._jdf.queryExecution().withCachedData().cacheBuilder().cachedPlan().context().shuffleIds()
        cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner().get()
        for number in list(ids.keys()):
            cleaner.doCleanupShuffle(number, True)
    except Py4JError:  # no adaptive plan, or no cleaner: the files stay as long as the table
        pass
    return kept
