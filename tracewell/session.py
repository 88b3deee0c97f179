"""Session set-up and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Temporary folders of sessions without the setting, by application; tables written by ``cut`` and not yet removed.
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent on one machine (tests), the session's temporary folder stands in and is removed at the
    end of the process; on a cluster its absence is an error.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, removed as the tables of ``cut`` are."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back.

    Unlike a local checkpoint the result does not live on an executor, and unlike
    an RDD checkpoint it keeps column pruning and real sizes for the optimizer. ``release`` removes the tables; at the end of
    the process those left are removed.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(keep: int = 0) -> int:
    """Remove the tables written by ``cut`` but the first ``keep``; results that were built on them must have been used."""
    gone = 0
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session's gateway may be gone at the end of the process
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
    return gone


@contextmanager
def scratch():
    """Within it the tables of ``cut`` live; they are removed at its end."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


@atexit.register
def _at_end() -> None:
    release()
    for folder in _own.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
