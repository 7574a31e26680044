"""Where intermediate tables live.

Lineage is cut by writing a table to the folder that the cluster names in ``spark.checkpoint.dir``, which driver
and executors share.  Only a local session without that setting (a test) gets a folder of its own; on a cluster it has
to be set.  Each application writes in a folder of its own there, which is deleted when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS: dict[tuple[str, str], str] = {}


def _shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_root(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    key = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", "")
    if key not in _RUNS:
        _RUNS[key] = f"{_shared_root(spark)}/quern-{key[0]}-{uuid.uuid4().hex[:8]}"
        sc = spark.sparkContext
        atexit.register(_delete, sc._jvm, sc._jsc.hadoopConfiguration(), _RUNS[key])
    return _RUNS[key]


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # at the end of the process the session's JVM may be gone already
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of what was written."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_stage(df: DataFrame | None) -> None:
    """Delete a table of :func:`stage_table` that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def default_partitions(spark: SparkSession) -> int:
    """Shuffle partitions that the cluster's owner has sized for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, label: str, rows: int = 1 << 20) -> DataFrame:
    """``df`` written once, and marked for broadcast if it has at most ``rows`` rows; else joins shuffle it as usual."""
    held = stage_table(df, label)
    return F.broadcast(held) if held.limit(rows + 1).count() <= rows else held
