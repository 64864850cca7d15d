"""Session helpers: settings for local runs and tables kept in the folder that the whole cluster sees."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_OWN_DIRS: dict[str, str] = {}
#: Tables made by materialise and not released yet.
_KEPT: list[str] = []


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("graphloom")
    conf = LOCAL_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing a session on one machine gets a temporary folder, which is used from then on; on a cluster that is an error, as executors would
    each write to a folder of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _OWN_DIRS.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="graphloom-")
        _OWN_DIRS[app] = found
    return found.rstrip("/")


#: Bytes of a batch between the JVM and Python while a table is kept; both sides and the buffers between hold some at a time.
BATCH_BYTES = 8 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of ``most`` bytes at most for the queries that run inside; the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._graphloom_path = path
    _KEPT.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _KEPT:
        _KEPT.remove(path)


def release(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later plan reads."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> int:
    """Delete every kept table of this process, once no result that reads one is needed any more; gives their number.

    Results are lazy, so the tables that they read must outlive the call that made them.
    """
    paths = list(_KEPT)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
