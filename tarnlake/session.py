"""Session settings and shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Settings for large clusters; AQE sizes and splits the shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}

#: Shuffle files of a query go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCK = threading.Lock()
#: The setting before the first use, then a mark for each use.
_USES: list[str | None] = []


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnlake")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Only where that is unset on a local master (tests on one machine) a temporary folder is made and
    set; on a cluster it would be seen by the driver's machine alone, and so is an error.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(known)
        return known
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tarnlake-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends, if nothing deletes it before."""
    name = f"{shared_dir(spark).rstrip('/')}/tarnlake-{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return name


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go at their end; nested or parallel uses count, the last one out resets the setting."""
    with _LOCK:
        if not _USES:
            _USES.append(spark.conf.get(RELEASE, None))
            spark.conf.set(RELEASE, "true")
        _USES.append(None)
    try:
        yield
    finally:
        with _LOCK:
            _USES.pop()
            if len(_USES) == 1:
                before = _USES.pop()
                if before is None:
                    spark.conf.unset(RELEASE)
                else:
                    spark.conf.set(RELEASE, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a compressed copy to the shared folder and read it again: survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, label)
    # nothing reads this job's shuffle files again once the copy is written
    with _released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that may be joined by broadcast.
FEW_ROWS = 1 << 18


def near(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast if it has ``FEW_ROWS`` rows at most; else it is joined by shuffle."""
    return broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def discard(*copies: DataFrame) -> None:
    """Delete results of ``stored`` that nothing reads any more."""
    for df in copies:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("tarnlake-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
