"""Session helpers and lineage cuts.

``materialize`` writes an intermediate result as Parquet into the shared
folder named by ``spark.checkpoint.dir`` and reads it back.  It is used where
two branches of a plan must see exactly the same rows (e.g. range-partition
ids feeding both a per-row and a per-chunk computation), and to cut long
lineages.  The folder is read from the session; a private temporary folder is
created only when the session has none (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Generated code for wide synthetic rows (hash draws, normal CDFs, quantile
# interpolation for many columns) exceeds HotSpot's 8000-bytecode JIT limit;
# without this flag those stages run interpreted (measured 5x slower).
JIT_HUGE_METHODS = "-XX:-DontCompileHugeMethods"


#: Spark's switch to drop a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "facsimile", driver_memory: str = "16g") -> SparkSession:
    """Local/test session.  On a cluster set the same keys in the job config
    (in particular ``spark.executor.extraJavaOptions``)."""
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.extraJavaOptions", JIT_HUGE_METHODS)
        .config("spark.executor.extraJavaOptions", JIT_HUGE_METHODS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="facsimile-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """What the jobs inside shuffle goes with each job's end, and does not lie beside all that follows."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/facsimile/{tag}-{uuid.uuid4().hex}"
    with dropped_shuffles(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(f"{checkpoint_root(spark)}/facsimile").toUri().getPath()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = fs.Path(path)
        if where.getParent().toUri().getPath() == root:
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
