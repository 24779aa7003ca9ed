"""Session set-up and lineage control."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Names of the AQE switches the jobs rely on; all are Spark defaults, stated so
# that a cluster profile that turned them off is noticed.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "kgspark", memory: str = "16g") -> SparkSession:
    """A local session for tests and bench.py; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temp folder only on local masters without one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        folder = tempfile.mkdtemp(prefix="kgspark-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_dirs[sc.applicationId] = folder
    return _local_dirs[sc.applicationId]


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds inside and is put back after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession):
    """What is written inside leaves no shuffle files: once the table stands, nothing reads them again.

    Spark would keep them until the driver happens to collect the plan, so a job of many steps would hold them all.
    """
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut_lineage(df: DataFrame, packed: bool = False) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from the written table.

    Survives executor loss, keeps loop plans at constant size, and gives the next join
    the table's real size, so that a broadcast is only chosen for a side known to be small.
    ``packed``: for large tables read to the end of the job, which take less disk for some time to write.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kgspark-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression="zstd" if packed else None)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def forget(*frames: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote for these frames, once nothing will read them again. Other frames are let be."""
    for frame in frames:
        path = frame.__dict__.pop("written_to", None)
        if path is not None:
            spark = frame.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dealt(df: DataFrame, rows: int | None, *keys: str, rows_per_task: int = 500_000) -> DataFrame:
    """The rows by hash of ``keys`` on as many tasks as ``rows``, no fewer than there are, ask for.

    Grouping, windows and joins on these keys are then in place, and what a task holds does not grow with
    the table, whatever number of shuffle partitions is set. Left as it is if ``rows`` is None.
    """
    return df if rows is None else df.repartition(max(rows // rows_per_task + 1, 8), *keys)


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the frame once as a table in buckets of ``keys`` and go on from it.

    A loop that joins it on these keys again and again never moves it: only the other side is dealt to
    the buckets. One file per bucket; by default as many buckets as shuffle partitions. With ``folder`` the
    values of that column get a folder of buckets each, so that a filter on it reads nothing else.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"kgspark_{uuid.uuid4().hex}"
    write = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    with shuffles_removed(spark):
        ((write.partitionBy(folder) if folder else write)
         .option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    return spark.table(name)
