"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftline.errors import ConfigError


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); in local mode, where none is set, a folder of this process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_siftline_folder", None)
    if not shared:
        if not context.master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        shared = context._siftline_folder = tempfile.mkdtemp(prefix="siftline-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{checkpoint_dir(spark)}/siftline-{spark.sparkContext.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once and read again; ``forget`` or ``clean`` deletes them."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t._siftline_path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it when the results are written."""
    _delete(spark, tables_dir(spark))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where the input has too few splits (one small file); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that it need not be installed on the executors."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_siftline_sent", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siftline-")) / "siftline.zip"  # served by the driver
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"siftline/{p.relative_to(root)}")
    context.addPyFile(str(archive))
    context._siftline_sent = True
