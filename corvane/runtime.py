"""Session helpers: the shared scratch folder, kept tables and literal helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can read.

    Only a local session without that setting gets a folder of its own; on a cluster its absence is an error,
    since a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, silently if the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder belongs to the job and goes with it
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._corvane_path = path
    return kept


def forget(kept: DataFrame) -> None:
    """Delete a table made by :func:`keep` that nothing reads any more, as the last round of an iteration."""
    remove(kept.sparkSession, kept._corvane_path)


def rows_of(df: DataFrame, bound: int) -> list:
    """The rows of a table that is proven small; more than ``bound`` rows is an error, never a silent cut."""
    got = df.limit(bound + 1).collect()
    if len(got) > bound:
        raise ValueError(f"more than {bound} rows: this table was expected to be small")
    return got


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once a session, so that none needs it installed."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    home = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="corvane-package-"))
    atexit.register(shutil.rmtree, out, True)
    ignore = shutil.ignore_patterns("__pycache__", "*.pyc")
    shutil.copytree(home, out / "tree" / home.name, ignore=ignore)
    sc.addPyFile(shutil.make_archive(str(out / home.name), "zip", out / "tree"))
    sc._corvane_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it has fewer partitions than there are cores: the one rule at every size.

    The filter after the exchange is always true. Being non-deterministic, it keeps the optimizer from pushing later filters,
    and with them the costly expressions they test, below the exchange, where they would be computed a second time.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores).where(F.rand(0) >= 0.0)
