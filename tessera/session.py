"""Shared storage for results that are read more than once.

Long lineages are cut by writing Parquet under the folder that the cluster names in
`spark.checkpoint.dir`.  Those files outlive any executor.  Only a purely local
session (tests) without that setting gets a temporary folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
_SET: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back.  The files go when the application ends, if `release` has not removed them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing will read again."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Bounds what one Arrow batch of texts takes in a Python worker, where the session has no bound of its own."""
    for key, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) in (None, "10000", _SET.get(name)):
            spark.conf.set(name, str(value))
            _SET[name] = str(value)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else as it is: then a join shuffles.

    df is counted, so it should be materialized; its rows should have a bounded size.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_code(spark: SparkSession) -> None:
    """Gives this package to Python workers that would not find it, once for each application.

    The archive is only read by the driver, which hands it to the executors.
    """
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or any(p and Path(p).resolve() == root for p in known):
        return
    folder = os.path.realpath(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, f"{__package__}-code"), "zip", root, __package__))
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it comes in fewer parts than there are: a small file is one part, however long its rows take.

    Call it on a scan of the columns that are needed: counting the parts of other plans may run them.
    Inputs of many parts are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
