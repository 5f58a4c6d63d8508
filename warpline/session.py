"""Session settings and the places on disk that every executor can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTLED = "warpline-settled-"
#: Narrow rows that are broadcast at most.
BROADCAST_ROWS = 250_000


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("warpline")
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder that outlives executors: the cluster's setting, or in local mode one made here, which goes with the process.

    On a cluster without the setting this raises, as a folder of one machine isn't seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="warpline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    It cuts the lineage like ``checkpoint()`` but keeps the columns compressed and lets later readers prune them.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{_SETTLED}{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsettle(spark: SparkSession) -> None:
    """Remove what ``settled`` wrote to the shared folder, from all sessions, once no result that reads it is wanted any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"{_SETTLED}*")) or []:
        files.delete(status.getPath(), True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, of narrow rows, to be broadcast if it has at most ``rows`` rows; else joins choose for themselves.

    The count must be cheap: give a settled table or columns of one.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
