"""Session settings the library relies on, and materialisation in the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; a cluster adds its own sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "claimscope", **extra: str) -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster the caller brings their own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may lack it (tests) and gets a folder
    of its own; on a cluster a local folder would scatter the tables over the machines, so that is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="claimscope-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; the result keeps its partitioning and survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables of this process that nothing has discarded yet.
_WRITTEN: set[str] = set()


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and gives the optimizer true sizes."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str = "table") -> tuple[DataFrame, str]:
    """As `written`, with the path, which `discard` takes once nothing reads the table any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    _WRITTEN.discard(path)


def release(spark: SparkSession) -> None:
    """Delete every table this process has written and not discarded; results that read them must be done."""
    for path in list(_WRITTEN):
        discard(spark, path)
