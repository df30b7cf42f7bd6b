"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers.

    The sources are zipped once per application and handed to Spark's own file
    distribution, so no executor needs a copy of the repository on its disk.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ship_")), "sigflow_src.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, os.path.join(root.name, p.relative_to(root)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, per: int = 4) -> int:
    """Groups that packed rows are dealt to: several for each shuffle partition, so that they grow with the input as that setting does."""
    return max(32, per * int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the files.

    The folder is the one named by ``spark.checkpoint.dir``. Where that is unset a
    single-process session (tests, a notebook) uses a folder of this machine; on a
    cluster it is an error, as executors would not see each other's files. Files,
    unlike a checkpointed RDD, bring their true size to the planner.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "sigflow_checkpoints"))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._checkpoint_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``checkpoint`` that nothing refers to any more, as in the rounds of a loop. Other frames are left alone."""
    path = getattr(df, "_checkpoint_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
