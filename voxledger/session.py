"""Session helpers: tables, the shared folder, cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Gives every Python worker this package, once per application, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_voxledger_shipped", False):
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="voxledger-")) / "voxledger.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._voxledger_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is ``local`` is a temporary
    folder of this machine used; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(path)
        return path
    present = sc._jsc.sc().getCheckpointDir()
    if not present.isEmpty():
        return present.get()
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="voxledger-")
    sc.setCheckpointDir(path)
    return path


WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str = "voxledger") -> str:
    """A new path in the shared folder; what is put there stays until ``clear_written``."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (columnar, prunable), read back; it survives lost executors and stays until ``clear_written``."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Cuts a long lineage; by the same means, so that nothing is left behind after ``clear_written``.
cut = written


def clear_written(spark: SparkSession) -> int:
    """Deletes what ``written`` and ``scratch`` have put down so far, once no result that reads it is needed; how many."""
    n = len(WRITTEN)
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
