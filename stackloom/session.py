"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("stackloom").config(map=SETTINGS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster, where executors
    do not share one, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stackloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/stackloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_stored(spark: SparkSession) -> None:
    """Removes all intermediate tables of this application; results that still read them must have been written before."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/stackloom-{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers that would not find it by working folder or PYTHONPATH."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")]
    if any(p and Path(p).resolve() == root for p in paths) or not (root / "stackloom").is_dir() or getattr(context, "_stackloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="stackloom-")) / "stackloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "stackloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    own = list(sys.path)
    context.addPyFile(str(archive))
    sys.path[:] = own  # the driver goes on with the files themselves
    context._stackloom_shipped = True
