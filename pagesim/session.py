"""Session helpers: settings the library relies on and shared work folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the runtime settings the operators are written for."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or else by ``setCheckpointDir``.

    Where it is unset a local session gets a temporary folder; a cluster has to
    name a folder that all its machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = _local_roots.setdefault(
            context.applicationId, tempfile.mkdtemp(prefix="pagesim-")
        )
    return root.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in order; none where there is no folder."""
    files, where = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def mark(spark: SparkSession, path: str):
    """Make an empty file, over an older one."""
    files, where = _file_system(spark, path)
    files.create(where, True).close()


def remove(spark: SparkSession, path: str):
    """Remove a file or a folder with all it holds, if it is there."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, lets several readers share one computation, and gives
    the planner the true size, so that a join after it broadcasts or shuffles
    by what is really there.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fence(df: DataFrame) -> DataFrame:
    """Keep the columns of ``df`` computed once where a Python UDF reads them.

    When the expressions below and above both hold Python UDFs, Catalyst inlines
    the ones below into the ones above, once per mention, and a chain of array
    expressions grows exponentially. A metrics node between the two projections
    stops that and costs nothing: it stays in the same stage.
    """
    return df.observe(f"fence-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers of a session that was started without it."""
    context = spark.sparkContext
    if any("pagesim-src" in f for f in (context.listFiles or [])):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pagesim-"), "pagesim-src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(f for f in files if f.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    return spark
