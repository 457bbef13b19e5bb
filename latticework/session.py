"""Session helpers: shared scratch tables and shipping this package to executors."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_open: list[list[str]] = []


def get_session(app: str = "latticework", master: str | None = None, partitions: int = 8) -> SparkSession:
    """A session with the settings the engine expects (adaptive plans, UTC, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor can reach.

    Where the setting is empty, a folder of this process is made and set as
    checkpoint folder, for a local master only: on a cluster the executors could
    not read it, so there an error is raised.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="latticework-")
        atexit.register(shutil.rmtree, path[7:], True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def gathering() -> Iterator[list[str]]:
    """The paths of scratch tables made inside; delete() removes them once nothing reads them any more."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted for the innermost gathering()."""
    path = f"{shared_dir(spark)}/lw-{uuid.uuid4().hex[:12]}-{name}"
    if _open:
        _open[-1].append(path)
    return path


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder, in a folder for each value of some columns, and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsized(df: DataFrame) -> DataFrame:
    """The same rows, of unknown size to Spark: what tasks make of a few numbers is taken for as small as these, and joins would broadcast it."""
    spark = df.sparkSession
    rows = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)  # noqa: SLF001
    return DataFrame(rows, spark)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder; what still reads them must have been written before."""
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    folder = tempfile.mkdtemp(prefix="latticework-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"latticework_{uuid.uuid4().hex[:8]}.zip")
    with open(path, "wb") as out:
        out.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
