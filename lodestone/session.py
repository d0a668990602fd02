"""Sessions: the package on the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: What else is forgotten when scratch is cleared.
ON_CLEARED: list[Callable[[], None]] = []
_SCRATCH: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once for each application.

    Functions that run in workers are found by import; the workers of a cluster need not have
    this folder.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed when the program ends. Where the setting is unset, a local
    session gets a folder of this machine and any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(cleared)
    _SCRATCH.append((spark, path))
    return path


def cleared() -> None:
    """Remove what scratch() has named so far."""
    for spark, path in _SCRATCH:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder stays
            break
    _SCRATCH.clear()
    for forget in ON_CLEARED:
        forget()


def fingerprint(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """Path, size and time of every file in folder and below, as the session's file system lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to scratch and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
