"""Session helpers: the shared folder for cut lineage, and table reading."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own (one machine, as in tests);
    elsewhere a missing setting is an error, because a machine-local folder would not outlive a lost
    executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="docquarry-")
    spark.sparkContext.setCheckpointDir(where)
    return where


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table of this application; all of them are deleted when the application ends."""
    top = f"{shared_dir(spark)}/docquarry-{spark.sparkContext.applicationId}"
    if top not in _scratch:
        fs, p = _file_system(spark, top)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _scratch.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut, nothing is recomputed."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it a write's shuffle files are deleted when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _file_system(spark: SparkSession, path: str):
    """(the Hadoop file system a path lives in, the path)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file of the shared folder; the target's folder is made."""
    fs, p = _file_system(spark, source)
    _, q = _file_system(spark, target)
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise FileExistsError(target)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared folder, sorted; none if there is no such folder."""
    fs, p = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: readers see all of it or none."""
    fs, p = _file_system(spark, path)
    _, part = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="docquarry-ship-")) / "docquarry_ship.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
