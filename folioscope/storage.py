"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. Where it is unset, a fresh local one in local mode (tests), and an error on a cluster,
    whose executors couldn't read a folder of the driver's machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioscope/{name}-{uuid.uuid4().hex}"


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are written meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [x for x in _recorders if x is not paths]


def remove_unread(spark: SparkSession, paths: list[str], used: DataFrame) -> list[str]:
    """Delete tables at paths, but for those that `used` reads from; returns the paths that stay."""
    names = [p.rsplit("/", 1)[-1] for p in paths]  # a name of its own each
    read = {n for n in names for f in used.inputFiles() if f"/{n}/" in f}
    for path, name in zip(paths, names):
        if name not in read:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return [p for p, n in zip(paths, names) if n in read]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Delete all tables that operators have written to the shared folder. DataFrames that operators returned can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/folioscope")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """The size of df by the optimizer's estimate, which for files is that of the files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def leaf_bytes(df: DataFrame) -> int:
    """The size of what df is made from, of which the optimizer knows it: unlike `plan_bytes`, joins don't multiply it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def file_text(path: str) -> str:
    """The whole text of a small file, such as a list of keywords."""
    return "\n".join(r["value"] for r in SparkSession.active().read.text(path, wholetext=True).collect())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(content)
    finally:
        out.close()


def rename(spark: SparkSession, folder: str, old: str, new: str) -> int:
    """Give the files of a folder whose names end with `old` the ending `new`, but for empty ones, which are deleted; returns how many there are."""
    count = 0
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(where):
        path = status.getPath()
        if path.getName().endswith(old) and status.getLen() == 0:
            system.delete(path, False)
        elif path.getName().endswith(old):
            if not system.rename(path, spark._jvm.org.apache.hadoop.fs.Path(where, path.getName().removesuffix(old) + new)):
                raise OSError(f"{path} can't be renamed")
            count += 1
    return count
