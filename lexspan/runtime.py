"""Session helpers: the shared folder, written intermediate tables, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
    a temporary folder is made, and only for a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexspan-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexspan/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage and survives the loss of executors, as the files belong to none of them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a written intermediate table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_table_files(df: DataFrame) -> None:
    """Removes the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lexspan/" in folder:
            drop_path(df.sparkSession, folder)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def write_file(spark: SparkSession, path: str, content: str) -> None:
    """A small file, there as a whole or not at all."""
    beside, fs = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(content.encode()))
    out.close()
    if not fs.rename(beside, _at(spark, path)[0]):
        raise OSError(f"{path} could not be written")


def read_file(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def last_file(spark: SparkSession, folder: str) -> str | None:
    """The file of a folder whose name comes last; None where there is none."""
    at, fs = _at(spark, folder)
    names = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    shown = sorted((p.getName(), p.toString()) for p in names if not p.getName().startswith("."))
    return shown[-1][1] if shown else None


@contextmanager
def shuffled_by(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Within it shuffles have so many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, most: int) -> list:
    """The rows of a table that must be small; an error if it has more than ``most``, never a part of it."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that has to be small")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Over as many tasks as ``spark.lexspan.spread`` names; unchanged, without a shuffle, where that is unset.

    For stages that spend their time in Python on each row, over tables that come in one file of one row group, which
    Spark can't split. Tables of many files or row groups need no such setting.
    """
    tasks = int(df.sparkSession.conf.get("spark.lexspan.spread", "0"))
    return df if df.isStreaming or tasks <= 0 else df.repartition(tasks)


def arrow_type(ddl: str):
    """The Arrow type of a Spark type."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    return to_arrow_type(DataType.fromDDL(ddl))
