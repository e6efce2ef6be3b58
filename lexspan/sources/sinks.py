"""Writers that never leave a half-written or emptied table behind.

A published table is a folder of versions and a manifest for each; the last manifest names the version that counts. A
manifest appears by one rename after its version is complete, so a reader sees the old version or the new one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexspan.operators.harness import upsert
from lexspan.runtime import drop_path, last_file, read_file, write_file


def publish(df: DataFrame, path: str, keep_versions: int = 2) -> bool:
    """A new version of the table; an empty one is not published, so what is there stays. Returns whether it was.

    Versions before the last ``keep_versions`` are removed.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    if spark.read.schema(df.schema).parquet(version).isEmpty():
        drop_path(spark, version)
        return False
    newest = last_file(spark, f"{path}/manifest")
    versions = [*(read_file(spark, newest).split("\n") if newest else []), version]
    number = int(newest.rpartition("/")[2]) + 1 if newest else 1
    write_file(spark, f"{path}/manifest/{number:09d}", "\n".join(versions[-keep_versions:]))
    for old in versions[:-keep_versions]:
        drop_path(spark, old)
    return True


def current(spark: SparkSession, path: str) -> DataFrame:
    """The published table as it is now; an error where nothing was published."""
    newest = last_file(spark, f"{path.rstrip('/')}/manifest")
    if not newest:
        raise FileNotFoundError(path)
    return spark.read.parquet(read_file(spark, newest).split("\n")[-1])


def publish_upserted(new: DataFrame, path: str, keys: list[str]) -> bool:
    """The published table with the rows of new in place of those of the same keys."""
    spark = new.sparkSession
    there = last_file(spark, f"{path.rstrip('/')}/manifest")
    return publish(upsert(current(spark, path), new, keys) if there else new, path)
