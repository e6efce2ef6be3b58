"""Rule units of a stream of sections; beyond what the batch form needs, as sections carry no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexspan.functions.text import section_texts
from lexspan.plans.plain_meaning import plain_meaning, units


def stream_units(spark: SparkSession, folder: str, schema: StructType | str, *keys: str) -> DataFrame:
    """Units of every section file that arrives in the folder; (keys, unit columns)."""
    return units(plain_meaning(spark.readStream.schema(schema).parquet(folder)), *keys)


def corpus_units(spark: SparkSession, files: str, schema: StructType | str) -> DataFrame:
    """Units of every section of the corpus entries in the files, those of the text where there are none: (entry_id, section_pos, unit columns)."""
    entries = spark.readStream.schema(schema).parquet(files)
    rows = entries.select("entry_id", F.posexplode(section_texts(F.col("sections"), F.col("text"))).alias("section_pos", "text"))
    return units(plain_meaning(rows), "entry_id", "section_pos")


def signal_counts(spark: SparkSession, folder: str, schema: StructType | str, at: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Units by signal and window of their section's time; sections later than ``late`` are left out."""
    sections = spark.readStream.schema(schema).parquet(folder).withWatermark(at, late)
    return units(plain_meaning(sections), at).groupBy(F.window(at, window), "signal").agg(F.count("*").alias("n_units"))


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
