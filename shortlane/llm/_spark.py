"""Spark plumbing shared by the operators: written cuts of lineage and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlane.sources import scratch

#: Words are runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: later steps restart from files, not from lineage."""
    spark = df.sparkSession
    scratch.small_batches(spark)
    path = scratch.new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_spans(spans: Column) -> Column:
    """kind:start:end of an array of structs (kind, start, end), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def held_out(doc_id: Column) -> Column:
    """The documents whose labels are never learnt from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
