"""Row numbers and neighbours over a whole table without a one-task window over its rows.

Rows are cut into ordered buckets; windows run inside buckets, and one row for each bucket
(its count or its first row) carries over to the next.  The buckets of `numbered` are themselves cut
into chunks by the first field of their key, so what one task orders in the end is one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket where callers derive it from an integer key.
BUCKET_ROWS = 8192


def _offsets(counts: DataFrame, chunk: Column) -> DataFrame:
    """_bucket and _offset, the rows before it, from _bucket and _count."""
    counts = counts.withColumn("_chunk", chunk)
    inside = Window.partitionBy("_chunk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    chunks = counts.groupBy("_chunk").agg(F.sum("_count").alias("_n")).select(F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = counts.withColumn("_before", F.coalesce(F.sum("_count").over(inside), F.lit(0)))
    return placed.join(chunks, placed["_chunk"] == chunks["_c"]).select("_bucket", (F.col("_before") + F.col("_start")).alias("_offset"))


def numbered(df: DataFrame, bucket: Column, order: list[Column], name: str, start: int = 1, chunk: Column | None = None) -> DataFrame:
    """Adds the row's number in (bucket, order) order, from `start`.

    `chunk`, of `_bucket`, must not fall as the bucket rises; by default BUCKET_ROWS integer buckets are one.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_count"))
    offsets = _offsets(counts, F.floor(F.col("_bucket") / BUCKET_ROWS) if chunk is None else chunk)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return df.withColumn("_row", inside).join(offsets, "_bucket").withColumn(name, F.col("_row") + F.col("_offset") + (start - 1)).drop("_bucket", "_row", "_offset")


def with_next(df: DataFrame, bucket: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Adds next_<column>: the value in the row that follows in (bucket, order) order, NULL at the end.

    The first rows of buckets are ordered within the first bucket column, and one row for each of its values in one task.
    """
    packed = F.struct(*columns)
    inside = Window.partitionBy(*bucket).orderBy(*order)
    df = df.withColumn("_next", F.lead(packed).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    heads = df.where("_first").select(*bucket, packed.alias("_head"))  # a row for each bucket
    near = Window.partitionBy(bucket[0]).orderBy(*bucket[1:]) if bucket[1:] else Window.orderBy(bucket[0])
    heads = heads.withColumn("_after", F.lead("_head").over(near))
    if bucket[1:]:
        tops = heads.withColumn("_top", F.row_number().over(near) == 1).where("_top").select(F.col(bucket[0]).alias("_of"), F.lead("_head").over(Window.orderBy(bucket[0])).alias("_beyond"))
        heads = heads.join(tops, heads[bucket[0]] == tops["_of"]).withColumn("_after", F.coalesce("_after", "_beyond")).drop("_of", "_beyond")
    joined = df.join(heads.drop("_head"), bucket).withColumn("_next", F.coalesce("_next", "_after"))
    return joined.select(*[c for c in df.columns if c not in ("_next", "_first")], *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))
