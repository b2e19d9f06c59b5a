"""Shortlist files: an exact CSV reader (table function) and the CSV writer."""

from __future__ import annotations

import csv
import io
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The header and the number of data rows.
HEADER = ("candidate_id", "rank", "score", "reasoning")
ROWS = 100


@F.udtf(returnType=T.StructType([T.StructField("row_ix", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
class CsvRows:
    """Rows of a CSV text as Python's csv module reads them: raw arity, BOM, blank rows and embedded newlines kept.

    Text is decoded in pieces, as from a file; where that fails, a row with row_ix -1 and no cells ends the rows.
    """

    def eval(self, content: bytes):
        try:
            yield from enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(content), encoding="utf-8", newline="")))
        except UnicodeDecodeError:
            yield -1, None


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_ix and cells of every row of one file; a blank row has no cells, and row -1 stands for a byte that is not UTF-8."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.lateralJoin(CsvRows(F.col("content").outer())).select("row_ix", "cells")


def save_shortlist(ranked: DataFrame, folder: str) -> None:
    """Writes the ranked rows as the one CSV file of a folder, through Spark, so that any file system will do."""
    n = ranked.count()
    if n != ROWS:
        raise ValueError(f"a shortlist has exactly {ROWS} rows; there are {n}")

    def cell(c: str) -> Column:
        return F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))

    lines = ranked.select("rank", F.concat_ws(",", cell("candidate_id"), F.col("rank").cast("string"), F.format_string("%.4f", "score"), cell("reasoning")).alias("line"))
    header = ranked.sparkSession.createDataFrame([(0, ",".join(HEADER))], "rank int, line string")
    header.unionByName(lines).coalesce(1).sortWithinPartitions("rank").select("line").write.option("lineSep", "\r\n").text(folder)


def write_shortlist(ranked: DataFrame, path: str) -> None:
    """Writes the ranked rows (at most ROWS, by contract) as one CSV file with CRLF line ends."""
    rows = ranked.orderBy("rank").limit(ROWS + 1).collect()
    if len(rows) != ROWS:
        raise ValueError(f"a shortlist has exactly {ROWS} rows; there are {'more' if len(rows) > ROWS else len(rows)}")
    with Path(path).open("w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(HEADER)
        writer.writerows((r["candidate_id"], r["rank"], f"{r['score']:.4f}", r["reasoning"]) for r in rows)
