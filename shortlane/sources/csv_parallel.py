"""One CSV file read in many tasks, row by row as Python's csv module reads it.

Spark cuts the file at line feeds near its split size.  Just after a line feed a reader is either between records or inside a quoted
cell, nothing else, so what a split does is a pair: where it ends, and how many records end in it, from either start.  A first pass
finds the pairs; they are composed in file order (a few numbers for each split, on the driver), which gives each
split's true start and the number of its first record.  A second pass parses every split once, from its true start, and writes rows as
Parquet; what a record that crosses splits has in each of them is put together at the end.

Lines end at \\n, \\r\\n or \\r, as in a file opened with newline="": a bare \\r ends a record outside quotes.  A byte order mark
is part of the first cell.

Defined cases: an empty file has no rows; a blank line is a row without cells; a quote that is never closed ends with the file, and
its cell holds the rest; a byte that is not UTF-8 gives a row of number -1 and no cells beside the rows of the other splits;
a cell longer than csv's limit (131072 characters) is an error, as it is there.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import chain, groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlane.sources import scratch

#: csv's limit on the characters of a cell.
CELL_LIMIT = 131072
BOM = "﻿"
#: A line put after the last one: two cells between records, and text with its comma inside a quoted cell.
MARK = ",\0end"
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 21


def _lines(text: str) -> list[str]:
    """The lines of a text as a file opened with newline="" gives them."""
    return io.StringIO(text, newline="").readlines()


def after(line: str, inside: bool) -> tuple[bool, int]:
    """Where a reader is after a line, if it starts inside a quoted cell or between records, and how many records end in the line."""
    csv.field_size_limit(1 << 30)  # from the wrong start, cells may seem longer than they are
    if '"' not in line:
        return inside, 0 if inside else len(_lines(line)) if "\r" in line else 1
    rows = list(csv.reader([*_lines(f'"{line}' if inside else line), MARK]))
    return rows[-1][-1].endswith(MARK), len(rows) - 1


class Split(NamedTuple):
    """What a stretch of lines does from either start (between records, inside a quoted cell)."""

    inside: tuple[bool, bool] = (False, True)
    records: tuple[int, int] = (0, 0)

    def then(self, other: Split) -> Split:
        ends = tuple(other.inside[i] for i in self.inside)
        return Split(ends, tuple(n + other.records[i] for n, i in zip(self.records, self.inside, strict=True)))


def scan(lines: Iterator[str]) -> Split:
    """The composition of all lines, each looked at once for both starts."""
    inside, records = [False, True], [0, 0]
    for line in lines:
        found: dict[bool, tuple[bool, int]] = {}
        for k in (0, 1):
            if inside[k] not in found:
                found[inside[k]] = after(line, inside[k])
            end, n = found[inside[k]]
            inside[k], records[k] = end, records[k] + n
    return Split((inside[0], inside[1]), (records[0], records[1]))


def parse(lines: Iterator[str], inside: bool, first: int) -> Iterator[tuple[int, list[str], bool]]:
    """Row number, cells and whether the row is whole, from the true start; rows are numbered by where they end.

    Inside a quoted cell the first row begins in its middle.
    """

    def opened() -> Iterator[str]:
        quote = '"' if inside else ""
        for line in lines:
            yield from _lines(quote + line)
            quote = ""

    csv.field_size_limit(1 << 30)  # what is too long is known when records are whole
    held, open_ = None, inside
    for cells in csv.reader(chain(opened(), [MARK])):
        if held is not None:
            yield first, held, not open_
            first, open_ = first + 1, False
        held = cells
    if held[-1].endswith(MARK):
        yield first, [*held[:-1], held[-1].removesuffix(MARK)], False


Key = tuple[str, int]  # a split: its file and where it starts


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, int, Iterator[bytes]]]:
    """Each split with its file's size and its lines in order; one split's lines are all taken before the next split's."""
    rows = (((f, at), size, line) for b in batches for f, at, size, line in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True))
    held = next(rows, None)
    while held is not None:
        key, size, _ = held

        def lines(key: Key = key) -> Iterator[bytes]:
            nonlocal held
            while held is not None and held[0] == key:
                yield held[2].as_py()
                held = next(rows, None)

        mine = lines()
        yield key, size, mine
        for _ in mine:
            pass


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does from either start, its bytes, and whether one of them is not UTF-8; a file's first also with a byte order mark."""
    for (file, at), size, raw in _by_split(batches):
        length, broken = 0, False

        def decoded(raw: Iterator[bytes] = raw) -> Iterator[str]:
            nonlocal length, broken
            for line in raw:
                length += len(line) + 1
                text = line.decode(errors="replace")
                broken = broken or ("\ufffd" in text and text.encode() != line)
                yield text + "\n"

        texts = decoded()
        head, tail = list(islice(texts, 1)), scan(texts)
        for bom in (False, True) if at == 0 else (False,):
            s = scan(BOM * bom + line for line in head).then(tail)
            does = {"inside0": s.inside[0], "inside1": s.inside[1], "records0": s.records[0], "records1": s.records[1]}
            yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "size": size, "bytes": length, "broken": broken, "bom": bom} | does], SPLIT)


SPLIT = pa.schema([
    *((n, pa.string() if n == "file" else pa.int64()) for n in ("file", "at", "size", "bytes")),
    *((n, pa.bool_()) for n in ("broken", "bom", "inside0", "inside1")), ("records0", pa.int64()), ("records1", pa.int64()),
])
SPLIT_SCHEMA = "file string, at long, size long, bytes long, broken boolean, bom boolean, inside0 boolean, inside1 boolean, records0 long, records1 long"
ROW_SCHEMA = "file string, row_ix long, at long, whole boolean, cells array<string>"
ROW = pa.schema([("file", pa.string()), ("row_ix", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("cells", pa.list_(pa.string()))])


class Start(NamedTuple):
    """How a split is read."""

    inside: bool
    first: int  # the number of the first row that ends in it
    bom: bool  # Spark's reader of lines has dropped a byte order mark before it
    cut: bool  # its last line has no line feed


def starts(splits: list) -> dict[Key, Start]:
    """The true start of each split, from what the splits of its file do in order.

    A file's size is that of its lines with a line feed each, less the last one where it is missing, and 3 more with a byte order mark.
    """
    out: dict[Key, Start] = {}
    for file, rows in groupby(sorted(splits, key=lambda r: (r["file"], r["at"])), key=lambda r: r["file"]):
        rows = list(rows)
        beyond = rows[0]["size"] - sum(r["bytes"] for r in rows if not r["bom"])
        rows = [r for r in rows if r["at"] or r["bom"] == (beyond > 0)]
        inside, number = False, 0
        for k, r in enumerate(rows):
            out[file, r["at"]] = Start(inside, number, k == 0 and beyond > 0, k == len(rows) - 1 and beyond in (-1, 2))
            inside, number = r[f"inside{int(inside)}"], number + r[f"records{int(inside)}"]
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, row_ix, cells of every row of a CSV file, or of the CSV files in a folder (written to the shared folder as Parquet)."""
    source = spark.read.option("lineSep", "\n").text(path)
    lines = source.select(*(F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "file"), ("file_block_start", "at"), ("file_size", "size"))), F.col("value").cast("binary").alias("line"))
    splits = lines.mapInArrow(_look, SPLIT_SCHEMA).collect()  # a row of ten values for each split of a file
    known = starts(splits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, at), _, raw in _by_split(batches):
            start = known[file, at]

            def decoded(raw: Iterator[bytes] = raw, start: Start = start) -> Iterator[str]:
                held = None
                for k, line in enumerate(raw):
                    if held is not None:
                        yield held + "\n"
                    held = (BOM if start.bom and k == 0 else "") + line.decode(errors="replace")
                if held is not None:
                    yield held if start.cut else held + "\n"

            out, chars = [], 0
            for row_ix, cells, whole in parse(decoded(), start.inside, start.first):
                out.append({"file": file, "row_ix": row_ix, "at": at, "whole": whole, "cells": cells})
                chars += sum(map(len, cells))
                if len(out) >= BATCH_ROWS or chars > BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(out, ROW)
                    out, chars = [], 0
            yield pa.RecordBatch.from_pylist(out, ROW)

    into = scratch.new_path(spark, "csv")
    lines.mapInArrow(rows, ROW_SCHEMA).write.parquet(into)
    parsed = spark.read.schema(ROW_SCHEMA).parquet(into)
    # a record's part in the next split goes on in its last cell
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda p: p["cells"])
    joined = F.aggregate(F.slice("parts", 2, 1 << 30), F.element_at("parts", 1), _goes_on)
    crossing = parsed.where("NOT whole").groupBy("file", "row_ix").agg(parts.alias("parts")).select("file", "row_ix", joined.alias("cells"))
    out = parsed.where("whole").select("file", "row_ix", "cells").unionByName(crossing)
    error = F.raise_error(F.lit(f"field larger than field limit ({CELL_LIMIT})")).cast("array<string>")
    out = out.withColumn("cells", F.when(F.exists("cells", lambda c: F.length(c) > CELL_LIMIT), error).otherwise(F.col("cells")))
    broken = sorted({r["file"] for r in splits if r["broken"]})
    if broken:
        out = out.unionByName(spark.createDataFrame([(f, -1, None) for f in broken], "file string, row_ix long, cells array<string>"))
    return out


def _goes_on(cells: Column, part: Column) -> Column:
    both = F.concat(F.element_at(cells, -1), F.element_at(part, 1))
    return F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(both), F.slice(part, 2, F.size(part)))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_ix and cells of every row of one file of any size."""
    return read_files(spark, path).drop("file")
