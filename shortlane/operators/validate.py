"""Shortlist validation as one DataFrame pipeline.

Input: row_ix and cells, the rows of a file.  Every rule gives rows (phase, row_num, field, message); their
union in order is the report.  A row that breaks one rule still feeds the others where
the rules say so: out-of-range and repeated ranks stay in the order checks, rows of wrong
arity leave all of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shortlane.functions import ordering
from shortlane.functions.pyparity import equal, int_order, is_canonical_int, less, strip, to_float
from shortlane.sources import scratch
from shortlane.sources.submission import HEADER, ROWS

# The id pattern and the report's texts.
ID_PATTERN = r"^CAND_[0-9]{7}\z"
NAMES = ",".join(HEADER)
MESSAGES = {
    "extension": "Filename must use a .csv extension.",
    "empty": "Row 1 must be the header row; file is empty.",
    "encoding": "File must be UTF-8 encoded.",
    "unreadable": "Cannot read file: {}",
    "id_required": "Row %d: candidate_id is required.",
    "id_pattern": "Row %d: candidate_id must be CAND_XXXXXXX (7 digits).",
    "id_duplicate": "Row %d: duplicate candidate_id '%s'.",
    "rank_range": "Row %d: rank must be between 1 and 100.",
    "rank_duplicate": "Row %d: duplicate rank %s.",
    "rank_integer": "Row %d: rank must be an integer (1–100).",
    "score_float": "Row %d: score must be a float.",
}


@F.pandas_udf(T.StringType())
def python_repr(values: pd.Series) -> pd.Series:
    """repr() of the few values that a report quotes."""
    return values.map(lambda x: None if x is None else repr(x))


def kept_rows(rows: DataFrame) -> DataFrame:
    """Rows after the header with a cell that is not blank."""
    return rows.where((F.col("row_ix") > 0) & F.exists("cells", lambda c: strip(c) != ""))


def data_rows(rows: DataFrame) -> DataFrame:
    """The kept rows, numbered from 2 (`row_num`)."""
    return ordering.numbered(kept_rows(rows), F.floor(F.col("row_ix") / ordering.BUCKET_ROWS), [F.col("row_ix")], "row_num", start=2)


def fields(numbered: DataFrame) -> DataFrame:
    """row_num, cid, rank_s, score_s of the rows with four cells."""
    whole = numbered.where(F.size("cells") == len(HEADER))
    return whole.select("row_num", *(strip(F.col("cells")[k]).alias(n) for k, n in enumerate(("cid", "rank_s", "score_s"))))


def parsed(named: DataFrame) -> DataFrame:
    """Adds id_ok, rank_ok, in_range, score, and whether an earlier row has the same id or rank.

    Numbered rows are written first: the first rows of ids and of ranks are read from there.
    """
    named = scratch.cut(named, "report-fields")
    out = named.withColumns({
        "id_ok": F.col("cid").rlike(ID_PATTERN), "rank_ok": is_canonical_int(F.col("rank_s")), "score_ok": to_float(F.col("score_s")).isNotNull(), "score": to_float(F.col("score_s")),
    })
    out = out.withColumn("in_range", F.col("rank_ok") & F.coalesce(F.when(F.length("rank_s") <= 3, F.col("rank_s").try_cast("int")).between(1, ROWS), F.lit(False)))
    # the first row of each id and rank: found map-side, so a hot key is one row a task; ranks in range are ROWS at most
    first_rank = out.where("in_range").groupBy("rank_s").agg(F.min("row_num").alias("_first_rank"))
    first_id = out.where("id_ok").groupBy("cid").agg(F.min("row_num").alias("_first_id"))
    out = out.join(F.broadcast(first_rank), "rank_s", "left").join(first_id, "cid", "left")
    again = {"id_again": F.col("id_ok") & (F.col("row_num") > F.col("_first_id")), "rank_again": F.col("in_range") & (F.col("row_num") > F.col("_first_rank"))}
    return out.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in again.items()}).drop("_first_id", "_first_rank")


def field_errors(rows: DataFrame) -> DataFrame:
    """row_num, field (0 id, 1 rank, 2 score), rule: at most one for each field of a row."""
    rule = lambda n: F.lit(n)
    of_id = F.when(F.col("cid") == "", rule("id_required")).when(~F.col("id_ok"), rule("id_pattern")).when(F.col("id_again"), rule("id_duplicate"))
    of_rank = F.when(~F.col("rank_ok"), rule("rank_integer")).when(~F.col("in_range"), rule("rank_range")).when(F.col("rank_again"), rule("rank_duplicate"))
    of_score = F.when(~F.col("score_ok"), rule("score_float"))
    listed = F.array(*(F.struct(F.lit(k).alias("field"), r.alias("rule")) for k, r in enumerate((of_id, of_rank, of_score))))
    return rows.select("row_num", "cid", "rank_s", F.explode(F.filter(listed, lambda x: x["rule"].isNotNull())).alias("e")).select("row_num", "cid", "rank_s", "e.*")


def rankable(rows: DataFrame) -> DataFrame:
    """Rows that enter the order checks: rank and score parse and there is an id, however wrong they are otherwise."""
    return rows.where(F.col("rank_ok") & F.col("score_ok") & (F.col("cid") != "")).select("row_num", "rank_s", "score", "cid")


def missing_ranks(rows: DataFrame) -> DataFrame:
    """rank: those of 1..100 that no row has."""
    seen = rows.where("in_range").select(F.col("rank_s").try_cast("int").alias("rank")).distinct()
    return rows.sparkSession.range(1, ROWS + 1).select(F.col("id").cast("int").alias("rank")).join(seen, "rank", "left_anti")


def in_rank_order(rows: DataFrame) -> DataFrame:
    """Rankable rows with the row that follows by (rank, file order): next_rank_s, next_score, next_cid."""
    keyed = rankable(rows).withColumn("by", int_order(F.col("rank_s"))).withColumn("part", F.floor(F.col("row_num") / ordering.BUCKET_ROWS))
    return ordering.with_next(keyed, ["by", "part"], [F.col("row_num")], ["rank_s", "score", "cid"])


def is_rising() -> Column:
    return F.col("next_rank_s").isNotNull() & less(F.col("score"), F.col("next_score"))


def is_tied_wrongly() -> Column:
    return F.col("next_rank_s").isNotNull() & equal(F.col("score"), F.col("next_score")) & (F.col("cid") > F.col("next_cid"))


def rising(ordered: DataFrame) -> DataFrame:
    """Neighbours whose score rises with the rank."""
    return ordered.where(is_rising())


def tied_wrongly(ordered: DataFrame) -> DataFrame:
    """Neighbours with equal scores whose ids fall."""
    return ordered.where(is_tied_wrongly())


def header_errors(rows: DataFrame) -> DataFrame:
    """message for a first row (row_ix 0) that differs from the header in any way."""
    wrong = rows.where((F.col("row_ix") == 0) & (F.col("cells") != F.array(*map(F.lit, HEADER))))
    return wrong.select("row_ix", F.concat(F.lit(f"Row 1 (header) must be exactly:\n  {NAMES}\nFound:\n  "), F.array_join("cells", ",")).alias("message"))


def report(rows: DataFrame) -> DataFrame:
    """phase, row_num, field, message of a file's rows (row_ix, cells), in the order of a report; empty if valid."""
    out = lambda df, phase, row, field, message: df.select(F.lit(phase).alias("phase"), row.cast("long").alias("row_num"), field.cast("int").alias("field"), message.alias("message"))
    zero = F.lit(0)
    header = out(header_errors(rows), 1, zero, zero, F.col("message"))
    numbered = scratch.cut(data_rows(rows), "report-rows")
    arity = numbered.where(F.size("cells") != len(HEADER))
    arity = out(arity, 3, F.col("row_num"), zero, F.format_string(f"Row %d: expected {len(HEADER)} columns ({NAMES}), got %d.", "row_num", F.size("cells")))
    count = numbered.agg(F.count("*").alias("n")).where(F.col("n") != ROWS)
    count = out(count, 2, zero, zero, F.format_string(f"After the header (row 1), there must be exactly {ROWS} data rows (rows 2–{ROWS + 1}); found %d.", "n"))
    rows = scratch.cut(parsed(fields(numbered)), "report-parsed")
    text = F.coalesce(*(F.when(F.col("rule") == k, F.format_string(m, "row_num", *{"id_duplicate": ["cid"], "rank_duplicate": ["rank_s"]}.get(k, []))) for k, m in MESSAGES.items() if "%d" in m))
    errors = out(field_errors(rows), 3, F.col("row_num"), F.col("field"), text)
    missing = missing_ranks(rows).agg(F.array_sort(F.collect_list("rank")).alias("m")).where(F.size("m") > 0)
    missing = out(missing, 4, zero, zero, F.concat(F.lit(f"Each rank 1–{ROWS} must appear exactly once; missing: ["), F.array_join("m", ", "), F.lit("]")))
    place = ordering.numbered(scratch.cut(in_rank_order(rows), "report-order"), F.struct("by", "part"), [F.col("row_num")], "place", chunk=F.col("_bucket.by"))
    # both order rules in one pass: a pair of neighbours breaks at most one of them
    up = F.concat(F.lit("score must be non-increasing by rank: rank "), F.col("rank_s"), F.lit(" ("), python_repr("score"), F.lit(") < rank "), F.col("next_rank_s"), F.lit(" ("), python_repr("next_score"), F.lit(")."))
    tie = F.concat(F.lit("Equal scores at ranks "), F.col("rank_s"), F.lit(" and "), F.col("next_rank_s"), F.lit(": tie-break requires candidate_id ascending ("), python_repr("cid"), F.lit(" > "), python_repr("next_cid"), F.lit(")."))
    wrong = place.withColumn("phase", F.when(is_rising(), 5).when(is_tied_wrongly(), 6)).where("phase IS NOT NULL")
    order = wrong.select("phase", F.col("place").cast("long").alias("row_num"), F.lit(0).alias("field"), F.when(F.col("phase") == 5, up).otherwise(tie).alias("message"))
    return header.unionByName(count).unionByName(arity).unionByName(errors).unionByName(missing).unionByName(order)
