"""Validator and contract queries over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlane.functions import ordering
from shortlane.functions.pyparity import is_canonical_int, is_float, strip, to_float
from shortlane.operators import contract
from shortlane.operators import validate as v
from shortlane.plans import records as r
from shortlane.plans import surrogate as s
from shortlane.plans.surrogate import table
from shortlane.sources import candidates
from shortlane.sources.submission import HEADER, CsvRows


def _checked(spark, d) -> DataFrame:
    return v.parsed(v.fields(v.data_rows(s.submission_rows(spark, d))))


def val_blank_filter(spark, d) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    kept = lines.where(F.exists(F.split("content", ",", -1), lambda c: strip(c) != ""))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def val_header_equality(spark, d) -> DataFrame:
    """Each nation is the first row of a file; every fifth has the header, the others miss it in some way."""
    key, names = F.col("n_nationkey"), F.array(*map(F.lit, HEADER))
    cells = F.when(key % 5 == 0, names).when(key % 5 == 1, F.array_append(names, F.col("n_name"))).when(key % 5 == 2, F.transform(names, F.upper)).when(key % 5 == 3, F.reverse(names)).otherwise(F.transform(names, lambda x: F.concat(x, F.lit(" "))))
    rows = table(spark, d, "nation").select("n_nationkey", F.lit(0).alias("row_ix"), cells.alias("cells"))
    return rows.select("n_nationkey", "row_ix", "cells").transform(v.header_errors).groupBy("message").agg(F.count("*").alias("n"))


def val_row_count(spark, d) -> DataFrame:
    # rows are counted, not numbered: an exchange of nothing but bucket numbers shrinks so much that it ends in one task
    return v.kept_rows(s.submission_rows(spark, d)).agg(F.count("*").alias("n")).select("n", (F.col("n") != 100).alias("wrong"))


def val_row_number(spark, d) -> DataFrame:
    keys = table(spark, d, "orders").select("o_orderkey")
    return ordering.numbered(keys, F.floor(F.col("o_orderkey") / ordering.BUCKET_ROWS), [F.col("o_orderkey")], "row_num", 2).select("o_orderkey", F.col("row_num").cast("long").alias("row_num"))


def val_arity(spark, d) -> DataFrame:
    rows = v.data_rows(s.submission_rows(spark, d))
    return rows.where(F.size("cells") != 4).select(F.col("row_num").cast("long").alias("row_num"), F.size("cells").cast("long").alias("n_cells"))


def val_project_strip(spark, d) -> DataFrame:
    return v.fields(v.data_rows(s.submission_rows(spark, d))).select(F.col("row_num").cast("long").alias("row_num"), "cid", "rank_s", "score_s")


def _errors(spark, d, *rules: str) -> DataFrame:
    return v.field_errors(_checked(spark, d)).where(F.col("rule").isin(*rules)).select(F.col("row_num").cast("long").alias("row_num"), "rule")


def val_id_required_pattern(spark, d) -> DataFrame:
    return _errors(spark, d, "id_required", "id_pattern")


def val_dup_id(spark, d) -> DataFrame:
    return _errors(spark, d, "id_duplicate")


def val_int_canonical(spark, d) -> DataFrame:
    texts = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "0").when(F.col("event_id") % 3 == 1, "-").otherwise(""), F.col("user_id").cast("string")).alias("t"))
    return texts.select("event_id", is_canonical_int(F.col("t")).alias("ok"))


def val_rank_range(spark, d) -> DataFrame:
    return _errors(spark, d, "rank_range", "rank_integer")


def val_dup_rank(spark, d) -> DataFrame:
    return _errors(spark, d, "rank_duplicate")


def val_float_parse(spark, d) -> DataFrame:
    forms = F.array(*map(F.lit, ("1_0", "1.0d", "0x1p3", ".5", "5.", "+1e3", "nan", "-inf", "Infinity", "1__0", "", "e5")))
    texts = table(spark, d, "events").select("event_id", F.element_at(forms, (F.col("event_id") % 12 + 1).cast("int")).alias("t"))
    finite = F.when(F.abs(to_float(F.col("t"))) < 1e300, to_float(F.col("t")))
    return texts.select("event_id", is_float(F.col("t")).alias("ok"), finite.alias("finite"))


def val_rankable(spark, d) -> DataFrame:
    return v.rankable(_checked(spark, d)).select(F.col("row_num").cast("long").alias("row_num"), "rank_s", "cid", F.isnan("score").alias("nan"))


def val_missing_ranks(spark, d) -> DataFrame:
    return v.missing_ranks(_checked(spark, d))


def val_monotone(spark, d) -> DataFrame:
    return v.rising(v.in_rank_order(_checked(spark, d))).select(F.col("row_num").cast("long").alias("row_num"), "rank_s", "next_rank_s", "score", "next_score")


def val_tiebreak(spark, d) -> DataFrame:
    return v.tied_wrongly(v.in_rank_order(_checked(spark, d))).select(F.col("row_num").cast("long").alias("row_num"), "cid", "next_cid")


def val_report(spark, d) -> DataFrame:
    """The whole report of a file with every fault, message by message."""
    header = table(spark, d, "region").where("r_regionkey = 0").select(F.lit(0).cast("long").alias("row_ix"), F.array(F.lit("candidate_id"), F.lit("Rank"), F.lower("r_name")).alias("cells"))
    return v.report(s.submission_rows(spark, d).unionByName(header)).drop("field")


def val_csv_dialect(spark, d) -> DataFrame:
    texts = table(spark, d, "region").select("r_regionkey", F.concat(F.lit('﻿a,"b ""q"" \n c"\r'), F.col("r_name"), F.lit(",,x\r\n\r\nlast")).cast("binary").alias("content"))
    return texts.lateralJoin(CsvRows(F.col("content").outer())).select("r_regionkey", "row_ix", F.size("cells").alias("n"), F.array_join("cells", "|").alias("cells"))


def _violations(spark, d, *problems: str) -> DataFrame:
    return contract.violations(r.records(spark, d), keep="record", problems=problems)


def contract_violations(spark, d) -> DataFrame:
    """How often each rule D01 to D68 is broken, and how; every fault that a field can have is in some record."""
    return _violations(spark, d).groupBy("rule", "path", "problem", "severity").agg(F.count("*").alias("n"), F.sum("record").cast("long").alias("records"))


def contract_required_keys(spark, d) -> DataFrame:
    return _violations(spark, d, "missing", "null")


def contract_enum_range(spark, d) -> DataFrame:
    return _violations(spark, d, "enum", "pattern", "range").where(~F.col("path").endswith("skill_assessment_scores"))


def contract_array_bounds(spark, d) -> DataFrame:
    return _violations(spark, d, "items")


def contract_map_values(spark, d) -> DataFrame:
    return _violations(spark, d, "range").where(F.col("path").endswith("skill_assessment_scores"))


def contract_date_parse(spark, d) -> DataFrame:
    return _violations(spark, d, "format")


def contract_typed_json(spark, d) -> DataFrame:
    return _violations(spark, d, "type")


def contract_quarantine(spark, d) -> DataFrame:
    return candidates.quarantine(r.records(spark, d)).groupBy("line").agg(F.count("*").alias("n"))


_WITH = f"WITH {s.SUBMISSION_SQL}"
SQL = {
    "val_blank_filter": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents) SELECT doc_id, count(*) AS n_lines FROM l WHERE len(list_filter(string_split(content, ','), lambda c: {s.strip_sql('c')} <> '')) > 0 GROUP BY doc_id",
    "val_header_equality": f"""WITH h AS (SELECT CASE n_nationkey % 5 WHEN 1 THEN '{v.NAMES},' || n_name WHEN 2 THEN '{v.NAMES.upper()}' WHEN 3 THEN '{",".join(reversed(HEADER))}' WHEN 4 THEN '{",".join(x + " " for x in HEADER)}' END AS found FROM nation WHERE n_nationkey % 5 <> 0)
      SELECT 'Row 1 (header) must be exactly:' || chr(10) || '  {v.NAMES}' || chr(10) || 'Found:' || chr(10) || '  ' || found AS message, count(*) AS n FROM h GROUP BY found""",
    "val_row_count": f"{_WITH} SELECT count(*) AS n, count(*) <> 100 AS wrong FROM numbered",
    "val_row_number": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_num FROM orders",
    "val_arity": f"{_WITH} SELECT row_num, CAST(n AS BIGINT) AS n_cells FROM numbered WHERE n <> 4",
    "val_project_strip": f"{_WITH} SELECT row_num, cid, rank_s, score_s FROM named",
    "val_id_required_pattern": f"{_WITH} SELECT row_num, CASE WHEN cid = '' THEN 'id_required' ELSE 'id_pattern' END AS rule FROM checked WHERE NOT id_ok",
    "val_dup_id": f"{_WITH} SELECT row_num, 'id_duplicate' AS rule FROM checked WHERE id_again",
    "val_int_canonical": "WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '-' ELSE '' END || user_id AS t FROM events) SELECT event_id, regexp_matches(t, '^(0|-?[1-9][0-9]*)$') AS ok FROM t",
    "val_rank_range": f"{_WITH} SELECT row_num, CASE WHEN NOT rank_ok THEN 'rank_integer' ELSE 'rank_range' END AS rule FROM checked WHERE NOT in_range",
    "val_dup_rank": f"{_WITH} SELECT row_num, 'rank_duplicate' AS rule FROM checked WHERE rank_again",
    "val_float_parse": "WITH t AS (SELECT event_id, event_id % 12 AS k FROM events) SELECT event_id, k IN (0, 3, 4, 5, 6, 7, 8) AS ok, CASE k WHEN 0 THEN 10.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE WHEN 4 THEN 5.0::DOUBLE WHEN 5 THEN 1000.0::DOUBLE END AS finite FROM t",
    "val_rankable": f"{_WITH} SELECT row_num, rank_s, cid, isnan(score) AS nan FROM checked WHERE rank_ok AND score IS NOT NULL AND cid <> ''",
    "val_missing_ranks": f"{_WITH} SELECT CAST(r AS INTEGER) AS rank FROM range(1, 101) t(r) WHERE r NOT IN (SELECT CAST(rank_s AS BIGINT) FROM checked WHERE in_range)",
    "val_monotone": f"{_WITH} SELECT row_num, rank_s, next_rank_s, score, next_score FROM ordered WHERE next_rank_s IS NOT NULL AND NOT isnan(score) AND NOT isnan(next_score) AND score < next_score",
    "val_tiebreak": f"{_WITH} SELECT row_num, cid, next_cid FROM ordered WHERE next_rank_s IS NOT NULL AND NOT isnan(score) AND score = next_score AND cid > next_cid",
    "val_report": f"""{_WITH}, placed AS (SELECT *, row_number() OVER (ORDER BY CAST(rank_s AS BIGINT), row_num) AS place FROM ordered),
      e AS (SELECT 1 AS phase, 0 AS spot, 'Row 1 (header) must be exactly:' || chr(10) || '  {v.NAMES}' || chr(10) || 'Found:' || chr(10) || '  candidate_id,Rank,' || lower(r_name) AS message FROM region WHERE r_regionkey = 0
        UNION ALL SELECT 2, 0, 'After the header (row 1), there must be exactly 100 data rows (rows 2–101); found ' || count(*) || '.' FROM numbered HAVING count(*) <> 100
        UNION ALL SELECT 3, row_num, 'Row ' || row_num || ': expected 4 columns ({v.NAMES}), got ' || n || '.' FROM numbered WHERE n <> 4
        UNION ALL SELECT 3, row_num, 'Row ' || row_num || CASE WHEN cid = '' THEN ': candidate_id is required.' WHEN NOT id_ok THEN ': candidate_id must be CAND_XXXXXXX (7 digits).' ELSE ': duplicate candidate_id ''' || cid || '''.' END FROM checked WHERE NOT id_ok OR id_again
        UNION ALL SELECT 3, row_num, 'Row ' || row_num || CASE WHEN NOT rank_ok THEN ': rank must be an integer (1–100).' WHEN NOT in_range THEN ': rank must be between 1 and 100.' ELSE ': duplicate rank ' || rank_s || '.' END FROM checked WHERE NOT in_range OR rank_again
        UNION ALL SELECT 3, row_num, 'Row ' || row_num || ': score must be a float.' FROM checked WHERE score IS NULL
        UNION ALL SELECT 4, 0, 'Each rank 1–100 must appear exactly once; missing: [' || string_agg(CAST(k AS VARCHAR), ', ' ORDER BY k) || ']' FROM range(1, 101) t(k) WHERE k NOT IN (SELECT CAST(rank_s AS BIGINT) FROM checked WHERE in_range) HAVING count(*) > 0
        UNION ALL SELECT 5, place, 'score must be non-increasing by rank: rank ' || rank_s || ' (' || CAST(score AS VARCHAR) || ') < rank ' || next_rank_s || ' (' || CAST(next_score AS VARCHAR) || ').' FROM placed WHERE next_rank_s IS NOT NULL AND NOT isnan(score) AND NOT isnan(next_score) AND score < next_score
        UNION ALL SELECT 6, place, 'Equal scores at ranks ' || rank_s || ' and ' || next_rank_s || ': tie-break requires candidate_id ascending (''' || cid || ''' > ''' || next_cid || ''').' FROM placed WHERE next_rank_s IS NOT NULL AND NOT isnan(score) AND score = next_score AND cid > next_cid)
      SELECT CAST(phase AS INTEGER) AS phase, CAST(spot AS BIGINT) AS row_num, message FROM e""",
    "val_csv_dialect": """SELECT r_regionkey, unnest([0, 1, 2, 3]) AS row_ix, unnest([2, 3, 0, 1]) AS n, unnest([chr(65279) || 'a|b "q" ' || chr(10) || ' c', r_name || '||x', '', 'last']) AS cells FROM region""",
    "contract_violations": f"WITH {r.VIOLATIONS_SQL} SELECT rule, path, problem, severity, count(*) AS n, CAST(sum(record) AS BIGINT) AS records FROM violations GROUP BY ALL",
    "contract_required_keys": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem IN ('missing', 'null')",
    "contract_enum_range": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem IN ('enum', 'pattern', 'range') AND path NOT LIKE '%skill_assessment_scores'",
    "contract_array_bounds": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem = 'items'",
    "contract_map_values": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem = 'range' AND path LIKE '%skill_assessment_scores'",
    "contract_date_parse": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem = 'format'",
    "contract_typed_json": f"WITH {r.VIOLATIONS_SQL} SELECT record, rule, path, problem, severity FROM violations WHERE problem = 'type'",
    "contract_quarantine": "SELECT CASE WHEN o_orderkey % 401 = 0 THEN '{broken' ELSE '[1]' END AS line, count(*) AS n FROM orders WHERE o_orderkey % 401 = 0 OR o_orderkey % 409 = 0 GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
