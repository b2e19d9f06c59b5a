"""The driver's tables read as the candidate model.

customer is the candidate, its market segment the title, orders the career, brands bought
through lineitem the skills, events the behavioural signals, nation and region the
location, and orders relabelled a shortlist file with every kind of fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the surrogate: the core brands, the AI title, the band in days, the as-of time of the events.
CORE_BRANDS = ("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#23", "Brand#31", "Brand#32", "Brand#33")
AI_SEGMENT = "MACHINERY"
BAND_DAYS = (1826, 2296)
AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_id(key) -> F.Column:
    return F.concat(F.lit("CAND_"), F.lpad(key.cast("string"), 7, "0"))


def core_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, n_core: different core brands of each candidate."""
    parts = table(spark, sf_dir, "part").where(F.col("p_brand").isin(*CORE_BRANDS)).select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    owned = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return owned.groupBy("o_custkey").agg(F.countDistinct("p_brand").cast("int").alias("n_core"))


def careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, days: from the first order to the last."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, response_bp: share of its events that are purchases, in basis points."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.floor(F.sum((F.col("event_type") == "purchase").cast("long")) * 10000 / F.count("*")).cast("long").alias("response_bp"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, candidate_id, title, c_nationkey, n_core, days, response_bp (-1: no events), level."""
    people = table(spark, sf_dir, "customer").select("c_custkey", candidate_id(F.col("c_custkey")).alias("candidate_id"), F.col("c_mktsegment").alias("title"), "c_nationkey")
    out = people.join(core_skills(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    out = out.join(careers(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")
    out = out.join(responses(spark, sf_dir), F.col("c_custkey") == F.col("user_id"), "left").drop("user_id")
    out = out.withColumns({"n_core": F.coalesce("n_core", F.lit(0)), "days": F.coalesce("days", F.lit(0)), "response_bp": F.coalesce("response_bp", F.lit(-1).cast("long"))})
    level = F.col("n_core") + 4 * (F.col("title") == AI_SEGMENT).cast("int") + F.col("days").between(*BAND_DAYS).cast("int")
    return out.withColumn("level", level)


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_ix and cells of a shortlist file: every order is a row, and its key decides which faults it has."""
    key = F.col("o_orderkey")
    cid = F.when(key % 97 == 0, "  ").when(key % 89 == 0, F.concat(F.lit("CAND_"), F.col("o_custkey").cast("string"))).otherwise(F.concat(candidate_id(F.col("o_custkey")), F.lit(" ")))
    rank = F.when(key % 83 == 0, F.concat(F.lit("0"), (key % 120).cast("string"))).when(key % 79 == 0, "1_0").otherwise((key % 120 + 1 + F.when((key % 120 + 1) % 9 == 0, 120).otherwise(0)).cast("string"))
    score = F.when(key % 73 == 0, "nan").when(key % 71 == 0, "1.0d").when(key % 67 == 0, " 5e-1 ").otherwise((F.floor(key / 240) % 7).cast("string"))
    cells = F.when(key % 61 == 0, F.array(cid, rank)).when(key % 59 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(cid, rank, score, F.lit("")))
    return table(spark, sf_dir, "orders").select((key + 1).cast("long").alias("row_ix"), cells.alias("cells"))


CANDIDATES_SQL = f"""
people AS (
  SELECT c.c_custkey, 'CAND_' || lpad(CAST(c.c_custkey AS VARCHAR), 7, '0') AS candidate_id, c.c_mktsegment AS title, c.c_nationkey,
    CAST(coalesce(k.n_core, 0) AS INTEGER) AS n_core, CAST(coalesce(j.days, 0) AS INTEGER) AS days, CAST(coalesce(e.response_bp, -1) AS BIGINT) AS response_bp
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(DISTINCT p_brand) AS n_core FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
             WHERE p_brand IN ({", ".join(f"'{b}'" for b in CORE_BRANDS)}) GROUP BY o_custkey) k ON k.o_custkey = c.c_custkey
  LEFT JOIN (SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY o_custkey) j ON j.o_custkey = c.c_custkey
  LEFT JOIN (SELECT user_id, (10000 * count(*) FILTER (event_type = 'purchase')) // count(*) AS response_bp FROM events GROUP BY user_id) e ON e.user_id = c.c_custkey
), candidates AS (
  SELECT *, CAST(n_core + CASE WHEN title = '{AI_SEGMENT}' THEN 4 ELSE 0 END + CASE WHEN days BETWEEN {BAND_DAYS[0]} AND {BAND_DAYS[1]} THEN 1 ELSE 0 END AS INTEGER) AS level FROM people
)"""

SPACE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE_SQL}', ''), '{SPACE_SQL}$', '')"


FLOAT_SQL = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"

SUBMISSION_SQL = f"""
raw AS (
  SELECT o_orderkey + 1 AS row_ix,
    CASE WHEN o_orderkey % 97 = 0 THEN '  ' WHEN o_orderkey % 89 = 0 THEN 'CAND_' || o_custkey ELSE 'CAND_' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') || ' ' END AS c0,
    CASE WHEN o_orderkey % 83 = 0 THEN '0' || (o_orderkey % 120) WHEN o_orderkey % 79 = 0 THEN '1_0' ELSE CAST(o_orderkey % 120 + 1 + CASE WHEN (o_orderkey % 120 + 1) % 9 = 0 THEN 120 ELSE 0 END AS VARCHAR) END AS c1,
    CASE WHEN o_orderkey % 73 = 0 THEN 'nan' WHEN o_orderkey % 71 = 0 THEN '1.0d' WHEN o_orderkey % 67 = 0 THEN ' 5e-1 ' ELSE CAST((o_orderkey // 240) % 7 AS VARCHAR) END AS c2,
    CASE WHEN o_orderkey % 61 = 0 THEN 2 WHEN o_orderkey % 59 = 0 THEN 0 ELSE 4 END AS n
  FROM orders
), numbered AS (SELECT *, row_number() OVER (ORDER BY row_ix) + 1 AS row_num FROM raw WHERE n = 4 OR (n = 2 AND NOT (trim(c0) = '' AND trim(c1) = '')) ),
named AS (SELECT row_num, {strip_sql("c0")} AS cid, {strip_sql("c1")} AS rank_s, {strip_sql("c2")} AS score_s FROM numbered WHERE n = 4),
typed AS (
  SELECT *, regexp_matches(cid, '^CAND_[0-9]{{7}}$') AS id_ok, regexp_matches(rank_s, '^(0|-?[1-9][0-9]*)$') AS rank_ok,
    CASE WHEN regexp_matches(score_s, '{FLOAT_SQL}') THEN TRY_CAST(replace(score_s, '_', '') AS DOUBLE) WHEN lower(score_s) = 'nan' THEN 'nan'::DOUBLE END AS score
  FROM named
), ranged AS (SELECT *, rank_ok AND coalesce(TRY_CAST(rank_s AS INTEGER) BETWEEN 1 AND 100, false) AS in_range FROM typed),
checked AS (
  SELECT *, id_ok AND row_number() OVER (PARTITION BY cid, id_ok ORDER BY row_num) > 1 AS id_again,
    in_range AND row_number() OVER (PARTITION BY rank_s, in_range ORDER BY row_num) > 1 AS rank_again FROM ranged
), ordered AS (
  SELECT row_num, rank_s, score, cid, lead(rank_s) OVER w AS next_rank_s, lead(score) OVER w AS next_score, lead(cid) OVER w AS next_cid
  FROM checked WHERE rank_ok AND score IS NOT NULL AND cid <> '' WINDOW w AS (ORDER BY CAST(rank_s AS BIGINT), row_num)
)"""
