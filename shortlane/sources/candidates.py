"""Candidate profiles: schema, JSON Lines readers (typed and diagnostic), Parquet conversion."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the platform signals' object in the profile format.
SIGNALS = "redrob_signals"

SCHEMA = f"""
candidate_id STRING,
profile STRUCT<anonymized_name: STRING, headline: STRING, summary: STRING, location: STRING, country: STRING, years_of_experience: DOUBLE,
  current_title: STRING, current_company: STRING, current_company_size: STRING, current_industry: STRING>,
career_history ARRAY<STRUCT<company: STRING, title: STRING, start_date: DATE, end_date: DATE, duration_months: INT, is_current: BOOLEAN,
  industry: STRING, company_size: STRING, description: STRING>>,
education ARRAY<STRUCT<institution: STRING, degree: STRING, field_of_study: STRING, start_year: INT, end_year: INT, grade: STRING, tier: STRING>>,
skills ARRAY<STRUCT<name: STRING, proficiency: STRING, endorsements: INT, duration_months: INT>>,
certifications ARRAY<STRUCT<name: STRING, issuer: STRING, year: INT>>,
languages ARRAY<STRUCT<language: STRING, proficiency: STRING>>,
{SIGNALS} STRUCT<profile_completeness_score: DOUBLE, signup_date: DATE, last_active_date: DATE, open_to_work_flag: BOOLEAN,
  profile_views_received_30d: INT, applications_submitted_30d: INT, recruiter_response_rate: DOUBLE, avg_response_time_hours: DOUBLE,
  skill_assessment_scores: MAP<STRING, DOUBLE>, connection_count: INT, endorsements_received: INT, notice_period_days: INT,
  expected_salary_range_inr_lpa: STRUCT<min: DOUBLE, max: DOUBLE>, preferred_work_mode: STRING, willing_to_relocate: BOOLEAN,
  github_activity_score: DOUBLE, search_appearance_30d: INT, saved_by_recruiters_30d: INT, interview_completion_rate: DOUBLE,
  offer_acceptance_rate: DOUBLE, verified_email: BOOLEAN, verified_phone: BOOLEAN, linkedin_connected: BOOLEAN>
"""


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """Typed profiles and `_corrupt`, the line of each record that does not fit the schema."""
    return spark.read.schema(SCHEMA + ", _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and raw (VARIANT): keeps missing keys, nulls and JSON types apart; raw is NULL where the line is no JSON."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.try_parse_json("value").alias("raw"))


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON objects."""
    kind = F.coalesce(F.schema_of_variant("raw"), F.lit(""))
    return lines.where(~kind.startswith("OBJECT")).select("line")


def to_parquet(spark: SparkSession, path: str, out: str) -> None:
    """One conversion lets later reads prune nested columns and push filters down."""
    read_typed(spark, path).where("_corrupt IS NULL").drop("_corrupt").write.parquet(out)


def profiles(spark: SparkSession, path: str, parquet: str = "") -> DataFrame:
    """Typed profiles that fit the schema; with `parquet`, from that folder, which is written if it is not there."""
    if not parquet:
        return read_typed(spark, path).where("_corrupt IS NULL").drop("_corrupt")
    try:
        return spark.read.schema(SCHEMA).parquet(parquet)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    to_parquet(spark, path, parquet)
    return spark.read.schema(SCHEMA).parquet(parquet)
