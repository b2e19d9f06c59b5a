"""Scoring and ranking: rounded score first, then rank by (score, id), so ties print in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlane.functions import similarity
from shortlane.operators import features, honeypot, job
from shortlane.sources import scratch
from shortlane.sources.candidates import SIGNALS
from shortlane.sources.submission import ROWS


def top(df: DataFrame, order: list[Column], n: int = ROWS) -> DataFrame:
    """The first n rows with their rank.  The limit comes first, so the window sees n rows of one task, never the table."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits groups before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def score_profiles(profiles: DataFrame, job_text: str, as_of: str) -> DataFrame:
    """candidate_id, score (rounded to 4 digits) and its components of typed profiles.

    The text component is the relevance of headline, summary and job descriptions to all words of the job text, so
    what is rare among the profiles counts more.
    """
    want, day = job.parse(job_text), F.to_date(F.lit(as_of))
    wanted = F.array(*map(F.lit, want["must_skills"]))
    years, s = F.col("profile.years_of_experience"), F.col(SIGNALS)
    text = F.concat_ws(" ", "profile.headline", "profile.summary", F.array_join(F.transform("career_history", lambda j: F.coalesce(j["description"], F.lit(""))), " "))
    titles = [*features.AI_TITLES, *want["title_words"]]
    parts = {
        "skills": F.least(features.skill_trust(F.col("skills"), wanted) / (2.0 * len(want["must_skills"])), F.lit(1.0)),
        "title": F.greatest(features.is_ai_title(F.col("profile.current_title")).cast("double"), F.col("_likeness")),
        "years": F.when(years.between(want["min_years"], want["max_years"]), 1.0).otherwise(0.4),
        "location": features.location_match(F.col("profile.country"), F.col("profile.location"), F.array(*map(F.lit, want["countries"])).cast("array<string>")),
        "education": features.education_score(F.col("education")),
        "signal": (F.coalesce(s["recruiter_response_rate"], F.lit(0.0)) + features.recency(s["last_active_date"], day) + F.coalesce(features.no_sentinel(s["offer_acceptance_rate"]), F.lit(0.5))) / 3,
        "tenure": F.least(features.tenure_months(F.col("career_history"), day) / 120, F.lit(1.0)),
        "core": F.size(F.filter(F.coalesce("skills", F.array()), lambda k: F.lower(k["name"]).isin(*want["must_skills"]))),
        "flags": F.size(honeypot.flags()),
    }
    rated, title = job.relevance(profiles, job.terms(job_text), job.words(text), "text"), F.col("profile.current_title")
    # a title is compared once, however many profiles have it
    known = scratch.cut(rated.select(title.alias("_title")).distinct().withColumn("_likeness", similarity.best_match(F.col("_title"), titles)), "titles")
    scored = rated.join(known, title.eqNullSafe(F.col("_title")), "left").select("candidate_id", "profile", SIGNALS, "text", *(c.alias(n) for n, c in parts.items()))
    base = 0.35 * F.col("skills") + 0.1 * F.col("text") + 0.25 * F.col("title") + 0.1 * F.col("years") + 0.05 * F.col("tenure") + 0.08 * F.col("location") + 0.07 * F.col("education")
    score = F.round(base * features.signal_modifier(F.col("signal")) / 1.2 * F.pow(F.lit(0.5), F.col("flags")), 4)
    return scored.withColumn("score", F.coalesce(score, F.lit(0.0)))


def rank_profiles(profiles: DataFrame, job_text: str, as_of: str) -> DataFrame:
    """candidate_id, rank, score, reasoning of the shortlist."""
    best = top(score_profiles(profiles, job_text, as_of), [F.desc("score"), F.asc("candidate_id")])
    why = features.reasoning(F.coalesce(F.col("profile.current_title"), F.lit("Candidate")), F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)), F.col("core"), F.coalesce(F.col(f"{SIGNALS}.recruiter_response_rate"), F.lit(0.0)))
    return best.select("candidate_id", "rank", "score", why.alias("reasoning"))
