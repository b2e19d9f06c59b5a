"""Cross-field contradictions that the contract allows: each is a named flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlane.sources.candidates import SIGNALS


def flags() -> Column:
    """Names of the contradictions of a typed profile; NULL comparisons do not flag."""
    jobs, study, skills, s = F.col("career_history"), F.col("education"), F.col("skills"), F.col(SIGNALS)
    years = F.col("profile.years_of_experience")
    current = F.filter(jobs, lambda j: j["is_current"])
    rules = {
        "job_ends_before_start": F.exists(jobs, lambda j: j["end_date"] < j["start_date"]),
        "current_with_end": F.exists(jobs, lambda j: j["is_current"] & j["end_date"].isNotNull()),
        "past_without_end": F.exists(jobs, lambda j: ~j["is_current"] & j["end_date"].isNull()),
        "months_off_dates": F.exists(jobs, lambda j: F.abs(F.months_between(j["end_date"], j["start_date"]) - j["duration_months"]) > 3),
        "study_ends_before_start": F.exists(study, lambda e: e["end_year"] < e["start_year"]),
        "active_before_signup": s["last_active_date"] < s["signup_date"],
        "salary_reversed": s["expected_salary_range_inr_lpa"]["min"] > s["expected_salary_range_inr_lpa"]["max"],
        "skill_older_than_career": F.exists(skills, lambda k: k["duration_months"] > years * 12 + 12),
        "title_not_current": (F.size(current) > 0) & ~F.exists(current, lambda j: (j["title"] == F.col("profile.current_title")) & (j["company"] == F.col("profile.current_company"))),
        "expert_without_use": F.exists(skills, lambda k: (k["proficiency"] == "expert") & (k["duration_months"] == 0)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
