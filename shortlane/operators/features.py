"""Explainable features of profiles as column functions; all scores are deterministic in an explicit as-of date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlane.operators.contract import SIZES, SKILL_LEVELS, TIERS

# Titles that count as the AI family, and the experience band in years.
AI_TITLES = ("ML Engineer", "AI Engineer", "Data Scientist")
BAND = (5.0, 9.0)


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in an ordered enum, from 0; NULL outside it."""
    place = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(place > 0, place.cast("int") - 1)


def company_size_rank(value: Column) -> Column:
    return ordinal(value, SIZES)


def no_sentinel(value: Column) -> Column:
    """-1 stands for "none": NULL."""
    return F.nullif(value, F.lit(-1.0))


def is_ai_title(title: Column) -> Column:
    found = F.lit(False)
    for t in AI_TITLES:
        found = found | F.contains(title, F.lit(t))
    return F.coalesce(found, F.lit(False))


def in_band(years: Column) -> Column:
    return F.coalesce(years.between(*BAND), F.lit(False))


def baseline_level(core_skills: Column, title: Column, years: Column) -> Column:
    """Core skills, 4 for an AI title, 1 for the experience band."""
    return core_skills + 4 * is_ai_title(title).cast("int") + in_band(years).cast("int")


def rank_score(rank: Column) -> Column:
    """1 - 0.008 rank, exact in thousandths."""
    return (F.lit(1000) - 8 * rank).cast("double") / 1000


def reasoning(title: Column, years: Column, core_skills: Column, response: Column) -> Column:
    return F.concat(title, F.lit(" with "), F.format_string("%.1f", years), F.lit(" yrs; "), core_skills.cast("string"), F.lit(" AI core skills; response rate "), F.format_string("%.2f", response), F.lit("."))


def skill_trust(skills: Column, wanted: Column) -> Column:
    """Sum over wanted skills of proficiency (1..4) times trust: capped endorsements and months, up to 1."""

    def weight(s):
        level = F.coalesce(ordinal(s["proficiency"], SKILL_LEVELS), F.lit(0)) + 1
        trust = F.least(F.coalesce(s["endorsements"], F.lit(0)), F.lit(20)) / 40 + F.least(F.coalesce(s["duration_months"], F.lit(0)), F.lit(36)) / 72
        return level * trust

    mine = F.filter(F.coalesce(skills, F.array()), lambda s: F.array_contains(wanted, F.lower(s["name"])))
    return F.aggregate(F.transform(mine, weight), F.lit(0.0), lambda a, x: a + x.cast("double"))


def tenure_months(history: Column, as_of: Column) -> Column:
    """Months in all jobs, open ones until as_of."""
    months = F.transform(history, lambda j: F.greatest(F.months_between(F.coalesce(j["end_date"], as_of), j["start_date"]), F.lit(0.0)))
    return F.aggregate(F.coalesce(months, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def recency(last_active: Column, as_of: Column) -> Column:
    """1 when active today, 0 after 180 days."""
    days = F.datediff(as_of, last_active)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days / 180)), F.lit(0.0))


def education_score(education: Column) -> Column:
    """The best tier: 1 for tier_1 down to 0.25 for tier_4; 0 if unknown."""
    tiers = F.transform(education, lambda e: F.coalesce(ordinal(e["tier"], TIERS), F.lit(4)))
    return F.coalesce((4 - F.array_min(tiers)) / 4, F.lit(0.0))


def signal_modifier(signal: Column, low: float = 0.8, high: float = 1.2) -> Column:
    """A multiplier between low and high from a signal clamped to 0..1; unknown is 0.5."""
    return low + (high - low) * F.least(F.greatest(F.coalesce(signal, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def location_match(country: Column, location: Column, wanted: Column) -> Column:
    hit = F.exists(wanted, lambda w: (F.lower(country) == w) | F.contains(F.lower(location), w))
    return F.when(F.size(wanted) == 0, 1.0).when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)
