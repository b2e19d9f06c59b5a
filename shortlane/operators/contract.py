"""The candidate data contract: 68 declared fields, checked on VARIANT so that nothing is lost in typing.

`violations` gives one row for each broken rule of each record.  Objects, arrays and scalars are told apart
by their JSON type, a missing key from an explicit null, and 5.0 counts as an integer.
Formats (dates) are warnings unless `strict`.  Unknown keys are legal.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlane.sources.candidates import SIGNALS

SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")
SKILL_LEVELS = ("beginner", "intermediate", "advanced", "expert")
LANGUAGE_LEVELS = ("basic", "conversational", "professional", "native")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")


class Field(NamedTuple):
    """A declared field: dotted path ([] for array items), JSON type, and its constraint."""

    path: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    pattern: str = ""
    nullable: bool = False


def _signals() -> list[Field]:
    s, counts = f"{SIGNALS}.", ("integer", True, 0)
    pay = f"{s}expected_salary_range_inr_lpa"
    return [
        Field(SIGNALS, "object"), Field(s + "profile_completeness_score", "number", True, 0, 100), Field(s + "signup_date", "date"), Field(s + "last_active_date", "date"),
        Field(s + "open_to_work_flag", "boolean"), Field(s + "profile_views_received_30d", *counts), Field(s + "applications_submitted_30d", *counts),
        Field(s + "recruiter_response_rate", "number", True, 0, 1), Field(s + "avg_response_time_hours", "number", True, 0), Field(s + "skill_assessment_scores", "map", True, 0, 100),
        Field(s + "connection_count", *counts), Field(s + "endorsements_received", *counts), Field(s + "notice_period_days", "integer", True, 0, 180),
        Field(pay, "object"), Field(pay + ".min", "number", True, 0), Field(pay + ".max", "number", True, 0), Field(s + "preferred_work_mode", "string", values=WORK_MODES),
        Field(s + "willing_to_relocate", "boolean"), Field(s + "github_activity_score", "number", True, -1, 100), Field(s + "search_appearance_30d", *counts), Field(s + "saved_by_recruiters_30d", *counts),
        Field(s + "interview_completion_rate", "number", True, 0, 1), Field(s + "offer_acceptance_rate", "number", True, -1, 1),
        Field(s + "verified_email", "boolean"), Field(s + "verified_phone", "boolean"), Field(s + "linkedin_connected", "boolean"),
    ]


# The declared fields in the contract's order; the n-th is rule Dn.
FIELDS = [
    Field("candidate_id", "string", pattern=r"^CAND_[0-9]{7}\z"),
    Field("profile", "object"),
    *(Field(f"profile.{n}", "string") for n in ("anonymized_name", "headline", "summary", "location", "country")),
    Field("profile.years_of_experience", "number", True, 0, 50),
    Field("profile.current_title", "string"), Field("profile.current_company", "string"), Field("profile.current_company_size", "string", values=SIZES), Field("profile.current_industry", "string"),
    Field("career_history", "array", True, 1, 10),
    Field("career_history[].company", "string"), Field("career_history[].title", "string"), Field("career_history[].start_date", "date"), Field("career_history[].end_date", "date", nullable=True),
    Field("career_history[].duration_months", "integer", True, 0), Field("career_history[].is_current", "boolean"), Field("career_history[].industry", "string"),
    Field("career_history[].company_size", "string", values=SIZES), Field("career_history[].description", "string"),
    Field("education", "array", True, 0, 5),
    Field("education[].institution", "string"), Field("education[].degree", "string"), Field("education[].field_of_study", "string"),
    Field("education[].start_year", "integer", True, 1970, 2030), Field("education[].end_year", "integer", True, 1970, 2035),
    Field("education[].grade", "string", False, nullable=True), Field("education[].tier", "string", False, values=TIERS),
    Field("skills", "array"),
    Field("skills[].name", "string"), Field("skills[].proficiency", "string", values=SKILL_LEVELS), Field("skills[].endorsements", "integer", True, 0), Field("skills[].duration_months", "integer", False, 0),
    Field("certifications", "array", False),
    Field("certifications[].name", "string"), Field("certifications[].issuer", "string"), Field("certifications[].year", "integer"),
    Field("languages", "array", False),
    Field("languages[].language", "string"), Field("languages[].proficiency", "string", values=LANGUAGE_LEVELS),
    *_signals(),
]


#: JSON types of numbers, besides decimals.
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _leaf(f: Field) -> str:
    return f.path.rpartition(".")[2]


def can_break(f: Field) -> set[str]:
    """Everything that can be wrong with a field."""
    out = {"type"} | ({"missing"} if f.required else set()) | (set() if f.nullable else {"null"})
    out |= {"range"} if f.kind == "map" or f.kind in ("number", "integer") and (f.low is not None or f.high is not None) else set()
    out |= {"items"} if f.kind == "array" and f.low is not None else set()
    return out | ({"enum"} if f.values else set()) | ({"pattern"} if f.pattern else set()) | ({"format"} if f.kind == "date" else set())


def _shape(fields: list[Field], parent: str = "") -> str:
    """The type that takes the fields of a parent, and what is below them, out of a record at once; scalars stay VARIANT."""
    own: dict[str, str] = {}
    for f in (g for g in FIELDS if g.path.rpartition(".")[0] == parent):
        below = [g for g in fields if g.path.startswith((f.path + ".", f.path + "[]."))]
        if f not in fields and not below:
            continue
        inner = _shape(fields, f.path + ("[]" if f.kind == "array" else "")) if below else "struct<_: variant>"
        own[_leaf(f)] = {"object": inner, "array": f"array<{inner}>", "map": "map<string, variant>"}.get(f.kind, "variant")
    return "struct<" + ", ".join(f"{name}: {kind}" for name, kind in own.items()) + ">"


def _needs_value(f: Field, problems: set[str]) -> bool:
    """Whether a scalar's value, besides its type, decides about one of these problems."""
    return bool(can_break(f) & problems & ({"range", "enum", "pattern", "format"} | ({"type"} if f.kind == "integer" else set())))


def _facts(at: Column, asked: tuple[list[Field], set[str]]) -> Column:
    """JSON type, and value where a problem needs it, of the scalars of one object: each is worked out once."""
    facts, (fields, problems) = [], asked
    for f in fields:
        v = at[_leaf(f)]
        facts.append(F.schema_of_variant(v).alias(f"{_leaf(f)}_type"))
        if _needs_value(f, problems):
            facts.append(_get(v, "$", "double" if f.kind in ("number", "integer") else "string").alias(f"{_leaf(f)}_value"))
    return F.struct(*facts)


def _each(items: Column, of: Callable[..., Column], arg: object) -> Column:
    return F.transform(items, lambda x: of(x, arg))


def _outside(x: Column, f: Field) -> Column:
    return ((x < f.low) if f.low is not None else F.lit(False)) | ((x > f.high) if f.high is not None else F.lit(False))


def _scalar(facts: Column, asked: tuple[Field, set[str]]) -> Column:
    """The first thing wrong with a scalar: missing, null, type, range, enum, pattern or format; NULL if nothing."""
    f, problems = asked
    kind, none = facts[f"{_leaf(f)}_type"], F.lit(None).cast("string")
    out = F.when(kind.isNull(), F.lit("missing") if f.required else none).when(kind == "VOID", none if f.nullable else F.lit("null"))
    number = f.kind in ("number", "integer")
    out = out.when(~(kind.isin(*NUMBERS) | kind.startswith("DECIMAL")) if number else kind != ("BOOLEAN" if f.kind == "boolean" else "STRING"), F.lit("type"))
    if not _needs_value(f, problems):
        return out
    value = facts[f"{_leaf(f)}_value"]
    if f.kind == "integer":
        out = out.when(value != F.floor(value), F.lit("type"))
    if number:
        out = out.when(_outside(value, f), F.lit("range"))
    if f.values:
        out = out.when(~value.isin(*f.values), F.lit("enum"))
    if f.pattern:
        out = out.when(~value.rlike(f.pattern), F.lit("pattern"))
    if f.kind == "date":
        out = out.when(~value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") | F.try_to_date(value, "yyyy-MM-dd").isNull(), F.lit("format"))
    return out


def _nested(raw: Column, held: Column, f: Field) -> Column:
    """The first thing wrong with an object, array or map: `held` is NULL where it is none, and only then the record is asked why."""
    v, none = _get(raw, f"$.{f.path}", "variant"), F.lit(None).cast("string")
    why = F.when(v.isNull(), F.lit("missing") if f.required else none).when(F.is_variant_null(v), none if f.nullable else F.lit("null")).otherwise("type")
    out = F.when(held.isNull(), why)
    if f.kind == "array" and f.low is not None:
        out = out.when(_outside(F.size(held), f), F.lit("items"))
    if f.kind == "map":
        wrong = lambda x: _get(x, "$", "double").isNull() | (F.schema_of_variant(x) == "STRING") | _outside(_get(x, "$", "double"), f)
        out = out.when(F.exists(F.map_values(held), wrong), F.lit("range"))
    return out


def violations(lines: DataFrame, strict: bool = False, keep: str = "line", problems: tuple[str, ...] = ()) -> DataFrame:
    """`keep`, rule (D01..D68), path, problem, severity of records (raw VARIANT) that are objects.

    A record is taken apart once, then the facts of each scalar once, then the rules: steps of their own, which are not merged.
    With `problems`, only these are looked for, in the fields that can have them.  A field of what is no object is not looked for,
    so a record that is no object breaks no rule (and is not filtered, which would parse it twice).
    """
    wanted = set(problems) or set().union(*map(can_break, FIELDS))
    asked = [f for f in FIELDS if not problems or can_break(f) & set(problems)]
    nested = lambda f: f.kind in ("object", "array", "map")
    scalars: dict[str, list[Field]] = {}
    for f in asked:
        if not nested(f):
            scalars.setdefault(f.path.rpartition(".")[0], []).append(f)

    def at(path: str) -> Column:
        """What the record holds at a path, without the mark of items."""
        out = F.col("_held")
        for step in path.removesuffix("[]").split(".") if path else []:
            out = out[step]
        return out

    facts, broken = [], {}
    for k, (parent, own) in enumerate(scalars.items()):
        name = f"_facts{k}"
        if parent.endswith("[]"):
            items = F.filter(at(parent), lambda x: x.isNotNull())
            facts.append(_each(items, _facts, (own, wanted)).alias(name))
            broken |= {f: F.try_element_at(F.array_compact(_each(F.col(name), _scalar, (f, wanted))), F.lit(1)) for f in own}
        else:
            facts.append(F.when(at(parent).isNotNull(), _facts(at(parent), (own, wanted))).alias(name))
            broken |= {f: F.when(F.col(name).isNotNull(), _scalar(F.col(name), (f, wanted))) for f in own}
    for f in filter(nested, asked):
        parent = f.path.rpartition(".")[0]
        broken[f] = F.when(at(parent).isNotNull(), _nested(F.col("raw"), at(f.path), f))
    held = lines.select(keep, "raw", _get(F.col("raw"), "$", _shape(asked)).alias("_held")).select(keep, "raw", "_held", *facts)
    # outer, as Spark would filter by the array's size before, and so do all the work twice; the array is never empty
    found = held.select(keep, F.array(*(broken[f] for f in asked)).alias("_broken")).select(keep, F.posexplode_outer("_broken").alias("_k", "problem")).where("problem IS NOT NULL")
    if problems:
        found = found.where(F.col("problem").isin(*problems))
    said = F.element_at(F.array(*(F.struct(F.lit(f"D{FIELDS.index(f) + 1:02d}").alias("rule"), F.lit(f.path).alias("path")) for f in asked)), F.col("_k") + 1)
    severity = F.when((F.col("problem") == "format") & F.lit(not strict), "warn").otherwise("error")
    return found.select(keep, said["rule"].alias("rule"), said["path"].alias("path"), "problem", severity.alias("severity"))
