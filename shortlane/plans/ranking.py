"""Ranking and feature queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlane.functions import similarity
from shortlane.operators import features, honeypot, job, shortlist, validate
from shortlane.operators.shortlist import top, top_per
from shortlane.plans import records as r
from shortlane.plans import surrogate as s
from shortlane.plans.surrogate import table
from shortlane.sources import candidates, scratch, submission
from shortlane.sources.candidates import SIGNALS
from shortlane.streaming import counters

# Fixed value of the surrogate: the job description.
JOB = "Senior ML engineer, 3 to 7 years. Python, SQL, Spark, machine learning and NLP for urgent work in Germany or India."
JD_WORDS = ("the", "of", "and", "data", "der", "que")
SIMILAR_TO = "small bolt"


def _order():
    return [F.desc("level"), F.desc("response_bp"), F.asc("candidate_id")]


def shortlist_baseline(spark, d) -> DataFrame:
    best = top(s.candidates(spark, d), _order())
    return best.select("candidate_id", "rank", features.rank_score(F.col("rank")).alias("score"), "level", "response_bp")


def shortlist_per_country(spark, d) -> DataFrame:
    named = s.candidates(spark, d).join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return top_per(named, ["n_name"], _order(), 10).select("n_name", "rank", "candidate_id", "level")


def score_rank_transform(spark, d) -> DataFrame:
    best = top(table(spark, d, "customer").select(s.candidate_id(F.col("c_custkey")).alias("candidate_id"), "c_acctbal"), [F.desc("c_acctbal"), F.asc("candidate_id")])
    return best.select("candidate_id", "rank", features.rank_score(F.col("rank")).alias("score"))


def reasoning_text(spark, d) -> DataFrame:
    """The reason of every candidate; years and rates are whole tenths and hundredths, and years cover all orders."""
    p = r.profiles(spark, d, "careers", "skills", "signals")
    core = F.size(F.filter(F.coalesce("skills", F.array()), lambda k: k["name"].isin(*job.CORE)))
    why = features.reasoning(F.col("profile.current_title"), F.coalesce("profile.years_of_experience", F.lit(0.0)), core, F.coalesce(f"{SIGNALS}.recruiter_response_rate", F.lit(0.0)))
    return p.select("candidate_id", why.alias("reasoning"))


def feat_skill_trust(spark, d) -> DataFrame:
    trust = features.skill_trust(F.col("skills"), F.array(*map(F.lit, job.CORE)))
    return r.skills(spark, d).select("s_custkey", F.size("skills").cast("long").alias("n_skills"), F.round(trust, 6).alias("trust"))


def feat_title_family(spark, d) -> DataFrame:
    return r.people(spark, d).select("c_custkey", "title", features.is_ai_title(F.col("title")).alias("ai"))


def feat_experience_band(spark, d) -> DataFrame:
    return r.careers(spark, d).select("o_custkey", "years", features.in_band(F.col("years")).alias("in_band"), features.baseline_level(F.lit(2), F.lit("AI Engineer"), F.col("years")).alias("level"))


def feat_signal_modifier(spark, d) -> DataFrame:
    rate = F.col(f"{SIGNALS}.recruiter_response_rate")
    return r.signals(spark, d).select("user_id", F.round(features.signal_modifier(rate), 6).alias("modifier"), F.round(features.recency(F.col(f"{SIGNALS}.last_active_date"), F.to_date(F.lit(r.DAY))), 6).alias("recency"))


def feat_sentinel_null(spark, d) -> DataFrame:
    github, offers = (features.no_sentinel(F.col(f"{SIGNALS}.{c}")) for c in ("github_activity_score", "offer_acceptance_rate"))
    return r.signals(spark, d).select("user_id", github.alias("github"), offers.alias("offers"))


def feat_location_match(spark, d) -> DataFrame:
    return r.people(spark, d).select("c_custkey", features.location_match(F.col("country"), F.col("region"), F.array(F.lit("asia"), F.lit("germany"))).alias("match"), features.education_score(F.col("education")).alias("education"))


def feat_trailing_30d(spark, d) -> DataFrame:
    return counters.counts_before(table(spark, d, "events"), s.AS_OF, 30)


def honeypot_flags(spark, d) -> DataFrame:
    """The contradictions of every candidate. A career is a customer's first ten orders (the contract's limit)."""
    p = r.profiles(spark, d, "careers", "skills", "signals")
    return p.select("candidate_id", F.array_join(honeypot.flags(), ",").alias("flags"))


def jd_skill_overlap(spark, d) -> DataFrame:
    """How many of a job description's skills the words of a candidate's jobs name. A career is a customer's first ten orders (the contract's limit)."""
    wanted = F.array(*map(F.lit, [w for w in job.parse(JOB)["must_skills"] if " " not in w]))
    text = F.array_join(F.transform("career_history", lambda j: j["description"]), " ")
    return r.careers(spark, d).select("o_custkey", job.overlap(text, wanted).cast("long").alias("n_overlap"))


def jd_relevance(spark, d) -> DataFrame:
    """Relevance of every document to a job description."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return job.relevance(docs, list(JD_WORDS), job.words(F.col("text"))).select("doc_id", F.round("relevance", 6).alias("relevance"))


def feat_text_similarity(spark, d) -> DataFrame:
    """How alike the names of parts and a wanted one are."""
    own, other = similarity.plain(F.col("p_name")), F.lit(SIMILAR_TO)
    return table(spark, d, "part").select("p_partkey", F.round(similarity.edit_similarity(own, other), 6).alias("by_edits"), F.round(similarity.word_similarity(own, other), 6).alias("by_words"))


def feat_tenure(spark, d) -> DataFrame:
    """Months in all jobs and the largest company of a career. A career is a customer's first ten orders (the contract's limit)."""
    jobs = F.col("career_history")
    size = F.array_max(F.transform(jobs, lambda j: features.company_size_rank(j["company_size"])))
    return r.careers(spark, d).select("o_custkey", F.round(features.tenure_months(jobs, F.to_date(F.lit(r.DAY))), 4).alias("months"), size.alias("largest"))


def rank_profiles(spark, d) -> DataFrame:
    """The ranker itself over typed profiles: score, order and reason of the best 100. A career is a customer's first ten orders (the contract's limit)."""
    return shortlist.rank_profiles(r.profiles(spark, d, "careers", "skills", "signals"), JOB, r.DAY)


def jd_lexical_score(spark, d) -> DataFrame:
    words = job.words(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", words.alias("words"))
    return docs.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.filter("words", lambda w: w.isin(*JD_WORDS))).cast("long").alias("tf"), F.size(F.array_intersect("words", F.array(*map(F.lit, JD_WORDS)))).cast("long").alias("n_terms"))


def jd_vector_topk(spark, d) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    query = vectors.agg(F.min_by("embedding", "vec_id").alias("q"))  # one vector: the job description
    scored = vectors.crossJoin(F.broadcast(query)).select("vec_id", F.round(job.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return top(scored, [F.desc("similarity"), F.asc("vec_id")], 100).select("vec_id", "similarity", "rank")


def hybrid_rank(spark, d) -> DataFrame:
    c = s.candidates(spark, d).join(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    base = 35 * F.least("n_core", F.lit(9)) + 25 * F.when(F.col("title") == s.AI_SEGMENT, 9).otherwise(0) + 15 * F.col("days").between(*s.BAND_DAYS).cast("int") * 9 + 10 * (F.col("n_regionkey") == 2).cast("int") * 9
    score = (base * (8000 + F.least(F.greatest("response_bp", F.lit(0)), F.lit(4000)))).cast("long")
    return top(c.withColumn("hybrid", score), [F.desc("hybrid"), F.asc("candidate_id")]).select("candidate_id", "rank", "hybrid")


def io_candidates_jsonl(spark, d) -> DataFrame:
    """Profiles written as JSON Lines, converted to Parquet once, and read back typed. A career is a customer's first ten orders (the contract's limit)."""
    path = scratch.new_path(spark, "candidates")
    r.profiles(spark, d, "careers", "skills", "signals").select(F.to_json(F.struct("*"))).write.text(path)
    back = candidates.profiles(spark, path, f"{path}-parquet")
    return back.select("candidate_id", F.col("profile.current_title").alias("title"), F.col("profile.years_of_experience").alias("years"), F.size("career_history").cast("long").alias("n_jobs"), F.size("skills").cast("long").alias("n_skills"), F.year(F.array_min(F.transform("career_history", lambda j: j["start_date"]))).alias("since"))


def io_shortlist_csv(spark, d) -> DataFrame:
    """The ranker's shortlist as its file has it: every cell of every row, and no error in its report. A career is a customer's first ten orders (the contract's limit)."""
    path = scratch.new_path(spark, "shortlist")
    submission.save_shortlist(scratch.cut(rank_profiles(spark, d), "ranked"), path)
    rows = submission.read_rows(spark, path)
    errors = validate.report(rows).select(F.lit(-1).alias("row_ix"), F.col("message").alias("line"))
    return rows.select("row_ix", F.array_join("cells", "|").alias("line")).unionByName(errors)


_BEST = "row_number() OVER (ORDER BY level DESC, response_bp DESC, candidate_id)"

_WANT = job.parse(JOB)
_REASON = "title || ' with ' || printf('%.1f', coalesce(years, 0)) || ' yrs; ' || coalesce({core}, 0) || ' AI core skills; response rate ' || printf('%.2f', coalesce(response, 0)) || '.'"
_TRUST = "coalesce(sum(level * (least(n, 20) / 40 + least(months, 36) / 72)) FILTER (name IN {wanted}), 0)"
_AI = "(" + " OR ".join(f"contains(title, '{t}')" for t in features.AI_TITLES) + ")"
_MODIFIER = "(0.8::DOUBLE + 0.3999999999999999::DOUBLE * least(greatest({}, 0), 1))"
_RECENCY = f"greatest(0, least(1, 1 - date_diff('day', last_active_date, DATE '{r.DAY}') / 180))"
_PLACE = "CASE WHEN country IN {places} OR regexp_matches(lower(region), '{pattern}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_EDITS = "(1 - levenshtein(t, w) / greatest(length(t), length(w)))"
_WORDS = "(len(list_intersect(string_split(t, ' '), string_split(w, ' '))) / len(list_distinct(list_concat(string_split(t, ' '), string_split(w, ' ')))))"
_TENURE = "sum(greatest(" + r.MONTHS_SQL.format(a="start_date", b=f"coalesce(end_date, DATE '{r.DAY}')") + ", 0))"
_FLAGS = f"""{r.PEOPLE_SQL}, {r.CAREERS_SQL}, {r.SKILLS_SQL}, {r.SIGNALS_SQL},
  j AS (SELECT c_custkey, bool_or(end_date < start_date) AS a, bool_or(is_current AND end_date IS NOT NULL) AS b, bool_or(NOT is_current AND end_date IS NULL) AS c,
      bool_or(abs({r.MONTHS_SQL.format(a="start_date", b="end_date")} - months) > 3) AS d, bool_or(is_current) AND NOT bool_or(is_current AND jobs.title = person.title AND jobs.company = person.company) AS i
    FROM jobs JOIN person ON c_custkey = o_custkey GROUP BY 1),
  k AS (SELECT s_custkey, bool_or(months > years * 12 + 12) AS h, bool_or(level = 4 AND months = 0) AS j FROM skill LEFT JOIN spans ON s_custkey = o_custkey GROUP BY 1),
  flagged AS (
    SELECT p.*, list_filter([CASE WHEN a THEN 'job_ends_before_start' END, CASE WHEN b THEN 'current_with_end' END, CASE WHEN c THEN 'past_without_end' END, CASE WHEN d THEN 'months_off_dates' END,
      CASE WHEN end_year < start_year THEN 'study_ends_before_start' END, CASE WHEN last_active_date < signup_date THEN 'active_before_signup' END, CASE WHEN pay_min > pay_max THEN 'salary_reversed' END,
      CASE WHEN h THEN 'skill_older_than_career' END, CASE WHEN i THEN 'title_not_current' END, CASE WHEN j THEN 'expert_without_use' END], lambda x: x IS NOT NULL) AS flags
    FROM person p LEFT JOIN j USING (c_custkey) LEFT JOIN k ON c_custkey = s_custkey LEFT JOIN signal ON c_custkey = user_id)"""


def _relevance(words: tuple[str, ...]) -> str:
    """SQL that adds `relevance` to the rows of t (words): the relation `relevant`."""
    tf = ", ".join(f"len(list_filter(words, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(words))
    idf = [f"ln(1 + (n - d{k} + 0.5) / (d{k} + 0.5))" for k in range(len(words))]
    norm = "1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * coalesce(len(words), 0) / mean)"
    total = " + ".join(f"{w} * coalesce(f{k}, 0) / (coalesce(f{k}, 0) + {norm})" for k, w in enumerate(idf))
    return f"""counted AS (SELECT *, {tf} FROM t), held AS (SELECT count(*) AS n, avg(coalesce(len(words), 0)) AS mean, {", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(words)))} FROM counted),
      relevant AS (SELECT counted.*, ({total}) / ({" + ".join(idf)}) AS relevance FROM counted, held)"""


SQL = {
    "shortlist_baseline": f"WITH {s.CANDIDATES_SQL}, r AS (SELECT *, CAST({_BEST} AS INTEGER) AS rank FROM candidates) SELECT candidate_id, rank, CAST(1000 - 8 * rank AS DOUBLE) / 1000 AS score, level, response_bp FROM r WHERE rank <= 100",
    "shortlist_per_country": f"WITH {s.CANDIDATES_SQL}, r AS (SELECT n_name, candidate_id, level, CAST(row_number() OVER (PARTITION BY n_name ORDER BY level DESC, response_bp DESC, candidate_id) AS INTEGER) AS rank FROM candidates JOIN nation ON c_nationkey = n_nationkey) SELECT n_name, rank, candidate_id, level FROM r WHERE rank <= 10",
    "score_rank_transform": "WITH r AS (SELECT 'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS candidate_id, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) SELECT candidate_id, rank, CAST(1000 - 8 * rank AS DOUBLE) / 1000 AS score FROM r WHERE rank <= 100",
    "reasoning_text": f"""WITH {r.PEOPLE_SQL}, {r.CAREERS_SQL}, {r.SKILLS_SQL}, {r.SIGNALS_SQL}, core AS (SELECT s_custkey, count(*) AS n FROM skill WHERE name IN {job.CORE} GROUP BY 1)
      SELECT candidate_id, {_REASON.format(core="core.n")} AS reasoning FROM person LEFT JOIN spans ON c_custkey = o_custkey LEFT JOIN core ON c_custkey = s_custkey LEFT JOIN signal ON c_custkey = user_id""",
    "feat_skill_trust": f"WITH {r.SKILLS_SQL} SELECT s_custkey, count(*) AS n_skills, round({_TRUST.format(wanted=job.CORE)}, 6) AS trust FROM skill GROUP BY s_custkey",
    "feat_title_family": f"WITH {r.PEOPLE_SQL} SELECT c_custkey, title, {_AI} AS ai FROM person",
    "feat_experience_band": f"WITH {r.CAREERS_SQL} SELECT o_custkey, years, years BETWEEN 5 AND 9 AS in_band, CAST(6 + CAST(years BETWEEN 5 AND 9 AS INTEGER) AS INTEGER) AS level FROM spans",
    "feat_signal_modifier": f"WITH {r.SIGNALS_SQL} SELECT user_id, round({_MODIFIER.format('response')}, 6) AS modifier, round({_RECENCY}, 6) AS recency FROM signal",
    "feat_sentinel_null": f"WITH {r.SIGNALS_SQL} SELECT user_id, nullif(github, -1) AS github, nullif(offers, -1) AS offers FROM signal",
    "feat_location_match": f"WITH {r.PEOPLE_SQL} SELECT c_custkey, {_PLACE.format(places=('asia', 'germany'), pattern='asia|germany')} AS match, (4 - tier) / 4 AS education FROM person",
    "feat_trailing_30d": f"SELECT user_id, count(*) FILTER (event_type = 'view') AS view_30d, count(*) FILTER (event_type = 'click') AS click_30d, count(*) FILTER (event_type = 'purchase') AS purchase_30d, count(*) AS all_30d FROM events WHERE ts >= TIMESTAMP '{s.AS_OF}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{s.AS_OF}' GROUP BY user_id",
    "feat_text_similarity": f"""WITH p AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t, '{SIMILAR_TO}' AS w FROM part)
      SELECT p_partkey, round({_EDITS}, 6) AS by_edits, round({_WORDS}, 6) AS by_words FROM p""",
    "feat_tenure": f"WITH {r.CAREERS_SQL} SELECT o_custkey, round({_TENURE}, 4) AS months, CAST(max(o_orderkey % 8) AS INTEGER) AS largest FROM jobs GROUP BY o_custkey",
    "honeypot_flags": f"WITH {_FLAGS} SELECT candidate_id, array_to_string(flags, ',') AS flags FROM flagged",
    "jd_skill_overlap": f"WITH {r.CAREERS_SQL}, w AS (SELECT o_custkey, unnest(regexp_split_to_array(lower(description), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM jobs) SELECT o_custkey, count(DISTINCT word) FILTER (word IN {tuple(x for x in _WANT['must_skills'] if ' ' not in x)}) AS n_overlap FROM w GROUP BY o_custkey",
    "jd_relevance": f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents), {_relevance(JD_WORDS)} SELECT doc_id, round(relevance, 6) AS relevance FROM relevant",
    "rank_profiles": f"""WITH {_FLAGS}, t AS (
        SELECT c_custkey, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, d)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words
        FROM person LEFT JOIN (SELECT o_custkey, string_agg(description, ' ') AS d FROM jobs GROUP BY 1) ON c_custkey = o_custkey
      ), {_relevance(tuple(job.terms(JOB)))}, skilled AS (SELECT s_custkey, {_TRUST.format(wanted=tuple(_WANT['must_skills']))} AS trust, count(*) FILTER (name IN {tuple(_WANT['must_skills'])}) AS core FROM skill GROUP BY 1),
      tenured AS (SELECT o_custkey, {_TENURE} AS months FROM jobs GROUP BY 1),
      titled AS (SELECT t AS title, max(greatest({_EDITS}, {_WORDS})) AS likeness FROM (SELECT DISTINCT title, lower(title) AS t FROM person), (SELECT lower(unnest({[*features.AI_TITLES, *_WANT['title_words']]})) AS w) GROUP BY 1),
      scored AS (
        SELECT p.*, spans.years, response, skilled.core,
          0.35::DOUBLE * least(coalesce(trust, 0) / (2.0::DOUBLE * {len(_WANT['must_skills'])}), 1) + 0.1::DOUBLE * relevance + 0.25::DOUBLE * greatest(CAST({_AI.replace('title', 'p.title')} AS INTEGER), likeness)
          + 0.1::DOUBLE * CASE WHEN years BETWEEN {_WANT['min_years']} AND {_WANT['max_years']} THEN 1 ELSE 0.4::DOUBLE END + 0.05::DOUBLE * least(coalesce(months, 0) / 120, 1)
          + 0.08::DOUBLE * {_PLACE.format(places=tuple(_WANT['countries']), pattern='|'.join(_WANT['countries']))} + 0.07::DOUBLE * ((4 - tier) / 4) AS base,
          (coalesce(response, 0) + coalesce({_RECENCY}, 0) + coalesce(nullif(offers, -1), 0.5::DOUBLE)) / 3 AS signal
        FROM flagged p JOIN relevant USING (c_custkey) JOIN titled ON lower(p.title) = titled.title LEFT JOIN spans ON c_custkey = spans.o_custkey LEFT JOIN tenured ON c_custkey = tenured.o_custkey
          LEFT JOIN skilled ON c_custkey = s_custkey LEFT JOIN signal ON c_custkey = user_id
      ), rated AS (SELECT *, round(base * {_MODIFIER.format('signal')} / 1.2::DOUBLE * pow(0.5::DOUBLE, len(flags)), 4) AS score FROM scored),
      ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, candidate_id) AS INTEGER) AS rank FROM rated)
      SELECT candidate_id, rank, score, {_REASON.format(core='core')} AS reasoning FROM ranked WHERE rank <= 100""",
    "jd_lexical_score": f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents) SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(list_filter(words, lambda x: list_contains({list(JD_WORDS)}, x))) AS BIGINT) AS tf, CAST(len(list_filter({list(JD_WORDS)}, lambda x: list_contains(words, x))) AS BIGINT) AS n_terms FROM w",
    "jd_vector_topk": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT arg_min(e, vec_id) AS q FROM v), x AS (SELECT vec_id, round(list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)), 6) AS similarity FROM v, q), r AS (SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM x) SELECT vec_id, similarity, rank FROM r WHERE rank <= 100",
    "hybrid_rank": f"WITH {s.CANDIDATES_SQL}, h AS (SELECT candidate_id, CAST((35 * least(n_core, 9) + CASE WHEN title = '{s.AI_SEGMENT}' THEN 225 ELSE 0 END + CASE WHEN days BETWEEN {s.BAND_DAYS[0]} AND {s.BAND_DAYS[1]} THEN 135 ELSE 0 END + CASE WHEN n_regionkey = 2 THEN 90 ELSE 0 END) * (8000 + least(greatest(response_bp, 0), 4000)) AS BIGINT) AS hybrid FROM candidates JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT *, CAST(row_number() OVER (ORDER BY hybrid DESC, candidate_id) AS INTEGER) AS rank FROM h) SELECT candidate_id, rank, hybrid FROM r WHERE rank <= 100",
}
_RANKED = SQL["rank_profiles"]
SQL |= {
    "io_candidates_jsonl": f"WITH {r.PEOPLE_SQL}, {r.CAREERS_SQL}, {r.SKILLS_SQL}, j AS (SELECT o_custkey, count(*) AS n_jobs, CAST(min(year(start_date)) AS INTEGER) AS since FROM jobs GROUP BY 1), k AS (SELECT s_custkey, count(*) AS n_skills FROM skill GROUP BY 1) SELECT candidate_id, title, years, n_jobs, n_skills, since FROM person LEFT JOIN spans ON c_custkey = spans.o_custkey LEFT JOIN j ON c_custkey = j.o_custkey LEFT JOIN k ON c_custkey = s_custkey",
    "io_shortlist_csv": f"SELECT 0 AS row_ix, 'candidate_id|rank|score|reasoning' AS line UNION ALL SELECT rank, candidate_id || '|' || rank || '|' || printf('%.4f', score) || '|' || reasoning FROM ({_RANKED})",
}
QUERIES = {name: globals()[name] for name in SQL}
