"""A job description as requirements: skills, title words, years and countries, by dictionaries and patterns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlane.sources import scratch

# Dictionaries for reading job descriptions.
SKILLS = (
    "python", "sql", "spark", "pyspark", "java", "scala", "pytorch", "tensorflow", "machine learning", "deep learning", "nlp", "llm", "rag", "embeddings", "vector search",
    "computer vision", "mlops", "kubernetes", "docker", "aws", "gcp", "azure", "airflow", "kafka", "recommendation systems", "information retrieval", "statistics",
)
TITLE_WORDS = ("engineer", "scientist", "analyst", "manager", "developer", "architect", "researcher", "designer", "lead")
COUNTRIES = ("india", "united states", "united kingdom", "germany", "france", "canada", "australia", "singapore", "netherlands", "spain")
CORE = ("python", "machine learning", "deep learning", "nlp", "llm", "rag", "embeddings", "pytorch", "vector search")


def parse(text: str) -> dict:
    """must_skills, title_words, min_years, max_years, countries of one job description (a parameter, not data)."""
    plain = f" {re.sub(r'[^a-z0-9+#]+', ' ', text.lower())} "
    listed = lambda words: [w for w in words if f" {w} " in plain or f" {w}s " in plain]
    span = re.search(r"(\d+)\s*(?:-|to|–)\s*(\d+)\s*(?:\+\s*)?years", text.lower())
    least = re.search(r"(\d+)\s*\+?\s*years", text.lower())
    low, high = (float(span[1]), float(span[2])) if span else (float(least[1]), 50.0) if least else (0.0, 50.0)
    return {"must_skills": listed(SKILLS) or list(CORE), "title_words": listed(TITLE_WORDS), "min_years": low, "max_years": high, "countries": listed(COUNTRIES)}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def overlap(text: Column, wanted: Column) -> Column:
    """How many different wanted words a text has."""
    return F.size(F.array_intersect(words(text), wanted))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; NULL if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


# The usual constants of the relevance score.
K1, B = 1.2, 0.75


def terms(text: str) -> list[str]:
    """The different words of a job description, sorted."""
    return sorted(set(re.findall(r"[^\W_]+", text.lower())))


def relevance(texts: DataFrame, wanted: list[str], tokens: Column, name: str = "relevance") -> DataFrame:
    """Adds how relevant each row's words are to the wanted ones, 0 to 1: BM25 over its largest possible value.

    Rare words weigh more, by how many rows of `texts` have them; one aggregate row holds these statistics.
    """
    if not wanted:
        return texts.withColumn(name, F.lit(0.0))
    counted = texts.withColumn("_tokens", F.coalesce(tokens, F.array().cast("array<string>"))).withColumn("_len", F.size("_tokens"))
    # the wanted words of a row, of which there are few, are counted; and the rows are worked out once, for the statistics and the scores
    held = F.filter("_tokens", lambda w: w.isin(*wanted))
    counts = F.transform(F.array(*map(F.lit, wanted)), lambda t: F.size(F.filter(F.col("_held"), lambda w: w == t)))
    counted = counted.withColumn("_held", held).drop("_tokens").withColumn("_tf", counts).drop("_held")
    counted = scratch.cut(counted, "relevance")
    held = [F.sum((F.col("_tf")[k] > 0).cast("long")).alias(f"d{k}") for k in range(len(wanted))]
    row = counted.agg(F.count("*").alias("n"), F.avg("_len").alias("mean"), *held).first()
    n, mean = row["n"], row["mean"] or 1.0
    idf = [math.log(1 + (n - (row[f"d{k}"] or 0) + 0.5) / ((row[f"d{k}"] or 0) + 0.5)) for k in range(len(wanted))]
    norm = K1 * (1 - B + B * F.col("_len") / mean)
    score = F.lit(0.0)
    for k, weight in enumerate(idf):
        score = score + F.lit(weight) * F.col("_tf")[k] / (F.col("_tf")[k] + norm)
    return counted.withColumn(name, score / sum(idf)).drop("_tf", "_len")
