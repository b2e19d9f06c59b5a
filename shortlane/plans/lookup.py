"""Search, linking and file queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlane.operators import intervals, isolation, job, linking, search, semantics
from shortlane.plans.surrogate import table
from shortlane.sources import csv_parallel, scratch
from shortlane.streaming import responses

#: The day at which open jobs are cut.
UNTIL = "1999-12-31"
#: Words that are linked have so many letters at least.
LINKED_LETTERS = 6


def jd_wand_topk(spark, d) -> DataFrame:
    """The 100 most relevant documents for each of many descriptions at once (items of the benchmark table)."""
    index = search.build(table(spark, d, "documents"), "doc_id", "text")
    best = search.search(index, table(spark, d, "benchmark"), "item_id", "text").best
    return best.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _names(text: Column) -> Column:
    return F.explode(F.array_distinct(F.filter(job.words(text), lambda w: w.rlike(f"^[a-z]{{{LINKED_LETTERS},}}\\z"))))


def link_words_fuzzy(spark, d) -> DataFrame:
    """Words of descriptions (benchmark) and words of profiles' texts (conversations) that at most two edits part."""
    asked = table(spark, d, "benchmark").select(_names(F.col("text")).alias("word"))
    held = table(spark, d, "conversations").select(_names(F.col("text")).alias("word"))
    return linking.within_edits(held, asked, 2).select(F.col("left").alias("held"), F.col("right").alias("asked"), F.col("distance").cast("int").alias("distance"))


def val_csv_parallel(spark, d) -> DataFrame:
    """Documents written as CSV files, with line ends and quotes inside cells, and read back split by split."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    bare = F.coalesce("text", F.lit(""))
    text = F.when(bare.rlike('[",\r\n]'), quoted(F.col("text"))).otherwise(bare)
    path = scratch.new_path(spark, "documents-csv")
    table(spark, d, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted(F.col("lang")), text, F.lit("end")).alias("value")).write.text(path)
    rows = csv_parallel.read_files(spark, path)
    cells = F.col("cells")
    return rows.select(cells[0].cast("long").alias("doc_id"), F.size(cells).cast("long").alias("n_cells"), cells[1].alias("lang"), F.length(cells[2]).cast("long").alias("n_chars"), F.md5(cells[2].cast("binary")).alias("text_md5"))


def sem_ppmi(spark, d) -> DataFrame:
    """Which words of the documents stand together more often than by chance."""
    return semantics.ppmi(table(spark, d, "documents"), "text").select("a", "b", "n", F.round("ppmi", 6).alias("ppmi"))


def jd_semantic_topk(spark, d) -> DataFrame:
    """The ten documents nearest to each description (benchmark) by the vectors of their words, learnt from the documents."""
    docs = table(spark, d, "documents")
    vectors = scratch.cut(semantics.word_vectors(docs, "text"), "word-vectors")
    held = semantics.text_vectors(docs, "doc_id", "text", vectors)
    asked = semantics.text_vectors(table(spark, d, "benchmark"), "item_id", "text", vectors)
    return semantics.nearest(held, asked, 10).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "similarity", "rank")


def career_coverage(spark, d) -> DataFrame:
    """Days covered, gaps and overlaps of every career: each order is a job of some days, some of which are still open."""
    days = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400 - 20).cast("int"))
    jobs = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("begun"), F.when(F.col("o_orderkey") % 50 != 0, days).alias("ended"))
    found = intervals.coverage(intervals.tidy(jobs, "o_custkey", "o_orderkey", "begun", "ended", F.to_date(F.lit(UNTIL))))
    return found.select(F.col("key").alias("o_custkey"), *(F.col(c).cast("long").alias(c) for c in found.columns if c != "key"))


def signals_as_of(spark, d) -> DataFrame:
    """For each purchase, the last view of the same user at or before it."""
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return intervals.as_of(bought, seen, "user_id", "ts", "view_id", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


def response_times(spark, d) -> DataFrame:
    """Hours until each contact (click) was answered (purchase), null without an answer in time; of all contacts whose wait is over."""
    return responses.batch(table(spark, d, "events")).select("user_id", "event_id", F.round("hours", 4).alias("hours"))


def response_times_stream(spark, d) -> DataFrame:
    """The same by the stream: events arrive in files of a folder and contacts are closed by timers."""
    source, sink, check = (scratch.new_path(spark, f"responses-{n}") for n in ("in", "out", "state"))
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    events.write.parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, responses.STORE)
    try:
        found = responses.stream(spark.readStream.schema(events.schema).parquet(source))
        found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(responses.OUT).parquet(sink).select("user_id", "event_id", F.round("hours", 4).alias("hours"))


def honeypot_isolation(spark, d) -> DataFrame:
    """How odd each candidate is, by an isolation forest over its orders: number, span, sums, and how these fit together."""
    day, price = F.unix_date(F.to_date("o_orderdate")), F.col("o_totalprice").cast("double")
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"), (F.max(day) - F.min(day)).alias("days"), F.sum(price.cast("decimal(18,2)")).cast("double").alias("total"), F.max(price).alias("most"))
    people = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("balance"))
    rows = people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns({"per_job": F.col("total") / F.col("jobs"), "pace": F.col("days") / F.col("jobs")})
    rows = scratch.cut(rows, "isolation-rows")
    forest = isolation.fit(rows, "c_custkey", ["balance", "jobs", "days", "total", "most", "per_job", "pace"])
    return rows.select("c_custkey", F.round(isolation.score(forest), 6).alias("score"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_LINKED = f"list_filter({_WORDS}, lambda x: regexp_full_match(x, '[a-z]{{6,}}'))"
SQL = {
    "jd_wand_topk": f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), size AS (SELECT count(*) AS n, avg(coalesce(len(words), 0)) AS mean FROM d),
      w AS (SELECT doc_id, len(words) AS l, unnest(words) AS word FROM d), p AS (SELECT doc_id, word, l, count(*) AS tf FROM w GROUP BY ALL), held AS (SELECT word, count(*) AS df FROM p GROUP BY word),
      q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS word FROM benchmark),
      scored AS (
        SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score
        FROM q JOIN p USING (word) JOIN held USING (word), size GROUP BY ALL),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored)
      SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 100""",
    "link_words_fuzzy": f"""WITH a AS (SELECT DISTINCT unnest({_LINKED}) AS asked FROM benchmark), h AS (SELECT DISTINCT unnest({_LINKED}) AS held FROM conversations)
      SELECT held, asked, CAST(levenshtein(held, asked) AS INTEGER) AS distance FROM h JOIN a ON abs(length(held) - length(asked)) <= 2 WHERE levenshtein(held, asked) <= 2""",
    "val_csv_parallel": "SELECT doc_id, CAST(4 AS BIGINT) AS n_cells, coalesce(lang, '') AS lang, length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5 FROM documents",
}
SQL["sem_ppmi"] = f"""WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents), t AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS pos FROM d),
  known AS (SELECT w FROM t GROUP BY w HAVING count(DISTINCT doc_id) >= 20 ORDER BY count(DISTINCT doc_id) DESC, w LIMIT 65536),
  near AS (SELECT x.w AS a, y.w AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.pos BETWEEN x.pos + 1 AND x.pos + 4 WHERE x.w IN (FROM known) AND y.w IN (FROM known)),
  pairs AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY ALL),
  sums AS (SELECT a, sum(n) AS s FROM pairs GROUP BY a), total AS (SELECT sum(n) AS total FROM pairs),
  scored AS (SELECT pairs.a, pairs.b, n, ln(n * total::DOUBLE / (x.s::DOUBLE * y.s::DOUBLE)) AS ppmi FROM pairs JOIN sums x ON pairs.a = x.a JOIN sums y ON pairs.b = y.a, total)
  SELECT a, b, n, round(ppmi, 6) AS ppmi FROM scored WHERE ppmi > 0"""
SQL["career_coverage"] = f"""WITH j AS (
    SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 50 = 0 THEN DATE '{UNTIL}' ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL (o_orderkey % 400 - 20) DAY AS DATE) END AS e FROM orders
  ), k AS (SELECT * FROM j WHERE s < e),
  pairs AS (SELECT a.o_custkey, count(*) AS n, sum(date_diff('day', greatest(a.s, b.s), least(a.e, b.e))) AS d FROM k a JOIN k b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s < b.e AND b.s < a.e GROUP BY 1),
  days AS (SELECT o_custkey, count(DISTINCT day) AS covered FROM (SELECT o_custkey, unnest(generate_series(s, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM k) GROUP BY 1),
  starts AS (SELECT o_custkey, count(DISTINCT s) AS n FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.o_custkey = x.o_custkey AND y.s < x.s AND y.e >= x.s) GROUP BY 1),
  spans AS (SELECT o_custkey, date_diff('day', min(s), max(e)) AS span FROM k GROUP BY 1)
  SELECT o_custkey, covered AS covered_days, starts.n - 1 AS n_gaps, span - covered AS gap_days, coalesce(pairs.n, 0) AS n_overlaps, CAST(coalesce(d, 0) AS BIGINT) AS overlap_days
  FROM days JOIN starts USING (o_custkey) JOIN spans USING (o_custkey) LEFT JOIN pairs USING (o_custkey)"""
SQL["signals_as_of"] = """SELECT p.event_id, v.event_id AS view_id, v.value AS view_value
  FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts"""
SQL["response_times"] = """WITH a AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), newest AS (SELECT max(ts) AS m FROM a),
  c AS (SELECT user_id, event_id, ts FROM a, newest WHERE event_type = 'click' AND ts + INTERVAL 72 HOUR + INTERVAL 1 MILLISECOND <= m)
  SELECT c.user_id, c.event_id, round((epoch_us(min(p.ts)) - epoch_us(c.ts)) / 3.6e9::DOUBLE, 4) AS hours
  FROM c LEFT JOIN a p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 24 HOUR GROUP BY c.user_id, c.event_id, c.ts"""
SQL["response_times_stream"] = SQL["response_times"]
QUERIES = {name: globals()[name] for name in [*SQL, "jd_semantic_topk", "honeypot_isolation"]}
