"""Every query with an oracle gives DuckDB's rows and types on the smallest tables; the stream gives the batch's counts."""

import duckdb
import pytest

from shortlane import catalog
from shortlane.plans import records
from shortlane.sources import scratch
from shortlane.streaming import counters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_oracle(spark, duck, name):
    mine, other = catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    assert {c: TYPES[str(t)] for c, t in zip(other.columns, other.types, strict=True)} == dict(mine.dtypes)
    named = ", ".join(f'"{c}"' for c in columns)
    theirs = duck.sql(f"SELECT {named} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, mine.select(*columns).collect()))) == sorted(map(repr, theirs))


def test_ranking_compares_titles_once(spark, monkeypatch):
    """Each title is compared once, not once a profile; skills go through joins and exchanges as numbers."""
    written, cut = {}, scratch.cut
    monkeypatch.setattr(scratch, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    assert catalog.queries()["rank_profiles"](spark, SF).count() == 100
    titles = written["titles"].select("_title")
    assert titles.count() == titles.distinct().count() == written["relevance"].select("profile.current_title").distinct().count() < 10
    skills = records.skills(spark, SF)
    assert "hashpartitioning(s_custkey" in (plan := skills._jdf.queryExecution().executedPlan().toString()) and ", name#" not in plan.split("hashpartitioning(s_custkey")[1].split("\n")[0]
    assert sum(len(r["skills"]) - len({k["name"] for k in r["skills"]}) for r in skills.collect()) == 0


def test_csv_dialect(spark):
    rows = catalog.queries()["val_csv_dialect"](spark, SF).where("r_regionkey = 0").orderBy("row_ix").collect()
    assert [r["n"] for r in rows] == [2, 3, 0, 1]
    assert rows[0]["cells"].startswith("﻿a|b \"q\" \n c")


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.write.parquet(str(tmp_path / "in"))
    stream = counters.trailing_counts(spark.readStream.schema(counters.EVENT_SCHEMA).parquet(str(tmp_path / "in")), 5)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("trailing").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(repr, spark.table("trailing").collect())) == sorted(map(repr, counters.trailing_counts(events, 5).collect()))
