"""The validator: expected reports written by hand, one mutation of a valid file at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shortlane.cli import main, validate_file
from shortlane.functions import ordering, pyparity
from shortlane.sources.submission import HEADER, write_shortlist


def valid():
    return [[f"CAND_{k:07d}", str(k), f"{1 - 0.008 * k:.4f}", "because"] for k in range(1, 101)]


def write(tmp_path, rows, header=HEADER, name="team.csv", prefix="", end="\r\n", raw=None):
    path = tmp_path / name
    text = prefix + end.join(",".join(r) for r in [header, *rows]) + end
    path.write_bytes(raw if raw is not None else text.encode())
    return str(path)


def changed(row, column, value):
    rows = valid()
    rows[row][column] = value
    return rows


CASES = {
    "valid": (valid(), []),
    "blank lines are not counted": ([*valid()[:5], [" ", ""], *valid()[5:]], []),
    "empty reasoning": (changed(0, 3, ""), []),
    "id with spaces": (changed(0, 0, " CAND_0000001 "), []),
    "id missing": (changed(3, 0, " "), ["Row 5: candidate_id is required."]),
    "id pattern": (changed(3, 0, "CAND_12"), ["Row 5: candidate_id must be CAND_XXXXXXX (7 digits)."]),
    "id repeated": (changed(3, 0, "CAND_0000003"), ["Row 5: duplicate candidate_id 'CAND_0000003'."]),
    "rank text": (changed(0, 1, "01"), ["Row 2: rank must be an integer (1–100).", "Each rank 1–100 must appear exactly once; missing: [1]"]),
    "rank range": (changed(99, 1, "101"), ["Row 101: rank must be between 1 and 100.", "Each rank 1–100 must appear exactly once; missing: [100]"]),
    "rank range moves the order": (changed(99, 1, "0"), ["Row 101: rank must be between 1 and 100.", "Each rank 1–100 must appear exactly once; missing: [100]", "score must be non-increasing by rank: rank 0 (0.2) < rank 1 (0.992)."]),
    "rank repeated": (changed(1, 1, "1"), ["Row 3: duplicate rank 1.", "Each rank 1–100 must appear exactly once; missing: [2]"]),
    "score text": (changed(0, 2, "1.0d"), ["Row 2: score must be a float."]),
    "score underscore": (changed(0, 2, "1_0"), []),
    "nan is silent": (changed(50, 2, "nan"), []),
    "rising": (changed(1, 2, "0.995"), ["score must be non-increasing by rank: rank 1 (0.992) < rank 2 (0.995)."]),
    "tie": ([*valid()[:1], ["CAND_0000000", "2", "0.9920", ""], *valid()[2:]], ["Equal scores at ranks 1 and 2: tie-break requires candidate_id ascending ('CAND_0000001' > 'CAND_0000000')."]),
    "arity": ([*valid()[:99], ["CAND_0000100", "100", "0.2"]], ["Row 101: expected 4 columns (candidate_id,rank,score,reasoning), got 3.", "Each rank 1–100 must appear exactly once; missing: [100]"]),
    "count": (valid()[:99], ["After the header (row 1), there must be exactly 100 data rows (rows 2–101); found 99.", "Each rank 1–100 must appear exactly once; missing: [100]"]),
}


@pytest.mark.parametrize("case", CASES)
def test_mutations(spark, tmp_path, case):
    rows, expected = CASES[case]
    assert validate_file(spark, write(tmp_path, rows)) == expected


def test_file_level(spark, tmp_path):
    assert validate_file(spark, write(tmp_path, valid(), name="team.txt")) == ["Filename must use a .csv extension."]
    assert validate_file(spark, write(tmp_path, [], raw=b"", name="a.csv")) == ["Row 1 must be the header row; file is empty."]
    assert validate_file(spark, write(tmp_path, [], raw=b"\xffA", name="b.csv")) == ["File must be UTF-8 encoded."]
    none = str(tmp_path / "none.csv")
    assert validate_file(spark, none) == [f"Cannot read file: [Errno 2] No such file or directory: '{none}'"]
    far = ",".join(HEADER[:3]).encode() + b"\n" + b"x,1,1,ok\n" * 2000 + b"\xff"  # the header is read before the bad byte
    late = validate_file(spark, write(tmp_path, [], raw=far, name="e.csv"))
    assert late[0].startswith("Row 1 (header) must be exactly:") and late[1:] == ["File must be UTF-8 encoded."]
    bom = validate_file(spark, write(tmp_path, valid(), prefix="﻿", name="c.csv"))
    assert len(bom) == 1 and bom[0].startswith("Row 1 (header) must be exactly:")
    assert validate_file(spark, write(tmp_path, valid(), end="\r", name="d.csv")) == []


def test_number_texts_agree_with_python(spark):
    r = random.Random(1)
    texts = list({"".join(r.choices("0019.eE+-_naif dx", k=r.randrange(1, 7))) for _ in range(4000)} | {"nan", "-inf", "Infinity", "007", "-0", "1" * 40, "."})
    texts += ["١٢", "𝟙.𝟚", "1٫2", "१_०", "²", "-٣e٢", "①"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = df["t"]
    for row in df.select("t", pyparity.strip(t).alias("s"), pyparity.is_canonical_int(t).alias("i"), pyparity.to_float(t).alias("f")).collect():
        def attempt(f, x=row["t"]):
            try:
                return f(x)
            except ValueError:
                return None

        as_int, as_float = attempt(int), attempt(lambda x: float(x) if x == x.strip() else None)
        assert row["s"] == row["t"].strip()
        assert row["i"] == (as_int is not None and str(as_int) == row["t"])
        assert row["f"] == as_float or (row["f"] is not None and math.isnan(row["f"]) and math.isnan(as_float))


def test_writer_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(r[0], int(r[1]), float(r[2]), 'a "b", c') for r in valid()], "candidate_id string, rank int, score double, reasoning string")
    write_shortlist(rows, str(tmp_path / "out.csv"))
    assert validate_file(spark, str(tmp_path / "out.csv")) == []
    with pytest.raises(ValueError):
        write_shortlist(rows.limit(5), str(tmp_path / "few.csv"))


def test_usage(capsys):
    assert main(["validate"]) == 1 and main(["validate", "a.csv", "b.csv"]) == 1
    assert capsys.readouterr().out.startswith("Usage: ")


def test_numbering_over_many_buckets(spark, monkeypatch):
    """Buckets of buckets: numbers and neighbours are those of one sorted list."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 3)
    r = random.Random(3)
    keys = r.sample(range(500), 120)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, g long")
    got = ordering.numbered(df, F.floor(F.col("k") / 3), [F.col("k")], "place", 2).collect()
    assert {x["k"]: x["place"] for x in got} == {k: n for n, k in enumerate(sorted(keys), 2)}
    near = ordering.with_next(df.withColumn("part", F.floor(F.col("k") / 3)), ["g", "part"], [F.col("k")], ["k"]).collect()
    order = sorted((k % 7, k) for k in keys)
    assert {x["k"]: x["next_k"] for x in near} == {a[1]: b[1] if b else None for a, b in zip(order, [*order[1:], None], strict=True)}


def test_rows_are_counted_without_numbers(spark):
    from shortlane.plans import validation

    plan = validation.val_row_count(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
