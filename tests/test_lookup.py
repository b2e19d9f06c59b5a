"""Search, linking and parallel CSV against brute force."""

import csv
import io
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shortlane.cli import validate_file
from shortlane.operators import linking, search
from shortlane.sources import csv_parallel, scratch

# ---- search


def brute_search(docs, queries, k):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scores = Counter()
        for term in set(re.findall(r"[^\W_]+", (text or "").lower())) & set(df):
            idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            for i, ws in words.items():
                tf = ws.count(term)
                if tf:
                    scores[i] += idf * tf / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, docs, queries, k, range_rows=4, shard_rows=50, **options):
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string, term string, n int"), "doc_id", "text", range_rows, shard_rows)
    got = search.search(index, spark.createDataFrame(queries, "item_id long, text string, id int"), "item_id", "text", k, **options)
    return sorted(map(tuple, got.best.collect())), got


def close(a, b):
    return len(a) == len(b) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 2e-6 and x[3] == y[3] for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_full_scoring(spark, seed, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 512 if seed == 1 else 10)  # one block of descriptions, and several
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40))), "x", 1) for i in range(300)]
    docs += [(1000 + i, docs[5][1], "x", 1) for i in range(30)] + [(2000, None, "x", 1), (2001, "", "x", 1)]  # ties, no text
    queries = [(q, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12))), 1) for q in range(25)] + [(90, None, 1), (91, "unknown words", 1), (92, "w0 W0 w0, w1!", 1)]
    want = brute_search([d[:2] for d in docs], [q[:2] for q in queries], 10)
    got, _ = found(spark, docs, queries, 10, first=2)
    assert close(got, want)
    got, _ = found(spark, docs, queries, 1000, first=1)  # more than there are
    assert close(got, brute_search([d[:2] for d in docs], [q[:2] for q in queries], 1000))


def test_search_leaves_postings_unscored(spark):
    """Rare words decide: most of what frequent words have is never scored."""
    rng = random.Random(3)
    common = [f"c{k}" for k in range(8)]
    docs = [(i, " ".join([*common, *(f"r{rng.randrange(400)}" for _ in range(6))]), "x", 1) for i in range(1500)]
    queries = [(q, " ".join([*common, *(f"r{rng.randrange(400)}" for _ in range(3))]), 1) for q in range(20)]
    got, how = found(spark, docs, queries, 5, shard_rows=400)
    assert close(got, brute_search([d[:2] for d in docs], [q[:2] for q in queries], 5))
    assert how.scored < how.matching / 3


def test_search_of_nothing(spark):
    assert found(spark, [], [(1, "a", 1)], 5)[0] == []
    assert found(spark, [(1, "a b", "x", 1)], [], 5)[0] == []
    assert found(spark, [(1, None, "x", 1)], [(1, "a", 1)], 5)[0] == []


def test_postings_are_not_shuffled_to_be_chosen(spark):
    """Joins that choose blocks send the small side, so only chosen postings are dealt, once."""
    index = search.build(spark.createDataFrame([(i, f"a b w{i}") for i in range(50)], "id long, text string"), "id", "text", 4, 20)
    bounds = spark.createDataFrame([(1, s, r, 1.0) for s in range(3) for r in range(4)], "query long, shard long, range long, bound double")
    weights = spark.createDataFrame([(1, "a", 1.0)], "query long, term string, weight double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    first = plan(search._first_scores(index, bounds.repartition("query"), weights.repartition("term"), 2, 2))
    assert "hashpartitioning(shard" not in first and "SortMergeJoin" not in first
    live = scratch.cut(bounds.select("shard", "range").distinct(), "live")
    blocks = search._live_blocks(index, live, weights.repartition("term")).groupBy("shard", "range").applyInArrow(lambda k, t: t.select(["term"]), "term string")
    dealt = plan(blocks)
    assert "SortMergeJoin" not in dealt and dealt.count("hashpartitioning(shard") == 1


# ---- linking


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_links_are_all_pairs_within_edits(spark, edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choices("abcé€", k=rng.randint(0, 11)))
    left, right = [word() for _ in range(150)], [word() for _ in range(150)]
    for w in left[:60]:  # near ones
        w = list(w)
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randint(0, len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        right.append("".join(w))
    got = linking.within_edits(spark.createDataFrame([(w,) for w in [*left, None, left[0]]], "distance string"), spark.createDataFrame([(w,) for w in [*right, None]], "key string"), edits).collect()
    want = {(a, b, distance(a, b)) for a in left for b in right if distance(a, b) <= edits}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_links_of_nothing(spark):
    empty = spark.createDataFrame([], "w string")
    assert linking.within_edits(empty, spark.createDataFrame([("a",)], "w string")).count() == 0


# ---- CSV

PIECES = st.lists(st.sampled_from(["a", "b", '"', '""', ",", "\n", "\n", "\r", "\r\n", " ", '"\n', "é", ",end", "\0"]), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(PIECES, st.lists(st.integers(0, 30), max_size=3))
def test_splits_compose_to_the_reader(pieces, cuts):
    text = "".join(pieces)
    lines = [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if text.split("\n")[-1] else [])
    bounds = [0, *sorted(min(c, len(lines)) for c in cuts), len(lines)]
    inside, number, rows = False, 0, {}
    for a, b in zip(bounds, bounds[1:], strict=False):
        does = csv_parallel.scan(iter(lines[a:b]))
        for row_ix, cells, whole in csv_parallel.parse(iter(lines[a:b]), inside, number):
            rows.setdefault(row_ix, []).append((cells, whole))
        inside, number = does.inside[inside], number + does.records[inside]
    got = []
    for row_ix in sorted(rows):
        cells = rows[row_ix][0][0]
        assert len(rows[row_ix]) == 1 or not any(whole for _, whole in rows[row_ix])
        for more, _ in rows[row_ix][1:]:
            cells = [*cells[:-1], cells[-1] + more[0], *more[1:]]
        got.append(cells)
    assert got == list(csv.reader(io.StringIO(text, newline="")))
    assert sorted(rows) == list(range(len(rows)))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "61")
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def read(spark, path):
    return [r["cells"] for r in csv_parallel.read_rows(spark, str(path)).orderBy("row_ix").collect()]


@pytest.mark.parametrize("seed", range(5))
def test_csv_of_many_splits(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    pieces = ["a", "b", '"', '"x""y"', ",", ",", "\n", "\n", "\r", "\r\n", '"\n', "é€", "𝄞", "some words"]
    text = "﻿" * (seed % 2) + ('"begins, quoted\n"' if seed > 2 else "") + "".join(rng.choices(pieces, k=300))
    path = tmp_path / "a b.csv"
    path.write_bytes(text.encode())
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 5  # one file in many tasks
    assert read(spark, path) == list(csv.reader(io.StringIO(text, newline="")))


def test_csv_cells_over_many_splits(spark, tmp_path, small_splits):
    text = "id,text\r\n" + "".join(f'{k},"' + f'line {k}, "" é\n' * (k % 9) + '"\r\n' for k in range(40)) + '41,"never closed\n\nlast'
    for end in ("", "\n"):
        (tmp_path / f"x{len(end)}.csv").write_bytes((text + end).encode())
        assert read(spark, tmp_path / f"x{len(end)}.csv") == list(csv.reader(io.StringIO(text + end, newline="")))
    got = csv_parallel.read_files(spark, str(tmp_path)).groupBy("file").count().collect()  # a folder: each file has numbers of its own
    assert sorted(r["count"] for r in got) == [42, 42]


def test_csv_odd_files(spark, tmp_path):
    for name, raw in {"empty": b"", "blank": b"\n\n", "one": b"a", "tail": b'a,"b', "bom": "﻿\"a\",b\n".encode()}.items():
        (tmp_path / name).write_bytes(raw)
        assert read(spark, tmp_path / name) == list(csv.reader(io.StringIO(raw.decode(), newline=""))), name
    (tmp_path / "bad").write_bytes(b"a,b\n\xff,c\nd,e\n")
    rows = {r["row_ix"]: r["cells"] for r in csv_parallel.read_rows(spark, str(tmp_path / "bad")).collect()}
    assert rows[-1] is None and rows[0] == ["a", "b"] and rows[2] == ["d", "e"]
    (tmp_path / "wide").write_bytes(b"a," + b"x" * csv_parallel.CELL_LIMIT + b"\n")
    assert len(read(spark, tmp_path / "wide")[0][1]) == csv_parallel.CELL_LIMIT
    (tmp_path / "wider").write_bytes(b"a," + b"x" * (csv_parallel.CELL_LIMIT + 1) + b"\n")
    with pytest.raises(Exception, match="larger than field limit"):
        read(spark, tmp_path / "wider")


def test_scratch_is_shared(spark):
    assert scratch.new_path(spark, "a") != scratch.new_path(spark, "a")


def test_large_files_are_validated_in_parallel(spark, tmp_path, monkeypatch):
    from shortlane import cli

    rows = [f"CAND_{k:07d},{k},{1 - 0.008 * k:.4f},\"because\n{k}\"" for k in range(1, 101)]
    path = tmp_path / "team.csv"
    path.write_text("candidate_id,rank,score,reasoning\n" + "\n".join(rows), encoding="utf-8")
    monkeypatch.setattr(cli, "LARGE_FILE", 100)
    assert validate_file(spark, str(path)) == []
    path.write_text("candidate_id,rank,score,reasoning\n" + "\n".join(rows[:99]), encoding="utf-8")
    assert len(validate_file(spark, str(path))) == 2
