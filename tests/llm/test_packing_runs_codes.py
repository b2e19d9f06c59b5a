"""Packing, runs and vector codes against brute force, and their odd rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shortlane.llm import codes, packing, runs

SF = "/root/testdata/sf0.01"


# ---- packing


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room + items[k] <= capacity:
                rest = list(bins)
                rest.remove(room)
                go(k + 1, [*rest, room + items[k]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.integers(4, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_dominance_keeps_the_optimum(case):
    """What is fixed belongs to a packing with the fewest sequences, and the plan places each piece once."""
    capacity, items = case
    left = Counter(items)
    fixed = packing.fix_dominating(left, capacity)
    assert sum(n for _, n in fixed) + fewest(list(left.elements()), capacity) == fewest(items, capacity)
    sets, _ = packing.plan_sets(Counter(items), capacity)
    placed = Counter()
    for held, times in sets:
        assert sum(x * n for x, n in held.items()) <= capacity
        placed.update({x: n * times for x, n in held.items()})
    assert +placed == Counter(items)


def test_best_fit_is_the_item_by_item_rule():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([12, 30, 64])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 60))), reverse=True)
        rooms = []
        for x in items:
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((capacity if fit is None else fit) - x)
        mine = packing.best_fit(Counter(items), capacity)
        assert sorted(capacity - sum(x * n for x, n in held.items()) for held, times in mine for _ in range(times)) == sorted(rooms)


def check_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing_query(spark):
    """Every piece as the tokenizer gives it from the whole text; sequences are gapless and hardly more than the sum needs."""
    from tokenizers import Tokenizer

    rows = packing.op11_best_fit_packing(spark, SF).collect()
    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    want = {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = [*encode(d["text"] or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[d["doc_id"], piece] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    n = check_packed(rows, 2048)
    assert n <= max(-(-sum(r["length"] for r in rows) // 2048) * 1.01 + 1, sum(r["length"] > 1024 for r in rows))


def test_packing_odd_rows(spark):
    texts = [None, "", "  \t\n", "word", "ÀÉ x y é", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "it's 3.5% \x1c\x85 don't", "long " * 30000, "same", "same"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, 7, 1.5) for i, t in enumerate(texts)], "doc_id long, text string, offset long, length double")
    rows = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    for i, t in enumerate(texts):
        mine = sorted((r for r in rows if r["doc_id"] == (i if i != 3 else None)), key=lambda r: r["piece"])
        whole = b"".join(bytes(r["ids"]) for r in mine)
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        assert list(struct.unpack(f"<{len(whole) // 4}I", whole)) == ids
        assert [r["length"] for r in mine[:-1]] == [2048] * (len(mine) - 1)
    check_packed(rows, 2048)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack_documents(docs, packing.tokenizer_path())).collect()}
    assert sum(map(len, whole.values())) == sum(4 * r["length"] for r in rows)
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_path()).count() == 0
    with pytest.raises(ValueError, match="made here"):
        packing.pack(docs)
    with pytest.raises(ValueError, match="1 to 2048"):
        packing.pack(spark.createDataFrame([(0,)], "length long"))


def test_packing_one_length(spark):
    """Many pieces of one length are numbered in several stretches."""
    pieces = spark.range(20000).selectExpr("id", "IF(id % 3 = 0, 2L, 700L) AS length")
    rows = packing.pack(pieces).collect()
    assert len({r["id"] for r in rows}) == 20000
    assert check_packed(rows, 2048) == -(-(20000 - 6667) // 2)


def test_word_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    ids = packing.WordIds(packing.tokenizer_path())
    texts = [b"a b c. d!!", b"d e f", b"a f g h i", b"a b c d", b"x.", b"x <|endoftext|>. X.", b"it's. a\xc3\xa9. .. b'."]
    fresh = [packing.WordIds(packing.tokenizer_path()).texts([t])[0] for t in texts]
    assert [ids.texts([t])[0] for t in texts] == fresh
    assert ids.texts(texts) == fresh
    for k in range(50):
        ids.texts([b"w%d v%d" % (k, k)])
    assert len(ids.known) + len(ids.older) <= 10  # two generations, of the limit and a batch's words each


# ---- runs


def brute_runs(words, least=6, exponent=4):
    n, found = len(words), set()
    for period in range(1, n // exponent + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j - i + period
            if length >= max(least, exponent * period):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + q] for k in range(length - q)) for q in range(1, period)):
                    found.add((i, length, period))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


WORDS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.integers(1, 9)), max_size=6).map(lambda parts: [w for unit, times in parts for w in unit * times])


@settings(max_examples=500, deadline=None)
@given(WORDS)
def test_runs_are_brute_force(words):
    want = brute_runs(words)
    assert runs.runs_of(words) == want
    if len(words) >= 6:
        assert runs._found(np.array(words, dtype=np.int64), words, 6, 4, hashed=False) == want


@settings(max_examples=200, deadline=None)
@given(WORDS, st.integers(2, 5))
def test_runs_of_other_exponents(words, exponent):
    assert runs.runs_of(words, 3, exponent) == brute_runs(words, 3, exponent)


def test_runs_long_and_adversarial():
    assert runs.runs_of([0] * 50000) == [(0, 50000, 1)]
    assert runs.runs_of(list(range(9000)) * 5) == [(0, 45000, 9000)]
    thue = [0]
    while len(thue) < 1 << 14:  # equal hashes modulo 2**64 for different stretches: only the words tell them apart
        thue += [1 - x for x in thue]
    assert runs.runs_of(thue) == []
    assert runs.runs_of(thue + [0, 1] * 8) == [r for r in brute_runs(thue[-64:] + [0, 1] * 8) for r in [(r[0] + len(thue) - 64, *r[1:])]]


def test_false_hashes_are_found_out(monkeypatch):
    """Hashes that take everything for equal change no result: claims are read word by word."""
    monkeypatch.setattr(runs.Extensions, "equal", lambda self, a, b, length: np.ones(len(a), dtype=bool))
    rng = random.Random(4)
    for _ in range(50):
        words = [rng.randrange(2) for _ in range(60)] + [0, 1, 1] * 6
        assert runs.runs_of(words) == brute_runs(words)


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {}
    found = brute_runs([numbers.setdefault(w, len(numbers)) for w in words]) if n < 1200 else runs.runs_of([numbers.setdefault(w, len(numbers)) for w in words])
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_query(spark):
    rows = runs.op12_periodic_run_detection(spark, "/root/testdata/sf0.001").collect()
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        mine = tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
        assert mine == expected_runs(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]
    assert sum(r["n_runs"] > 0 for r in rows) > 5


def test_runs_odd_rows(spark):
    rewritten_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = {0: None, 1: "", 2: " \t", 3: "a " * 7, 4: "a b c " * 4, 5: "é\x1cé " * 50000, rewritten_id: "one two three four five six seven eight nine ten"}
    rows = [(k, v, "x", 1) for k, v in texts.items()] + [(None, "b b b b b b", "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, period int")
    got = {r["doc_id"]: r for r in runs.periodic_runs(runs.rewritten(docs)).collect()}
    assert got[0]["runs"] == [] and got[0]["collapsed"] == ""
    assert [tuple(r) for r in got[3]["runs"]] == [(0, 7, 1)] and got[3]["collapsed"] == "a"
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 8, 2)] and got[4]["collapsed"] == "a b c"
    assert [tuple(r) for r in got[5]["runs"]] == [(0, 50000, 1)]
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 6, 1)]
    assert runs.periodic_runs(docs).count() == len(rows)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# ---- codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and len(r[1]) and all(x is not None and math.isfinite(x) for x in r[1])]
    x = [[math.floor(4096 * v) if abs(v) < 2**53 else int(v) * 4096 for v in r[1]] for r in kept]
    width = len(x[0]) // parts
    seeds = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))[:entries]
    part = lambda i, p: x[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in seeds] for p in range(parts)]

    def assign():
        out = []
        for i in range(len(x)):
            row = [min((sum((a - b) ** 2 for a, b in zip(part(i, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(([k for _, k in row], sum(d for d, _ in row)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(seeds)):
                mine = [part(i, p) for i, (c, _) in enumerate(found) if c[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0], bytes(c), e) for r, (c, e) in zip(kept, assign(), strict=True)), digest


def compressed(spark, rows, schema="vec_id long, embedding array<double>, label int", **options):
    found, books = codes.compress(spark.createDataFrame(rows, schema), **options)
    return sorted((r["vec_id"] is None, r["vec_id"], bytes(r["codes"]), r["error"]) for r in found.collect()), codes.books_digest(books)


def test_codes_are_brute_force(spark):
    rng = random.Random(9)
    rows = [(i * 7 % 200, [rng.gauss(0, 1) for _ in range(16)], i % 3) for i in range(200)]
    rows += [(300 + i, [rng.choice([0.0, 0.25, -0.25]) for _ in range(16)], None) for i in range(150)]  # many ties
    assert compressed(spark, rows) == brute_codes(rows)


def test_codes_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [1.0] * 7 + [None], 1), (3, [nan] * 8, 1), (4, [inf] * 8, None), (5, [], 2), (6, [0.5] * 8, None), (None, [-0.5] * 8, 1), (8, [1e300] + [0.0] * 7, 2), (9, [-1e200] * 8, 2), (6 + 4, [0.1] * 8, 2)]
    got, digest = compressed(spark, rows)
    want, want_digest = brute_codes(rows)
    assert digest == want_digest
    assert got == [(n, i, c, e if e < 1 << 63 else None) for n, i, c, e in want]
    twice = [(1, [0.5] * 8, 1)] * 3 + [(2, [0.1] * 8, 1)]
    assert compressed(spark, twice)[0] == brute_codes(twice)[0]
    assert compressed(spark, rows[:5]) == ([], hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="multiple of 8"):
        compressed(spark, [(1, [1.0] * 9, 1)])
    with pytest.raises(ValueError, match="one length"):
        compressed(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_exponion_is_the_full_search(data):
    book = np.array(data.draw(st.lists(st.tuples(*[st.integers(-4, 4)] * 2), min_size=1, max_size=9)))
    x = np.array(data.draw(st.lists(st.tuples(*[st.integers(-5, 5)] * 2), min_size=1, max_size=20)))
    start = np.array(data.draw(st.lists(st.integers(0, len(book) - 1), min_size=len(x), max_size=len(x))))
    code, distance = codes.nearest(x, book, start)
    full = ((x[:, None] - book[None]) ** 2).sum(-1)
    assert (code == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_codes_query(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, digest = brute_codes(rows)
    got = codes.op13_vector_code_compression(spark, "/root/testdata/sf0.001").collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == {(i, c.hex(), e) for _, i, c, e in want} and len(got) == len(rows)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    label = {r[0]: r[2] for r in rows}
    sums = Counter()
    for r in got:
        sums[label[r["vec_id"]]] += r["error"]
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in got)


def test_codes_decode(spark):
    rows = [(i, [i / 10] * 8, 1) for i in range(12)]
    found, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    for r in codes.decoded(found, books).collect():
        assert max(abs(v - r["vec_id"] / 10) for v in r["decoded"]) < 1e-3
