r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

1. Seeds: fixed patterns for e-mail addresses, IP addresses, payment cards and phone
   numbers, with their checks.  The searches use possessive quantifiers and start where a run
   starts, which changes no match and keeps them linear in the text's length.
2. Candidates: seeds, runs of adjacent number-like words (`(743) 555 38 24` is one), and other words with a digit or
   one of `@`, `_` and `#`.  A word of plain letters is never a candidate.
3. Every candidate stands in two lexical patterns: the two words before it, and the words
   on both sides, of any length.  Seeds induce patterns; what else stands in these is connected to them.
4. The pattern-instance graph joins patterns to values, wherever a value stands.  Round by round, a pattern's
   confidence is the score of what stands in it against that and UNKNOWN for each place of any other value, if at least
   MIN_SUPPORT different values there are known;
   an unseen value's score is the noisy-or of its confident patterns, times its places in one against these and UNKNOWN for each
   other place.  What
   reaches MIN_SCORE is known from the next round on, and induces patterns itself.
   Rounds end when nothing new is found.
5. All places of values found so are new spans of kind `context`, without quotes, brackets and stops around them.

A hot pattern is aggregated with map-side combine; the graph has one row for each pattern and value.  Offsets are sums of the
lengths of matches and of the gaps between them, so the cost of a text is linear in it.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive;
repeated rows get repeated results; ids may repeat or be null (rows are told apart
by id and text); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spans, _spark
from ._spans import SPAN

# The searched patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "context")

# Characters of private use that stand for the first character of a seed and for blanks inside it, so that a seed is one word.
SEED, BLANK = "\ue000", "\ue001"
_NUMBER = "[0-9][0-9().+/-]*+"
_BLANK, _SOLID = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
_TELLING, _PLAIN = f"[0-9@_#{SEED}]", rf"[^0-9@_#{SEED}\x20\x09-\x0D]"
#: Words without a telling character, and blanks; then a candidate.  It goes on where the last match ended, so no place is tried twice.
CANDIDATE = rf"\G((?:{_PLAIN}++(?!{_SOLID})|{_BLANK}++)*+)([(+]?{_NUMBER}(?:\x20[(]?{_NUMBER})*+[\"',;:!?\]}}>]*+(?!{_SOLID})|{_PLAIN}*+{_TELLING}{_SOLID}*+)"
#: Not part of a value at its ends.
OPENING, CLOSING = "\"'([{<", "\"'.,;:!?)]}>"

MIN_SUPPORT = 3
#: How much the place of a value that is not known counts against a pattern.
UNKNOWN = 0.25
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.75


def digits_of(found: Column) -> Column:
    return F.translate(found, "+ ().-", "")


def is_ip(found: Column) -> Column:
    return found.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def is_card(found: Column) -> Column:
    return F.length(digits_of(found)).between(16, 19) & F.call_function("luhn_check", digits_of(found))


def is_phone(found: Column) -> Column:
    return F.length(digits_of(found)).between(8, 15)


def kinds(text: Column) -> list[tuple[str, str, object, Column]]:
    """(kind, pattern, check of a match, guard) of the seeds.  The guards only skip searches that cannot match."""
    return [
        ("email", EMAIL, None, F.contains(text, F.lit("@"))), ("ip", IP, is_ip, text.rlike(r"[0-9]\.[0-9]")),
        ("card", CARD, is_card, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), ("phone", PHONE, is_phone, F.contains(text, F.lit("+"))),
    ]


def base_spans(text: Column) -> Column:
    """The seeds of a text, by kind as listed, then start."""
    return F.concat(*(_spans.spans(text, kind, pattern, good, guard) for kind, pattern, good, guard in kinds(text)))


def hidden(found: Column) -> Column:
    """A seed as one word of its length that begins with SEED."""
    return F.concat(F.lit(SEED), F.translate(F.substring(found, F.lit(2), F.length(found)), "\x20", BLANK))


def _hider(good):
    return hidden if good is None else lambda found: F.when(good(found), hidden(found)).otherwise(found)


def mask(texts: DataFrame, name: str) -> DataFrame:
    """Hides the seeds in a text column, kind after kind; of overlapping seeds the first kind listed stays."""
    for k in range(len(KINDS) - 1):
        _, pattern, good, guard = kinds(F.col(name))[k]
        whole = _spans.replaced(F.col(name), pattern, _hider(good))
        texts = texts.withColumn(name, F.when(guard, whole).otherwise(F.col(name)))
    return texts


BLANKS = " \t\n\x0b\x0c\r"
#: Characters next to a place that are looked at first; where they do not hold whole words, all are.
NEAR = 120
LETTER = r"\p{L}"


def lexical_patterns(gap: Column, following: Column) -> Column:
    """Patterns of a place from the text up to the candidate before it and up to the one after it: the two words before it, and the words on both sides, in lower case.

    Words without a letter (bars and dashes of a table) say nothing about what stands there: a pattern has a letter.
    """
    end, begin = F.substring(gap, -NEAR, NEAR), F.substring(following, 1, NEAR)
    front = F.when(end.rlike(f"{_BLANK}{_SOLID}+{_BLANK}+{_SOLID}"), end).otherwise(gap)  # the last two words begin in it
    back = F.when(begin.rlike(f"{_SOLID}{_BLANK}"), begin).otherwise(following)  # the first word ends in it
    words = lambda t, n: F.split(F.lower(F.trim(t, F.lit(BLANKS))), f"{_BLANK}+", n)

    def patterns(w: Column) -> Column:
        last, before, after = F.element_at(w["front"], -1), F.try_element_at(w["front"], F.lit(-2)), w["back"][0]
        worded = lambda x, y: (x != "") & (y != "") & F.concat(x, y).rlike(LETTER)
        left, both = F.concat(F.lit("L "), before, F.lit(" "), last), F.concat(F.lit("B "), last, F.lit(" _ "), after)
        return F.array_compact(F.array(F.when(worded(before, last), left), F.when(worded(last, after), both)))

    return _spans.let(F.struct(words(front, -1).alias("front"), words(back, 2).alias("back")), patterns)


def places(text: Column) -> Column:
    """The candidates of a masked text: seed, start, end, value, patterns."""
    any_ = text.rlike(f"[0-9@_#{SEED}]")

    def place(x: Column) -> Column:
        whole = F.rtrim(x["found"], F.lit(CLOSING))
        value = F.when(F.contains(whole, F.lit(")")), F.ltrim(whole, F.lit(OPENING.replace("(", "")))).otherwise(F.ltrim(whole, F.lit(OPENING)))
        start = (x["start"] + F.length(whole) - F.length(value)).cast("int")
        return F.struct(F.contains(x["found"], F.lit(SEED)).alias("seed"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), lexical_patterns(x["gap"], x["next"]).alias("patterns"))

    found = F.filter(F.transform(_spans.matches(text, CANDIDATE, "$1 $2"), place), lambda p: (F.size(p["patterns"]) > 0) & (p["value"] != ""))
    return F.when(any_, found).otherwise(F.slice(found, 1, 0))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, version (of the text), seeds, and `places`: every candidate with its patterns."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("version"))
    own = F.contains("text", F.lit(SEED)) | F.contains("text", F.lit(BLANK))  # a text's own are no seeds
    free = F.when(own, F.translate("text", SEED + BLANK, "\ufffd\ufffd")).otherwise(F.col("text"))
    seen = mask(plain.withColumn("seeds", base_spans(F.col("text"))).withColumn("text", free), "text")
    return seen.select("doc_id", "version", "seeds", places(F.col("text")).alias("places"))


def discover(scanned: DataFrame) -> DataFrame:
    """value of the unseen identifiers, by scoring the graph of patterns and values until nothing new is found."""
    place = scanned.select("doc_id", "version", F.explode("places").alias("p")).distinct().select("p.value", "p.seed", "p.patterns")
    edges = place.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = _spark.cut(edges, "pii-edges")
    held = _spark.cut(place.groupBy("value").agg(F.count("*").alias("places"), F.max("seed").alias("seed")), "pii-values")
    known = held.where("seed").select("value", F.lit(1.0).alias("score"))
    # how much stands in a pattern stays the same: summed once, in each task first
    totals = _spark.cut(edges.groupBy("pattern").agg(F.sum("n").alias("all")), "pii-totals")
    while True:
        # patterns in which enough different values are known, then all that stands in these
        taught = edges.join(known, "value").groupBy("pattern").agg(F.count("*").alias("known"), F.sum(F.col("n") * F.col("score")).alias("sum"), F.sum("n").alias("of")).where(F.col("known") >= MIN_SUPPORT)
        confidence = F.col("sum") / (F.col("sum") + UNKNOWN * (F.col("all") - F.col("of")))
        sure = taught.join(totals, "pattern").select("pattern", confidence.alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)
        met = edges.where("NOT seed").join(sure, "pattern")
        # a place has up to two patterns, so a value's places in sure ones are at least those of its most frequent one
        rated = met.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("any"), F.max("n").alias("sure"))
        score = F.col("any") * F.col("sure") / (F.col("sure") + UNKNOWN * (F.col("places") - F.col("sure")))
        new = rated.join(held.drop("seed"), "value").select("value", score.alias("score")).where(F.col("score") >= MIN_SCORE).join(known.select("value"), "value", "left_anti")
        new = _spark.cut(new, "pii-new")
        if new.isEmpty():
            return known.join(held.where("NOT seed").select("value"), "value", "left_semi").select("value")
        known = known.unionByName(new)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end, found) by kind as listed, then start."""
    scanned = _spark.cut(scan(docs), "pii-scan")
    unseen = discover(scanned).withColumnRenamed("value", "_value")
    place = scanned.select("doc_id", "version", F.explode("places").alias("p")).where("NOT p.seed").distinct()
    found = place.join(unseen, F.col("p.value") == F.col("_value"))
    new = found.groupBy(F.col("doc_id").alias("_doc_id"), F.col("version").alias("_version")).agg(F.sort_array(F.collect_list(F.struct("p.start", "p.end", "p.value"))).alias("_new"))
    out = scanned.join(new, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("version") == F.col("_version")), "left")
    more = F.transform(F.coalesce("_new", F.array().cast("array<struct<start: int, end: int, value: string>>")), lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("found")))
    return out.select("doc_id", F.concat("seeds", more.cast(SPAN)).alias("spans"))


def op3_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(_spark.table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(_spark.joined_spans(base), 256).alias("base_sha256"), _spark.joined_spans(F.col("spans")).alias("spans"), of("context").alias("n_context"))
