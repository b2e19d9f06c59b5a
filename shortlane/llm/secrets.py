r"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs around each assignment
operator (`=`, `:`, `:=`, `=>`, `+=`; comparisons are other tokens): shell and .env lines, JSON and YAML keys,
keyword arguments, subscripts (`keys["prod"] = ...`), annotated names (`pwd: str = ...`), chains (`a = b = ...`),
and elements (`<password>...</password>`).  Quoted literals may hold escaped quotes.

A right side that is the name of another pair is a reference, and constants are propagated along references until nothing
changes: a name stands for the literal last assigned before, or else for the first one after.
A literal's score is the sensitivity of the names it reaches, weighted by how random it looks; from
`min_score` on it is a span of kind `named`.

The base kinds are searched with fixed patterns in column functions and always kept:
assign, access and hex, leftmost and non-overlapping for each kind, matches that are too
short dropped after they were found.  Only texts with an operator or a closing element go through Python.

Defined cases: a null or empty text has no spans; offsets are code points, end exclusive;
repeated rows give repeated results; ids may repeat or be null; an empty table gives an empty result; other columns are
ignored.  Texts are scanned whole; lexing looks only around operators, back and forward over blanks, names, subscripts and
literals of any length within a line.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spans, _spark

# The base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "named")

# How sensitive a part of a name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.7, "auth": 0.6, "access": 0.4, "key": 0.5, "api": 0.3,
    "bearer": 0.8, "signing": 0.5, "encryption": 0.5, "session": 0.3, "cookie": 0.4, "salt": 0.6, "pin": 0.4,
}
MIN_SCORE = 0.6

_OPERATOR = re.compile(r"[=!]==?|[<>~]=|::|->|:=|=>|\+=|[=:]")
_ASSIGNS = frozenset((":=", "=>", "+=", "=", ":"))
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_INDEX_CHARS = _NAME_CHARS | frozenset("\"' ")
_NAME_START = re.compile("[A-Za-z_]")
_VALUE = re.compile(r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)++)"|'((?:[^'\\\n]|\\.)++)'|([A-Za-z0-9+/_.=-]++))""")
_TYPE = re.compile(r"[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\], |]*+\Z")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)>([^<>\n]++)</\1>")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def sensitivity(name: str) -> float:
    """Noisy-or of the sensitive parts of a snake_case, kebab-case or camelCase name."""
    parts = [p.lower() for p in _PART.findall(name)]
    miss = 1.0
    for p in {*parts, *(a + b for a, b in zip(parts, parts[1:]))}:
        miss *= 1.0 - SENSITIVE.get(p, 0.0)
    return 1.0 - miss


def randomness(literal: str) -> float:
    """0 to 1: entropy per character against 4 bits, times how many character classes meet."""
    if len(literal) < 6:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal))))
    return min(1.0, entropy / 4.0) * (1.0 if classes > 1 else 0.6)


def name_before(text: str, at: int) -> str | None:
    """The name that ends before a place, after blanks, subscripts and a quote.

    None of these holds operators, so all walks of a text are linear in it.
    """
    while at and text[at - 1] in " \t":
        at -= 1
    index = ""
    while at and text[at - 1] == "]":
        end = at = at - 1
        while at and text[at - 1] in _INDEX_CHARS:
            at -= 1
        if not at or text[at - 1] != "[":
            return None
        index, at = f".{text[at:end].strip(chr(34) + chr(39) + ' ')}{index}", at - 1
    if at and text[at - 1] in "\"'":
        at -= 1
    begin = at
    while begin and text[begin - 1] in _NAME_CHARS:
        begin -= 1
    first = _NAME_START.search(text, begin, at)
    return text[first.start() : at] + index if first else None


class Pair:
    """A name and what is assigned to it: (literal, start, end), or a reference to another name until it is resolved."""

    __slots__ = ("name", "ref", "value")

    def __init__(self, name: str, value: tuple[str, int, int], ref: str | None):
        self.name, self.value, self.ref = name, value, ref


def lexed(text: str) -> list[Pair]:
    """The pairs of a text in order, references not yet resolved."""
    out: list[Pair] = []
    colon = None  # the last `name:`, its end and how many pairs were in front
    for op in _OPERATOR.finditer(text):
        if op[0] not in _ASSIGNS:
            continue
        name = name_before(text, op.start())
        if op[0] == "=" and colon and _TYPE.match(text, colon[1], op.start()):
            name = colon[0]  # what stood after the colon was a type
            del out[colon[2] :]
        colon = (name, op.end(), len(out)) if op[0] == ":" and name else None
        value = name and _VALUE.match(text, op.end())
        if value:
            group = value.lastindex
            bare = group == 3 and _NAME.match(value[group])
            out.append(Pair(name, (value[group], value.start(group), value.end(group)), value[group] if bare else None))
    if "</" in text:
        out += [Pair(m[1], (m[2], m.start(2), m.end(2)), None) for m in _ELEMENT.finditer(text)]
        out.sort(key=lambda p: p.value[1])
    return out


def pairs(text: str) -> list[tuple[str, str, int, int]]:
    """(name, literal, start, end) of the assignments of a text, constants propagated, in order."""
    found = lexed(text)
    names = {p.name for p in found}
    for p in found:
        if p.ref is not None and (p.ref not in names or p.ref == p.name):
            p.ref = None  # a bare word that no pair names is a literal
    now: dict[str, tuple[str, int, int]] = {}
    for p in found:  # what was assigned before
        if p.ref is not None and p.ref in now:
            p.value, p.ref = now[p.ref], None
        if p.ref is None:
            now[p.name] = p.value
        else:
            now.pop(p.name, None)
    first: dict[str, tuple[str, int, int]] = {}
    waiting: dict[str, list[Pair]] = {}
    for p in found:
        if p.ref is None:
            first.setdefault(p.name, p.value)
        else:
            waiting.setdefault(p.ref, []).append(p)
    ready = [n for n in waiting if n in first]
    while ready:  # else what is assigned later, along references to a fixed point
        name = ready.pop()
        for p in waiting.pop(name, []):
            p.value, p.ref = first[name], None
            if p.name not in first:
                first[p.name] = p.value
                ready += [p.name] if p.name in waiting else []
    return [(p.name, *p.value) for p in found if p.ref is None]


def named(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the literals of a text that reach a sensitive name and look random."""
    if not text:
        return []
    return sorted({(s, e) for name, literal, s, e in pairs(text) if (w := sensitivity(name)) and w * randomness(literal) >= MIN_SCORE})


def base_spans(text: Column) -> list[Column]:
    """The spans of each base kind."""
    value = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= MIN_ASSIGN
    return [
        _spans.spans(text, "assign", ASSIGN, value, text.rlike("(?i)passw|secret|token|api_?key")),
        _spans.spans(text, "access", ACCESS, lambda found: F.length(found) >= MIN_ACCESS, F.contains(text, F.lit("AKIA"))),
        # no shorter run can be one
        _spans.spans(text, "hex", f"[0-9a-f]{{{MIN_HEX},}}+", None, text.rlike(f"[0-9a-f]{{{MIN_HEX}}}")),
    ]


def _lex(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(s, e, t[s:e]) for s, e in named(t)])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end, literal text) by start, then kind as listed."""
    text = F.coalesce("text", F.lit(""))
    lex = F.pandas_udf(_lex, "array<struct<start: int, end: int, found: string>>")
    lexed_ = lex(F.when(text.rlike("[=:]|</"), text))
    plain = docs.select("doc_id", text.alias("text"), lexed_.alias("named"))
    kinds = [*base_spans(F.col("text")), F.transform("named", lambda s: F.struct(F.lit("named").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))).cast(_spans.SPAN)]
    placed = F.concat(*(F.transform(c, lambda s, k=k: F.struct(s["start"].alias("start"), F.lit(k).alias("place"), s.alias("span"))) for k, c in enumerate(kinds)))
    return plain.select("doc_id", F.transform(F.array_sort(placed), lambda x: x["span"]).alias("spans"))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(_spark.table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_spark.joined_spans(base), 256).alias("base_sha256"), _spark.joined_spans(F.col("spans")).alias("spans"), of("named").alias("n_named"),
    )
