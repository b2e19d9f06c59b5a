"""Line dedup with a fixed-depth log-template tree.

A line descends a tree of fixed depth.  The first level is its number of words, the next LEADING levels are
its leading words, and the leaf holds the rest.  Words with digits are variable fields (`<*>`) everywhere.
A node has a child for each word and one for `<*>`; the branches that a line takes
are fixed (BRANCHES), so no order of lines and no state of a leaf matters, and nothing is gathered anywhere:

* all leading words literal, and in the leaf: nothing more generalised; the first, the
  middle or the last half of the rest; every other word of the rest, from its first or second;
* the first word `<*>`, or all LEADING words `<*>`, and the rest literal.

What a line has at the end of a branch is a template: a hash of the level path and the literal words with their
places, counted with map-side combine.  So lines share a template if their variable words are adjacent and no more than a
quarter of the rest, are all at places of one parity, or are leading words.  A template counts only if at least MIN_LITERALS
words and half of all words are literal.

A template recurs when it occurs in `min_docs` or more different texts; equal texts count once, so
copies do not make their own lines recur.  Lines of recurring templates are dropped from
every document but those with the template's smallest id.

With `exact`, as in the query and the pipeline, the line itself (its words in lower case, digits as they are) counts
as well, whatever its length: it recurs in LONG_DOCS texts from LONG_WORDS words on and in SHORT_DOCS below that.

Texts are read twice: to count templates, and to list the lines of those that recur, which a Bloom filter picks inside the
scan (a join decides).  Only documents that lose lines are shuffled.

Defined cases: a null text stays null and an empty one empty; a document whose lines all
go keeps an empty text; blank lines stay; rows that repeat id and text count once; texts that share an id are
told apart, each loses its own lines; null ids are kept and never dropped from; an empty table gives an empty
result; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bloom, _spark, _text

LEADING = 3
MIN_LITERALS = 4
MIN_DOCS = 20
#: Texts in which a line without anything generalised recurs.
LONG_WORDS = 8
LONG_DOCS = 2
SHORT_DOCS = 5

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_FIELD = np.uint64(0x2545F4914F6CDD1D)
#: The two low bits of a template's hash tell what it is.
_TEMPLATE, _LONG, _SHORT = range(3)

#: Where a branch generalises, from a word's place in its line, its place in the rest (negative in front of it) and the length of the rest.
BRANCHES = {
    "as parsed": lambda place, rest, m, leading: np.zeros(len(place), bool),
    "first half": lambda place, rest, m, leading: (rest >= 0) & (2 * rest < m),
    "middle half": lambda place, rest, m, leading: (rest >= 0) & (4 * rest >= m) & (4 * rest < 3 * m),
    "last half": lambda place, rest, m, leading: (rest >= 0) & (2 * rest >= m),
    "even": lambda place, rest, m, leading: (rest >= 0) & (rest % 2 == 0),
    "odd": lambda place, rest, m, leading: (rest >= 0) & (rest % 2 == 1),
    "first word": lambda place, rest, m, leading: place == 0,
    "leading words": lambda place, rest, m, leading: place < leading,
}


def line_templates(chunk: _text.Words, leading: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the chunk, line of the document, hash) of the templates of every line and, with exact, of the line itself."""
    plain = chunk.hashes(lower=True)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[chunk.data])])
    field = digits[chunk.end] > digits[chunk.start]
    breaks = np.flatnonzero(chunk.data == 10)
    doc = np.repeat(np.arange(len(chunk.bounds) - 1), np.diff(chunk.bounds))
    line = np.searchsorted(breaks, chunk.start) - np.searchsorted(breaks, chunk.text_bounds[:-1])[doc]
    begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])])) if len(doc) else np.empty(0, np.int64)
    size = np.diff(np.append(begins, len(doc)))
    place = np.arange(len(doc)) - np.repeat(begins, size)
    rest, m = place - leading, np.repeat(size, size) - leading
    at = place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def per_line(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
        return sums[begins + size] - sums[begins]

    def hashed(term: np.ndarray, kind: int, low: np.ndarray) -> np.ndarray:
        whole = _text.mix(per_line(term) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind))
        return whole & ~np.uint64(3) | low.astype(np.uint64)

    own, star = _text.mix(plain + at), _text.mix(_FIELD + at)
    out = []
    for kind, wild in enumerate(BRANCHES.values()):
        general = field | wild(place, rest, m, leading)
        literals = per_line((~general).astype(np.int64))
        counts = (literals >= MIN_LITERALS) & (2 * literals >= size)
        if kind:  # a branch that generalises nothing more is the first one again
            counts &= per_line((general & ~field).astype(np.int64)) > 0
        out.append((counts, hashed(np.where(general, star, own), kind, np.full(len(size), _TEMPLATE))))
    if exact:
        out.append((size > 0, hashed(own, len(BRANCHES), np.where(size >= LONG_WORDS, _LONG, _SHORT))))
    return tuple(np.concatenate([x[chosen] for chosen, x in parts]) for parts in ([(c, doc[begins]) for c, _ in out], [(c, line[begins]) for c, _ in out], out))


def template_rows(docs: DataFrame, leading: int, exact: bool, only: _bloom.IdFilter | None = None) -> DataFrame:
    """doc_id, version (of the text), template, lines: the lines of a document with each of its templates, or with those that may be in `only`."""
    shared, bits = (only.shared, only.bits) if only and only.shared else (None, 0)

    def run(batches):
        for b in batches:
            ids, versions = b.column(0), b.column(2)
            for c in _text.word_chunks(b.column(1)):
                d, n, flat = line_templates(c, leading, exact)
                if shared:
                    may = _bloom.has(shared.value, flat, bits)
                    d, n, flat = d[may], n[may], flat[may]
                if not len(d):
                    continue
                order = np.lexsort((n, flat, d))
                flat, d, n = flat[order], d[order], n[order]
                new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (flat[1:] != flat[:-1])]))
                at = pa.array(c.first + d[new])
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(d)).astype(np.int32)), pa.array(n.astype(np.int32)))
                yield pa.record_batch([ids.take(at), versions.take(at), pa.array(_text.signed(flat[new])), lists], names=["doc_id", "version", "template", "lines"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(run, "doc_id long, version long, template long, lines array<int>")


def recurring_templates(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, exact: bool = False) -> DataFrame:
    """template, docs (different texts that have it) and keeper (their smallest id) of the templates that recur."""
    rows = template_rows(docs.where("doc_id IS NOT NULL"), leading, exact)
    texts = rows.groupBy("template", "version").agg(F.min("doc_id").alias("keeper"))
    counted = texts.groupBy("template").agg(F.count("*").alias("docs"), F.min("keeper").alias("keeper"))
    low = F.col("template").bitwiseAND(3)
    least = F.when(low == _LONG, LONG_DOCS).when(low == _SHORT, SHORT_DOCS).otherwise(min_docs)
    return counted.where(F.col("docs") >= least)


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, exact: bool = False) -> DataFrame:
    """doc_id, version and `drop`, the sorted numbers (from 0) of the text's lines that go; only texts that lose any."""
    recurring = _spark.cut(recurring_templates(docs, min_docs, leading, exact), "line-templates")
    rows = template_rows(docs.where("doc_id IS NOT NULL"), leading, exact, _bloom.IdFilter(recurring.select("template"), hashed=True))
    gone = rows.join(recurring, "template").where("doc_id > keeper").select("doc_id", "version", "lines")
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("drop"))


@F.pandas_udf(T.StringType())
def without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines of the given numbers."""
    return pd.Series(["\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop) for t, drop in zip(texts, map(set, gone), strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leading: int = LEADING, count_as: str | None = None, exact: bool = False) -> DataFrame:
    """All columns of docs, the text without its dropped lines, and their number if `count_as` names a column for it."""
    drop = _spark.cut(dropped_lines(docs, min_docs, leading, exact), "line-drops")
    losing = _bloom.IdFilter(drop.select("doc_id").distinct())
    gone = drop.select(F.struct("doc_id", "version", "drop").alias("gone"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"))
    may = _bloom.may_have(losing, F.col("kept.doc_id"))
    # a list of line numbers is far larger in memory than its file, so Spark's own choice may broadcast too much
    same = (F.col("kept.doc_id") == F.col("lost.gone.doc_id")) & (F.xxhash64("kept.text") == F.col("lost.gone.version"))
    met = whole.where(may).join(gone.alias("lost").hint("merge"), same, "left")
    numbers = F.col("lost.gone.drop")
    cut = met.where(numbers.isNotNull()).select("kept", without_lines("kept.text", numbers).alias("new"), F.size(numbers).cast("long").alias("n"))
    rest = met.where(numbers.isNull()).select("kept").unionByName(whole.where(~may)).select("kept", F.col("kept.text").alias("new"), F.lit(0).cast("long").alias("n"))
    count = [F.col("n").alias(count_as)] if count_as else []
    return cut.unionByName(rest).select(*(F.col("new").alias("text") if c == "text" else F.col(f"kept.`{c}`") for c in docs.columns), *count)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, count_as="n_dropped", exact=True)
    return out.select("doc_id", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_kept"))
