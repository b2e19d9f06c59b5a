"""Substring dedup by repeated-phrase automata.

A window is `window` consecutive words.  A window repeats if its word sequence starts
anywhere else, in the same document or another.

1. Anchors.  The smallest-hash `gram`-word run inside a window depends on the window's
   words alone, so equal windows have equal anchors.  Consecutive windows mostly share
   one: a document has about 2/(window - gram + 2) anchors a word.  Each anchor and the
   stretch of text that its windows cover is one row; rows are counted by (anchor,
   stretch) with map-side combine, so a passage in a third of all documents is one row a task.
2. Confirmation.  An anchor seen once has no repeated window and goes first.  If all its occurrences have
   the same stretch, all their windows repeat.  Otherwise the distinct stretches
   are read from one document each and their windows counted by hash.
3. Automata.  Runs of confirmed windows become phrases, each read from one document, its holder.  Phrases are
   sharded by holder, so what one document repeats stays together, into shards of SHARD_BYTES; each
   shard's phrases are compiled into an Aho-Corasick automaton over words, and every document that has an anchor of a shard
   is streamed through it, which locates every occurrence.  A shard that more than DOC_BYTES of documents call is
   salted: its phrases are compiled once for each such part.  The words covered are removed.

Nothing is sent to the driver and nothing is capped.  What one task holds at once is a shard and a part of its
documents, or one document.

Defined cases: a null or blank text has no words and keeps none; texts shorter than a
window are kept whole; exact copies remove each other's windows entirely; repeated rows count as
separate documents (results are per row id, and rows of one id are one occurrence each); null ids are
documents like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bloom, _spark, _text

WINDOW = 35
GRAM = 6
#: Text of the phrases of a shard, and of the documents that one automaton streams; a single holder or document may have more.
SHARD_BYTES = 1 << 18
DOC_BYTES = 1 << 21


class Anchors(NamedTuple):
    """The anchors of the documents of a chunk, in order; word positions count from the chunk's first word."""

    doc: np.ndarray
    anchor: np.ndarray
    stretch: np.ndarray
    first: np.ndarray  # first window
    last: np.ndarray  # last window + 1


def anchors_of(chunk: _text.Words, hashes: np.ndarray, window: int, gram: int) -> Anchors:
    """Runs of windows that share an anchor: the leftmost smallest gram inside each window."""
    none = np.empty(0, np.int64)
    grams, span = _text.windows(hashes, gram), window - gram + 1
    starts = np.arange(max(len(hashes) - window + 1, 0))
    doc = np.searchsorted(chunk.bounds, starts, side="right") - 1
    whole = starts + window <= chunk.bounds[doc + 1] if len(starts) else np.empty(0, bool)
    if not whole.any():
        return Anchors(none, none.view(np.uint64), none.view(np.uint64), none, none)
    at, width = np.arange(len(grams)), 1
    while 2 * width <= span:  # leftmost smallest of 1, 2, 4, ... grams from each
        left, right = at[: len(at) - width], at[width:]
        at = np.where(grams[right] < grams[left], right, left)
        width *= 2
    left, right = at[: len(starts)], at[span - width : span - width + len(starts)]
    at = np.where(grams[right] < grams[left], right, left)[whole]
    starts, doc = starts[whole], doc[whole]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1] + 1
    end = last + window - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _text.powers(len(hashes)))])
    scale = _text.powers(len(hashes), inverse=True)[first]
    stretch = _text.mix((sums[end] - sums[first]) * scale + (end - first).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return Anchors(doc[new], grams[at[new]], stretch, first, last)


def anchor_rows(docs: DataFrame, window: int, gram: int, only: _bloom.IdFilter | None = None) -> DataFrame:
    """anchor, stretch, doc_id and bytes (of the text): a row for each anchor of each document, or for those that may be in `only`."""
    shared, bits = (only.shared, only.bits) if only and only.shared else (None, 0)

    def run(batches):
        for b in batches:
            for c in _text.word_chunks(b.column(1)):
                x = anchors_of(c, c.hashes(), window, gram)
                may = _bloom.has(shared.value, x.anchor, bits) if shared else np.ones(len(x.doc), bool)
                if may.any():
                    at = pa.array(c.first + x.doc[may])
                    size = pa.array(np.diff(c.text_bounds)[x.doc[may]])
                    yield pa.record_batch([pa.array(_text.signed(x.anchor[may])), pa.array(_text.signed(x.stretch[may])), b.column(0).take(at), size], names=["anchor", "stretch", "doc_id", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "anchor long, stretch long, doc_id long, bytes long")


def read_stretches(wanted: DataFrame, docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Adds to anchor, stretch, n, many, holder the stretch's words (one space between) and, where `many`, its windows' hashes."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("anchor", "stretch", "n", "many", "holder", "phrase", "windows")}
            lists = b.column(1)
            for c in _text.word_chunks(b.column(0)):
                hashes = c.hashes()
                x, raw = anchors_of(c, hashes, window, gram), c.data.tobytes()
                pairs = zip(_text.signed(x.anchor).tolist(), _text.signed(x.stretch).tolist(), strict=True)
                calls: list[dict] = [{} for _ in range(len(c.bounds) - 1)]
                for k in range(len(calls)):
                    calls[k] = {(w["anchor"], w["stretch"]): w for w in lists[c.first + k].as_py()}
                for k, key, lo, hi in zip(x.doc.tolist(), pairs, x.first.tolist(), x.last.tolist(), strict=True):
                    if not (w := calls[k].pop(key, None)):
                        continue
                    hi += window - 1
                    out["phrase"].append(b" ".join(raw[c.start[lo] : c.end[hi - 1]].split()).decode())
                    out["windows"].append(_text.signed(_text.windows(hashes[lo:hi], window)) if w["many"] else None)
                    for name in ("anchor", "stretch", "n", "many", "holder"):
                        out[name].append(w[name])
            yield pa.record_batch([*(pa.array(out[k], pa.int64()) for k in ("anchor", "stretch", "n")), pa.array(out["many"], pa.bool_()), pa.array(out["holder"], pa.int64()), pa.array(out["phrase"], pa.string()), pa.array(out["windows"], pa.list_(pa.int64()))], names=list(out))

    per_doc = wanted.groupBy("holder").agg(F.collect_list(F.struct("anchor", "stretch", "n", "many", "holder")).alias("wanted"))
    met = docs.select("doc_id", "text").join(per_doc, F.col("doc_id") == F.col("holder")).select("text", "wanted")
    return met.mapInArrow(run, "anchor long, stretch long, n long, many boolean, holder long, phrase string, windows array<long>")


def recurring_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchor rows whose anchor occurs more than once, and a few others.

    The scan is made twice rather than kept: its rows are most of the input.  The second picks rows by a Bloom filter of
    the anchors counted in the first, so no row is shuffled for it, however many share an anchor.
    """
    counts = anchor_rows(docs, window, gram).groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1").select("anchor")
    counts = _spark.cut(counts, "sub-counts")
    return anchor_rows(docs, window, gram, _bloom.IdFilter(counts, hashed=True))


def phrases(occurrences: DataFrame, docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, stretch, holder, phrases: the recurring passages, as maximal runs of confirmed windows of each distinct stretch."""
    distinct = _spark.cut(occurrences.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min("doc_id").alias("holder")), "sub-distinct")
    # an anchor seen once repeats nothing
    stretches = distinct.groupBy("anchor").agg(F.count("*").alias("_k"), F.sum("n").alias("_all")).where("_all > 1").drop("_all")
    stretches = _spark.cut(stretches, "sub-many")  # an anchor may have many stretches: from files, either side can be split
    wanted = _spark.cut(distinct.join(stretches.hint("merge"), "anchor").select("anchor", "stretch", "n", (F.col("_k") > 1).alias("many"), "holder"), "sub-wanted")
    holders = _bloom.pick(docs, _bloom.IdFilter(wanted.select("holder").distinct()))
    read = _spark.cut(read_stretches(wanted, holders, window, gram), "sub-stretches")
    whole = read.where("NOT many").select("anchor", "stretch", "holder", F.array("phrase").alias("phrases"))
    each = read.where("many").select("anchor", "stretch", "n", F.posexplode("windows").alias("k", "window"))
    # a window inside a stretch that itself occurs twice repeats there already; n counts for the others
    seen = each.groupBy("window").agg(F.sum("n").alias("_seen")).where("_seen > 1")
    confirmed = each.join(seen, "window").groupBy("anchor", "stretch").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    joined = read.where("many").select("anchor", "stretch", "holder", "phrase").join(confirmed, ["anchor", "stretch"])

    def runs(batches):
        for b in batches:
            out = []
            for text, ks in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                words, ks = text.split(" "), np.array(ks)
                cuts = np.flatnonzero(np.diff(ks) > 1) + 1
                out.append([" ".join(words[r[0] : r[-1] + window]) for r in np.split(ks, cuts)])
            yield pa.record_batch([*(b.column(k) for k in range(3)), pa.array(out, pa.list_(pa.string()))], names=["anchor", "stretch", "holder", "phrases"])

    return whole.unionByName(joined.select("anchor", "stretch", "holder", "phrase", "ks").mapInArrow(runs, "anchor long, stretch long, holder long, phrases array<string>"))


def locate(key: tuple, documents: pa.Table, shard: pa.Table) -> pa.Table:
    """doc_id, starts and ends of the runs of words that occurrences of the shard's phrases cover in each document.

    The automaton's letters are words, numbered within the shard.
    """
    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in set(shard.column("phrase").to_pylist()):
        letters = tuple([number.setdefault(w, len(number) + 1) for w in phrase.encode().split(b" ")])
        automaton.add_word(letters, len(letters))
    if len(automaton):
        automaton.make_automaton()
    ids, starts, ends = [], [], []
    for doc_id, text in zip(documents.column("doc_id").to_pylist(), documents.column("text").to_pylist(), strict=True):
        words = tuple([number.get(w, 0) for w in text.encode().split()])
        hits = list(automaton.iter(words)) if words and len(automaton) else []
        if hits:
            last, size = np.array(hits).T
            mask = np.zeros(len(words) + 2, dtype=np.int64)
            np.add.at(mask, last + 2 - size, 1)
            np.add.at(mask, last + 2, -1)
            edges = np.flatnonzero(np.diff(np.cumsum(mask) > 0))
            ids.append(doc_id)
            starts.append(edges[::2])
            ends.append(edges[1::2])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})


def covered(texts: DataFrame, occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, starts and ends of the words covered by recurring passages, from all shards that a document calls."""
    size = found.agg(F.sum(F.aggregate("phrases", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    found = found.withColumn("shard", F.pmod(F.xxhash64("holder"), F.lit(size // SHARD_BYTES + 1)))
    calls = occurrences.join(found.select("anchor", "stretch", "shard").hint("merge"), ["anchor", "stretch"]).select("doc_id", "bytes", "shard").distinct()
    calls = _spark.cut(calls, "sub-calls")
    salts = _spark.cut(calls.groupBy("shard").agg(F.ceil(F.sum("bytes") / DOC_BYTES).cast("int").alias("salts")), "sub-salts")
    dealt = calls.join(salts.hint("merge"), "shard").select("doc_id", F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt")).alias("part"))
    per_doc = _spark.cut(dealt.groupBy("doc_id").agg(F.collect_list("part").alias("parts")), "sub-dealt")  # as many as a document has anchors, at most
    sent = _bloom.pick(texts, _bloom.IdFilter(per_doc.select("doc_id"))).join(per_doc.hint("merge"), "doc_id").select("doc_id", "text", F.explode("parts").alias("part")).select("doc_id", "text", "part.*")
    compiled = found.select("shard", F.explode("phrases").alias("phrase")).distinct().join(salts.hint("merge"), "shard").select("shard", "phrase", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    located = sent.groupBy("shard", "salt").cogroup(compiled.groupBy("shard", "salt")).applyInArrow(locate, "doc_id long, starts array<int>, ends array<int>")
    merged = located.groupBy("doc_id").agg(F.collect_list(F.struct("starts", "ends")).alias("runs"))
    return merged.select("doc_id", F.flatten("runs.starts").alias("starts"), F.flatten("runs.ends").alias("ends"))


def without_runs(batches):
    """own, n_words, n_removed and kept of own, text, starts, ends."""
    for b in batches:
        data, offsets = _text.buffers(b.column(1))
        counts, removed, kept = [], [], []
        for k, (starts, ends) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            words = data[offsets[k] : offsets[k + 1]].tobytes().split()
            if starts:
                mask = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(mask, starts, 1)
                np.add.at(mask, ends, -1)
                stay = np.cumsum(mask)[:-1] <= 0
                kept.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode())
                removed.append(int((~stay).sum()))
            else:
                kept.append(b" ".join(words).decode())
                removed.append(0)
            counts.append(len(words))
        yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and `kept`, the words that stay, joined by one space."""
    # inside, a row is named by a hash of id and text: rows that share it are copies, and have the same words covered
    rows = docs.select(F.col("doc_id").alias("own"), F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    texts = rows.select("doc_id", "text")
    occurrences = _spark.cut(recurring_anchors(texts, window, gram), "sub-anchors")
    found = _spark.cut(phrases(occurrences, texts, window, gram), "sub-phrases")
    runs = _spark.cut(covered(texts, occurrences, found), "sub-covered")
    losing = _bloom.may_have(_bloom.IdFilter(runs.select("doc_id")), F.col("doc_id"))
    cut = rows.where(losing).join(runs.hint("merge"), "doc_id", "left").select("own", "text", "starts", "ends")
    none = F.lit(None).cast("array<int>")
    rest = rows.where(~losing).select("own", "text", none.alias("starts"), none.alias("ends"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return cut.mapInArrow(without_runs, schema).unionByName(rest.mapInArrow(without_runs, schema))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_spark.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
