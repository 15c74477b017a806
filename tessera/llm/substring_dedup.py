"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of WINDOW words has a Rabin-Karp fingerprint. A window is removed
if its word sequence also starts earlier (smaller doc_id, or the same document
at an earlier word); removed windows merge into maximal intervals.

Three passes keep the shuffle far below one row per window:
1. Anchors. Inside every window the smallest fingerprint of its GRAM-word runs
   is its anchor; equal windows have equal anchors, and neighbouring windows
   mostly share one. Anchors are counted in Spark. A window whose anchor occurs
   once in the corpus is unique and is settled here.
2. Windows. Windows under repeated anchors get two independent Rabin-Karp
   fingerprints (128 bits), and the first start of each is found.
3. Intervals. Starts that are not first are gathered per document and merged.

Rows that repeat the text of a smaller doc_id are settled by digest, without
their windows. Before each shuffle a task settles what it can alone: of the anchors and
windows that occur several times in its own rows, only the first is sent on.
A passage that a third of all documents share thus reaches a reducer once per
task. A task holds at most BUFFER entries at a time.

Defined results
* null or empty text has no words; texts shorter than a window lose nothing;
* rows are told apart by doc_id and text: rows repeated with both are one
  document and get one answer; a null doc_id counts as the smallest id;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches, split_words, text_buffer, windows

WINDOW = 20
GRAM = 8
BUFFER = 3_000_000
#: Text in a batch: the more, the more repeats are settled inside a task.
BATCH_BYTES = 8 << 20
#: Row keys of which at most so many are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
_SECOND = 0xA0761D6478BD642F


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Position of the leftmost smallest value of every run of ``size`` values."""
    best = np.arange(len(values))
    span = 1
    while span * 2 <= size:
        a, b = best[:-span], best[span:]
        best = np.where(values[b] < values[a], b, a)
        span *= 2
    if span < size:
        n = len(values) - size + 1
        a, b = best[:n], best[size - span : size - span + n]
        best = np.where(values[b] < values[a], b, a)
    return best


_ANCHORS = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("times", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("many", pa.int32())])


def _settle(keys: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then rows; whether a row is the first of its key, and how often each first's key occurs."""
    order = np.lexsort([*rows[::-1], *keys[::-1]])
    change = np.zeros(len(order), bool)
    if len(order):
        change[0] = True
        for k in keys:
            x = k[order]
            change[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(change)
    times = np.zeros(len(order), np.int64)
    times[starts] = np.diff(np.r_[starts, len(order)])
    return order, change, times


def _anchors(window: int, gram: int, buffer: int):
    def run(stream):
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            anchor, doc, tag, start, many = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first, times = _settle([anchor], [doc, tag, start])
            # The first of each anchor is counted across tasks; the others are known to be repeated.
            salt = np.where(first, 0, 1 + np.arange(len(order)) % 251)
            n = np.where(first, times, 2)
            columns = (anchor[order], salt, n, doc[order], tag[order], start[order], many[order])
            for lo in range(0, len(order), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 65536].astype(f.type.to_pandas_dtype())) for c, f in zip(columns, _ANCHORS)], schema=_ANCHORS)

        size = 0
        for batch in batches(stream, BATCH_BYTES):
            words = split_words(*text_buffer(batch.column(2)), lower=False)
            grams = windows(words.hashes, gram)
            count = max(0, len(words.hashes) - window + 1)
            if not count:
                continue
            at = _sliding_least(grams, window - gram + 1)[:count]
            owner = np.repeat(np.arange(len(words.counts)), words.counts)
            whole = owner[:count] == owner[window - 1 : window - 1 + count]
            live = np.flatnonzero(whole)
            if not len(live):
                continue
            # A span: consecutive windows of one text under one anchor.
            new = np.r_[True, (at[live[1:]] != at[live[:-1]]) | (live[1:] != live[:-1] + 1) | (owner[live[1:]] != owner[live[:-1]])]
            begin = live[new]
            many = np.diff(np.r_[np.flatnonzero(new), len(live)])
            text = owner[begin]
            docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            held.append((grams[at[begin]].view(np.int64), docs[text], tags[text], begin - words.offsets[text], many))
            size += len(begin)
            if size >= buffer:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


_READ = "doc_id long, doc long, tag long, copy boolean, n_words long, whole_sha256 string, text string, sure array<int>, h1 array<long>, h2 array<long>, start array<int>"


def _kept_hash(data: bytes, words, lo: int, hi: int, keep: np.ndarray | None) -> str:
    starts, ends = words.starts[lo:hi], words.ends[lo:hi]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    return hashlib.sha256(b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())])).hexdigest()


def _windows(window: int):
    """Texts with the spans under repeated anchors -> word counts, and the
    fingerprints of the windows in those spans (the first of each per batch)."""

    def run(stream):
        for batch in batches(stream, BATCH_BYTES):
            data, offsets = text_buffer(batch.column(3))
            words = split_words(data, offsets, lower=False)
            raw = data.tobytes()
            n = batch.num_rows
            spans = batch.column(4)
            marked = spans.to_pylist()
            at = words.offsets
            where, who = [], []
            for k, s in enumerate(marked):
                if s:
                    for x in s:
                        where.append(np.arange(x["start"], min(x["start"] + x["many"], at[k + 1] - at[k] - window + 1)) + at[k])
                        who.append(np.full(len(where[-1]), k))
            sure = [np.zeros(0, np.int64)] * n
            parts = [[np.zeros(0, np.int64)] * 3 for _ in range(n)]
            if where:
                place, text = np.concatenate(where), np.concatenate(who)
                one, two = windows(words.hashes, window).view(np.int64)[place], windows(words.hashes, window, _SECOND).view(np.int64)[place]
                docs, tags = np.asarray(batch.column(1)), np.asarray(batch.column(2))
                start = place - at[text]
                order, first, _ = _settle([one, two], [docs[text], start, tags[text]])
                head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                d, s = docs[text][order], start[order]
                later = (d != d[head]) | (s != s[head])

                def by_text(rows):
                    rows = rows[np.argsort(text[rows], kind="stable")]
                    return np.split(rows, np.searchsorted(text[rows], np.arange(1, n)))

                sure = [start[r] for r in by_text(order[later])]
                parts = [[x[r] for x in (one, two, start)] for r in by_text(order[~later])]
            hashes = [_kept_hash(raw, words, at[k], at[k + 1], None) for k in range(n)]
            texts = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), batch.column(5), pa.array(words.counts, pa.int64()), pa.array(hashes), pa.array([t if m else None for t, m in zip(texts, marked)], pa.string()),
                    pa.array(sure, pa.list_(pa.int32())), *[pa.array([p[j] for p in parts], pa.list_(t)) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32()))],
                ],
                names=[x.split()[0] for x in _READ.split(", ")],
            )

    return run


def merge_intervals(starts, window: int) -> list[tuple[int, int]]:
    """Maximal [begin, end) word intervals covered by windows at ``starts``."""
    s = np.unique(np.asarray(starts, dtype=np.int64))
    if not len(s):
        return []
    cut = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + window])
    return list(zip(s[cut].tolist(), (s[np.r_[cut[1:] - 1, len(s) - 1]] + window).tolist()))


def _remove(window: int):
    def run(stream):
        for batch in batches(stream, BATCH_BYTES):
            data, offsets = text_buffer(batch.column(3))
            words = split_words(data, offsets, lower=False, hashed=False)
            raw, at = data.tobytes(), words.offsets
            removed, hashes, spans = [], [], []
            for k, (sure, more) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                keep = np.ones(at[k + 1] - at[k], bool)
                found = merge_intervals((sure or []) + (more or []), window)
                for lo, hi in found:
                    keep[lo:hi] = False
                removed.append(int((~keep).sum()))
                hashes.append(_kept_hash(raw, words, at[k], at[k + 1], keep) if found else batch.column(2)[k].as_py())
                spans.append([{"begin": lo, "end": hi} for lo, hi in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(hashes), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
            )

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, buffer: int = BUFFER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ``removed`` (word intervals)
    for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    workspace.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tag"), "text")

    # A row with the text of a smaller doc_id goes as a whole: its windows all start there earlier.
    marks = workspace.materialise(rows.select("doc", "tag", F.md5(F.col("text").cast("binary")).alias("digest")), "repeats-marks")
    groups = marks.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    groups = workspace.dealt_apart(groups.select("digest", "first"), "first")
    copies = workspace.materialise(marks.join(groups, "digest").where("doc > first").select("doc", "tag").distinct(), "repeats-copies")

    found = rows.select("doc", "tag", "text").mapInArrow(_anchors(window, min(gram, window), buffer), "anchor long, salt int, times int, doc long, tag long, start int, many int")
    total = F.sum("times").over(Window.partitionBy("anchor", "salt"))
    repeated = found.withColumn("total", total).where("total > 1").join(copies, ["doc", "tag"], "left_anti")
    spans = repeated.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "many")).alias("spans")).withColumn("copy", F.lit(False))
    spans = workspace.materialise(spans.unionByName(copies.select("doc", "tag", F.lit(None).cast("array<struct<start:int,many:int>>").alias("spans"), F.lit(True).alias("copy"))), "repeats-spans")
    if spans.count() <= BROADCAST_ROWS:
        # Only keys are broadcast; spans meet texts in a shuffle of the texts that have some.
        keyed = rows.join(F.broadcast(spans.select("doc", "tag", "copy")), ["doc", "tag"], "left")
        whole = keyed.where("copy is null or copy").withColumn("spans", F.lit(None).cast("array<struct<start:int,many:int>>"))
        marked = keyed.where("not copy").join(spans.select("doc", "tag", "spans"), ["doc", "tag"]).unionByName(whole)
    else:
        marked = rows.join(spans, ["doc", "tag"], "left")
    read = workspace.materialise(marked.select("doc_id", "doc", "tag", "text", "spans", "copy").mapInArrow(_windows(window), _READ), "repeats-windows")

    seen = read.where("size(start) > 0").select("doc", "tag", F.explode(F.arrays_zip("h1", "h2", "start")).alias("x")).select("doc", "tag", "x.h1", "x.h2", "x.start")
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc", "start"))
    later = seen.withColumn("place", place).where("place > 1").groupBy("doc", "tag").agg(F.collect_list("start").alias("more"))
    texts = read.where("text is not null").select("doc_id", "doc", "tag", "n_words", "whole_sha256", "text", "sure").join(later, ["doc", "tag"], "left")
    cut = texts.select("doc_id", "n_words", "whole_sha256", "text", "sure", "more").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<begin:long,end:long>>")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n_words") >= window)
    interval = F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))).otherwise(F.array().cast("array<struct<begin:long,end:long>>"))
    removed = F.when(gone, F.col("n_words")).otherwise(F.lit(0).cast("long"))
    kept = F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("whole_sha256"))
    clean = read.where("text is null").select("doc_id", "n_words", removed.alias("n_removed"), kept.alias("kept_sha256"), interval.alias("removed"))
    return cut.unionByName(clean)


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
n as (select doc_id, w, len(w)::bigint as n_words from d),
p as (select doc_id, n_words, w, unnest(range(1, n_words - 18)) as i from n where n_words >= 20),
h as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as h from p),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from h),
c as (select distinct doc_id, unnest(range(i, i + 20)) as j from r where k > 1),
g as (select doc_id, count(*)::bigint as n_removed, list(j) as cut from c group by doc_id)
select n.doc_id, n.n_words, coalesce(g.n_removed, 0) as n_removed,
       sha256(case when g.cut is null then array_to_string(n.w, ' ')
                   else coalesce(array_to_string(list_transform(list_filter(range(1, n.n_words + 1), lambda j: not list_contains(g.cut, j)), lambda j: n.w[j]), ' '), '') end) as kept_sha256
from n left join g on n.doc_id = g.doc_id
"""
