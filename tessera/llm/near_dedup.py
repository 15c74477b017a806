"""Near-duplicate detection by bottom-k sketches of one hash function.

1. Every text becomes the set of its word-shingle hashes. Texts with equal sets
   form a class, represented by its smallest doc_id; copies end there.
2. A class keeps the k smallest hashes of its set. Inverted lists hold, for
   every run of RUN consecutive retained values, the classes that retain it.
   Two sets of similarity s share such a run unless none of the k positions of
   their common order starts RUN agreements: with k = 64 and RUN = 3 that has
   probability 2e-13 at s = 0.85 and 1.3e-10 at s = 0.8. Sets of up to k
   shingles are kept whole; where the threshold lets two of them share no run
   of RUN (at 0.8, 4 shingles of 5), shorter runs are listed too, so that no
   pair of such sets is missed.
   Pairs at the threshold share many runs: fewer than m with a probability of at
   most LOSS (m = 5 at 0.85, 2 at 0.8), and sets kept whole share a number that
   their sizes promise. So a class leaves the lists of its m - 1 commonest runs,
   the last in an order of all runs by frequency: of m shared runs, the rarest
   stays listed on both sides. A repeated passage ties only texts to which it
   gives m runs or more.
3. The classes of a list are tied to the list's first class; tied classes are
   a family. All pairs that share a listed run stand in one family.
4. Inside a family, classes are dealt into bands by set size (a link needs
   sizes within the threshold's ratio, so only equal and neighbouring bands
   meet) and into blocks of bounded size. A pair of blocks is compared in one
   task: inverted lists of retained values give overlaps, the sketch of the
   union (the k smallest values of both) estimates similarity and drops pairs
   that fall short by more than MARGIN standard deviations, and full sets
   decide, strongest estimates first. Pairs already joined in the task are
   skipped, and only a spanning forest of the links leaves it.
5. Components of the links name each document's group.

Defined results
* null or empty text, or text without words: no shingles, linked with nothing;
  fewer words than a shingle: the whole sequence is the one shingle;
* a null doc_id takes no part: its component_id is null and it is kept;
* rows repeated with one doc_id are one document: its group is that of all of
  its rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .components import connected_components
from .kernels import batches, mix64, release, split_words, text_buffer, windows

SHINGLE = 5
SIMILARITY = 80
K = 64
RUN = 3
#: Probability that a pair at the threshold shares fewer runs than are counted on.
LOSS = 5e-9
#: Standard deviations that the union sketch's estimate may fall short by.
MARGIN = 6.0
#: Classes and shingles in a block, and of the small families in one task, on average.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 400_000
BIN_ROWS = 1024
BIN_SHINGLES = 1_500_000
#: Rows of which at most so many are broadcast (24 bytes each).
BROADCAST_ROWS = 200_000


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of every text of a column."""
    words = split_words(*text_buffer(column))
    runs = windows(words.hashes, size)
    at = words.offsets
    for k in range(len(at) - 1):
        lo, hi = at[k], at[k + 1]
        n = hi - lo
        if n >= size:
            yield np.unique(runs[lo : hi - size + 1])
        elif n:
            yield mix64(windows(words.hashes[lo:hi], int(n)) ^ np.uint64(0xA5A5 + int(n)))
        else:
            yield np.zeros(0, np.uint64)


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _sketches(size: int, k: int):
    def run(stream):
        for batch in batches(stream):
            ids, counts, low, high, kept = batch.column(0), [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                a, b = _identity(s)
                counts.append(len(s))
                low.append(a)
                high.append(b)
                kept.append(s[:k].view(np.int64))
            lengths = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists], names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return run


def _full_sets(size: int):
    def run(stream):
        for batch in batches(stream):
            low, high, sets = [], [], []
            for s in shingle_sets(batch.column(1), size):
                a, b = _identity(s)
                low.append(a)
                high.append(b)
                sets.append(s.tobytes())
            h1, h2 = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            same = pa.array((h1 == np.array(low, np.int64)) & (h2 == np.array(high, np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "items"])
            yield out.filter(same)

    return run


class _Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def union_estimates(sketches: list[np.ndarray], a: int, others: np.ndarray, at: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that share retained values with row ``a``, their estimated similarity
    and the size of the sketch behind it. ``others``, ``at`` and ``theirs`` tell
    each shared value: the row, and its place in both sketches, in rising order.

    The k smallest values of two sketches together are the union's own sketch. A
    value's place in it is the sum of its places less the shared values before it."""
    order = np.argsort(others, kind="stable")
    row, at, theirs = others[order], at[order], theirs[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    found, shared = row[first], np.diff(np.r_[first, len(row)])
    before = np.arange(len(row)) - np.repeat(first, shared)
    hits = np.add.reduceat((at + theirs - before < k).astype(np.int64), first)
    depth = np.minimum(k, len(sketches[a]) + np.array([len(sketches[x]) for x in found]) - shared)
    return found, hits / depth, depth


def compare(ids: list[int], sets: list[np.ndarray], sides: np.ndarray | None, percent: int, k: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with ``sides`` given, of
    the links between rows of different sides and within neither."""
    n = len(ids)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    sketches = [s[:k] for s in sets]
    values = np.concatenate(sketches)
    owner = np.repeat(np.arange(n), [len(s) for s in sketches])
    spot = np.concatenate([np.arange(len(s)) for s in sketches])
    order = np.argsort(values, kind="stable")
    values, owner, spot = values[order], owner[order], spot[order]
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    # Inverted lists: for every row, the rows that retain its values, values rising.
    place = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    mine = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[mine], np.arange(n + 1))
    forest, links, pairs = _Forest(n), [], []
    t = percent / 100
    for a in range(n):
        lists = place[mine[ends[a] : ends[a + 1]]]
        long = np.flatnonzero(cut[lists + 1] - cut[lists] > 1)
        if not len(long):
            continue
        lists = lists[long]
        entries = np.concatenate([np.arange(cut[x], cut[x + 1]) for x in lists])
        others, at = owner[entries], np.repeat(long, cut[lists + 1] - cut[lists])
        live = others > a
        if sides is not None:
            live &= sides[others] != sides[a]
        lo, hi = np.minimum(sizes[others], sizes[a]), np.maximum(sizes[others], sizes[a])
        live &= 100 * lo >= percent * hi
        if not live.any():
            continue
        found, guess, depth = union_estimates(sketches, a, others[live], at[live], spot[entries][live], k)
        ok = guess >= t - MARGIN * np.sqrt(t * (1 - t) / depth)
        pairs.append(np.stack([np.full(ok.sum(), a), found[ok], (guess[ok] * 1e6).astype(np.int64)]))
    if not pairs:
        return []
    left, right, guess = np.concatenate(pairs, axis=1)
    for x in np.argsort(-guess, kind="stable"):
        a, b = int(left[x]), int(right[x])
        ra, rb = forest.find(a), forest.find(b)
        if ra == rb:
            continue
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            forest.up[max(ra, rb)] = min(ra, rb)
            links.append((ids[a], ids[b]))
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        family = np.asarray(table.column("family").combine_chunks())
        ids = np.asarray(table.column("rep").combine_chunks())
        side = np.asarray(table.column("side").combine_chunks())
        items = table.column("items").combine_chunks()
        out: list[tuple[int, int]] = []
        order = np.argsort(family, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(family[order]) != 0, True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            rows = order[lo:hi]
            sets = [np.frombuffer(items[int(r)].as_py(), np.uint64) for r in rows]
            sides = side[rows]
            out += compare(ids[rows].tolist(), sets, sides if sides.any() else None, percent, k)
        links = pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=_LINKS)
        del table, family, ids, side, items, order
        release()
        return links

    return run


def shortest_runs(percent: int, k: int) -> dict[int, int]:
    """For sizes of up to ``k`` that can be linked with another set: the length of
    run that a set kept whole shares, at least, with every set linked to it."""
    out: dict[int, int] = {}
    for n in range(1, k + 1):
        for both in range(1, n + 1):
            # So many values may be in one of the two sets only; they part the shared ones.
            apart = both * (100 - percent) // max(1, percent)
            if apart >= max(1, n - both):
                out[n] = min(out.get(n, both), -(-both // (apart + 1)))
    return out


def fewer_runs(s: float, k: int, run: int) -> np.ndarray:
    """For m = 0, 1, ..: the probability that two sets of similarity ``s`` share
    fewer than m runs of their k common positions, each shared with probability s."""
    p = np.zeros((run, k + 1))  # by shared positions at the end (at most run - 1) and runs so far
    p[0, 0] = 1.0
    for _ in range(k):
        q = np.zeros_like(p)
        q[0] += p.sum(0) * (1 - s)
        q[1:] += p[:-1] * s
        q[-1, 1:] += p[-1, :-1] * s
        p = q
    return np.concatenate([[0.0], np.cumsum(p.sum(0))])


def sure_runs(percent: int, k: int, run: int) -> tuple[int, dict[int, int]]:
    """The number of runs that a pair at the threshold shares, but for LOSS; and
    less than that, by size, for sets of up to ``k`` that may share fewer."""
    usual = max(1, int(np.searchsorted(fewer_runs(percent / 100, k, run), LOSS, side="right")) - 1)
    out: dict[int, int] = {}
    for n in range(1, k + 1):
        for both in range(1, n + 1):
            apart = both * (100 - percent) // max(1, percent)
            if apart >= max(1, n - both):
                out[n] = min(out.get(n, usual), max(1, both - (run - 1) * (apart + 1)))
    return usual, {n: m for n, m in out.items() if m < usual}


def _listed(keys: DataFrame, usual: int, fewer: dict[int, int]) -> DataFrame:
    """``keys`` (rep, n, key) that more than one class has, without the commonest
    ones of every class: as many as its size lets it do without."""
    counts = workspace.dealt_apart(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "c", "key")
    common = keys.join(counts, "key")
    if usual == 1:
        return common.select("rep", "key")
    sure = F.lit(usual)
    for m in sorted(set(fewer.values())):
        sure = F.when(F.col("n").isin([n for n, x in fewer.items() if x == m]), m).otherwise(sure)
    # At most k runs each; the order of all runs is by frequency, then by key.
    each = common.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("runs"))
    stay = F.slice("runs", 1, F.greatest(F.size("runs") - sure + 1, F.lit(0)))
    return each.select("rep", F.explode(F.transform(stay, lambda x: x["key"])).alias("key"))


def _runs(classes: DataFrame, length: int) -> DataFrame:
    starts = F.sequence(F.lit(1), F.size("sketch") - (length - 1))
    return classes.where(F.size("sketch") >= length).select("rep", "n", F.explode(F.transform(starts, lambda i: F.xxhash64(*[F.element_at("sketch", (i + j).cast("int")) for j in range(length)]))).alias("key"))


def _families(classes: DataFrame, percent: int, k: int, run: int) -> DataFrame:
    """rep, family of the classes (rep, n, sketch) that share a listed run with others."""
    # A set of n shingles can be linked with another set only if n / (n + 1) reaches the threshold.
    shortest = shortest_runs(percent, k)
    least = min(shortest, default=k + 1)
    keys = _runs(classes.where(F.col("n") >= least), run)
    for length in range(1, run):
        sizes = [n for n, least in shortest.items() if least <= length]
        if sizes:
            keys = keys.unionByName(_runs(classes.where(F.col("n").isin(sizes)), length))
    keys = workspace.materialise(keys, "near-keys")
    lists = workspace.materialise(_listed(keys, *sure_runs(percent, k, run)), "near-lists")
    heads = lists.groupBy("key").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    heads = workspace.dealt_apart(heads, "head", "key")
    ties = lists.join(heads, "key").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    return connected_components(ties).withColumnRenamed("node", "rep").withColumnRenamed("component", "family")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = SIMILARITY, k: int = K, run: int = RUN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id,
    text): documents are linked if 100 * |intersection| >= percent * |union|."""
    spark = docs.sparkSession
    workspace.ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = workspace.materialise(texts.mapInArrow(_sketches(shingle, k), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>"), "near-sketches")
    whole = marks.where("doc_id is not null and n_shingles > 0")
    classes = whole.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("first"))
    classes = workspace.materialise(classes.select("h1", "h2", F.col("first.doc_id").alias("rep"), F.col("first.n_shingles").alias("n"), F.col("first.sketch").alias("sketch")), "near-classes")

    families = _families(classes, percent, k, run)
    members = workspace.materialise(classes.select("rep", "n", "h1", "h2").join(families, "rep"), "near-members")

    links = workspace.materialise(_links(texts, members, shingle, percent, k), "near-links")
    groups = connected_components(links).withColumnRenamed("node", "rep")
    # Rows of one doc_id with different texts tie their classes too.
    named = marks.where("doc_id is not null").select("doc_id", "n_shingles", "h1", "h2").join(classes.select("h1", "h2", "rep").withColumn("known", F.lit(True)), ["h1", "h2"], "left")
    named = named.join(groups, "rep", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).alias("component_id"))
    named = _join_repeats(workspace.materialise(named, "near-named"))
    nulls = marks.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(nulls)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of every group of linked
    documents the one with the smallest doc_id, once if its id is repeated."""
    marks = workspace.materialise(near_duplicates(docs, **options).select("doc_id", "kept"), "near-marks")
    (name,) = workspace.own_names(docs, "gone")
    gone = marks.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
    if marks.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))


def _join_repeats(named: DataFrame) -> DataFrame:
    """Ties the groups of rows that share a doc_id; a table of distinct ids passes through."""
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("n > 1 and a <> b")
    if repeated.isEmpty():
        return named
    pairs = named.join(repeated.select("doc_id", "a"), "doc_id").select(F.col("component_id").alias("b"), "a")
    names = connected_components(pairs).select(F.col("node").alias("component_id"), "component")
    return named.join(names, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def _links(texts: DataFrame, members: DataFrame, shingle: int, percent: int, k: int) -> DataFrame:
    n_members, total = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    side = members.select(F.col("rep").alias("doc_id"), "h1", "h2")
    side = F.broadcast(side) if n_members <= BROADCAST_ROWS else side
    sets = texts.join(side, "doc_id").select("doc_id", "text", "h1", "h2").mapInArrow(_full_sets(shingle), "rep long, items binary").dropDuplicates(["rep"])
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100))) if percent < 100 else F.col("n")
    members = members.withColumn("band", band.cast("long"))
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("items_in")).where("rows > 1")
    big = (F.col("rows") > BLOCK_ROWS) | (F.col("items_in") > BLOCK_SHINGLES)
    joined = members.join(sizes.withColumn("big", big), "family")
    bins = max(1, math.ceil(total / BIN_SHINGLES), math.ceil(n_members / BIN_ROWS))
    small = joined.where("not big").select("rep", "family", F.concat(F.lit("s"), F.pmod(F.xxhash64("family"), F.lit(bins))).alias("task"), F.lit(0).alias("side"))

    large = joined.where("big")
    per_band = large.groupBy("family", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("i"))
    per_band = per_band.select("family", "band", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("i") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    per_band = workspace.materialise(per_band, "near-bands")
    near = [per_band.withColumn("band", F.col("band") + d).withColumnRenamed("blocks", name) for d, name in ((0, "own"), (-1, "next"), (1, "last"))]
    dealt = large.select("rep", "family", "band")
    for side_table in near:
        dealt = dealt.join(side_table, ["family", "band"], "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("own").cast("long")).cast("int"))
    spot = lambda b, x: F.concat_ws(".", b.cast("string"), x.cast("string"))
    each = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here, up, down = F.col("band"), F.col("band") + 1, F.col("band") - 1
    tasks = F.concat(
        F.transform(each(F.col("own")), lambda x: F.struct(F.concat_ws("|", spot(here, F.least(x, F.col("block"))), spot(here, F.greatest(x, F.col("block")))).alias("t"), F.when(x == F.col("block"), 0).when(F.col("block") < x, 1).otherwise(2).alias("side"))),
        F.transform(each(F.col("next")), lambda x: F.struct(F.concat_ws("|", spot(here, F.col("block")), spot(up, x)).alias("t"), F.lit(1).alias("side"))),
        F.transform(each(F.col("last")), lambda x: F.struct(F.concat_ws("|", spot(down, x), spot(here, F.col("block"))).alias("t"), F.lit(2).alias("side"))),
    )
    large = dealt.select("rep", "family", F.explode(tasks).alias("x")).select("rep", "family", F.concat(F.lit("f"), F.col("family"), F.lit(":"), F.col("x.t")).alias("task"), F.col("x.side").alias("side"))
    work = small.unionByName(large).join(sets, "rep")
    return work.groupBy("task").applyInArrow(_verify(percent, k), "a long, b long")
