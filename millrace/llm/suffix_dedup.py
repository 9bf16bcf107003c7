"""Exact substring dedup by merged Burrows-Wheeler transforms.

A string of `length` bytes that starts in two places holds the same anchor in both: of the GRAM-byte grams in it, the one with the smallest hash
(winnowing). So only suffixes near an anchor whose gram occurs again can start a repeat; all others are settled without being sorted.

Each shard (the texts of an Arrow batch) sorts its suffixes at such anchors once and sends, in that order, their columns of two transforms: the bytes before them,
which the transform of the text yields at successive LF steps, and the bytes after, which the transform of the reversed text yields. Shards are merged per
anchor by iterative interleave refinement: the interleave of their sorted lists is split symbol by symbol, stably within each block, and the depth at which two
neighbours part is their common prefix. Then LF steps lead from the suffixes at the anchor to those one byte further left: a block splits by the preceding
byte, stably, and the common prefix of new neighbours is one more than the least between them. So no other column is sorted, and at each column the neighbours
whose common prefix reaches `length` are the repeated intervals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import chunks
from .ngram_join import BASE, INV, MUL, long_hashes, mix, powers, word_hashes

#: Bytes of an anchor; of the bytes looked at together; suffixes refined together; and suffixes of an anchor that are dealt out over several tasks.
GRAM = 100
STEP = 256 << 10
BATCH = 16_384
HOT = 4_096


def pieces(col: pa.Array, overlap: int):
    """(rows, offsets in their texts, bounds, bytes): runs of texts of about STEP bytes; longer texts in parts that overlap."""
    rows, offs, parts, size = [], [], [], 0
    for i, x in enumerate(col):
        raw = x.as_py()
        if not raw:
            continue
        for o in range(0, max(1, len(raw) - overlap), STEP):
            part = raw[o : o + STEP + overlap]
            rows.append(i), offs.append(o), parts.append(part)
            size += len(part)
            if size >= STEP:
                yield rows, offs, parts
                rows, offs, parts, size = [], [], [], 0
    if parts:
        yield rows, offs, parts


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima within blocks of w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    x = np.pad(v, (0, pad), constant_values=np.iinfo(v.dtype).max).reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(parts: list[bytes], length: int, gram: int = GRAM):
    """(part, position, hash) of every anchor: of each window of `length` bytes the first gram with the smallest hash."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INV, len(data)), dtype=np.uint64)])
    h = mix((total[gram:] - total[:-gram]) * powers(BASE, len(data) - gram + 1))
    best = sliding_min(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int32)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    at = best[np.cumsum(inside[: len(best)]) > 0] & np.uint64(0xFFFFFFFF)
    at = np.unique(at).astype(np.int64)
    part = np.searchsorted(bounds, at, "right") - 1
    return part, at - bounds[part], h[at]


def parted(blocks: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One refinement step over rows in order. blocks: ascending ids; symbols: each row's next one. (places of the rows whose blocks hold unlike symbols, the places
    that these rows come from when each such block is split stably, which of them begin a part); None if no block splits."""
    unlike = (blocks[1:] == blocks[:-1]) & (symbols[1:] != symbols[:-1])
    if not unlike.any():
        return None
    mixed = np.zeros(int(blocks[-1]) + 1, bool)
    mixed[blocks[1:][unlike]] = True
    at = np.flatnonzero(mixed[blocks])
    key = blocks[at] * (int(symbols.max()) + 1) + symbols[at]
    by = np.argsort(key, kind="stable")
    key = key[by]
    return at, at[by], np.concatenate([[True], key[1:] != key[:-1]])


def interleave(groups: np.ndarray, symbol, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before; -1 at the first of a group) of suffixes that come by group, each shard's in its order, and share `lo` bytes in a
    group. symbol(rows, h): their bytes at depth h. Common prefixes end at hi."""
    z = np.arange(len(groups))
    lcp = np.full(len(groups), hi, np.int32)
    lcp[np.concatenate([[True], groups[1:] != groups[:-1]])] = -1
    live = np.arange(len(groups))
    for h in range(lo, hi):
        begins = lcp[live] != hi
        begins[:1] = True
        ids = np.cumsum(begins) - 1
        many = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)
        live, ids = live[many], ids[many]
        if not len(live):
            break
        got = parted(ids, symbol(z[live], h))
        if got is not None:
            at, by, begins = got
            z[live[at]] = z[live[by]]
            fresh = live[at][begins]
            lcp[fresh] = np.where(lcp[fresh] == hi, h, lcp[fresh])
    return z, lcp


def repeats(groups: np.ndarray, left: list[bytes], right: list[bytes], twice: np.ndarray, length: int, a: int, b: int):
    """(row, least distance, largest distance) of runs of distances a <= o <= b before the anchor at which a string of `length` bytes starts that also starts elsewhere.

    Row i is a suffix right[i] preceded by left[i]; rows of a group share a bytes before and length - b after the anchor, and come in the order of their shards.
    A row that stands for several equal suffixes is marked twice: all its strings repeat.
    """
    n, top = len(groups), length - a
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    r = np.ascontiguousarray(np.frombuffer(b"".join(x[:top].ljust(top, b"\0") for x in right), np.uint8).reshape(n, top).T)
    l = np.ascontiguousarray(np.frombuffer(b"".join(x[-b:].rjust(b, b"\0") for x in left) if b else b"", np.uint8).reshape(n, b)[:, ::-1].T)  # noqa: E741

    def symbol(bytes_, sizes):
        # past a text's edge nothing is equal to anything
        return lambda rows, h: np.where(sizes[rows] > h, bytes_[h, rows].astype(np.int64), 256 + rows)

    z, lcp = interleave(groups, symbol(r, nr), length - b, top)
    flags = np.zeros((b + 2, n), bool)
    step = symbol(l, nl)
    for o in range(a, b + 1):
        same = np.flatnonzero(lcp >= length - o)
        flags[o, z[same]] = flags[o, z[same - 1]] = True
        if o == b:
            break
        ids = np.cumsum(lcp < 0) - 1
        got = parted(ids, step(z, o)) if len(z) else None
        if got is not None:
            at, by, begins = got
            # the common prefix of new neighbours: the least between their old places
            least = np.append(lcp, 0)
            k = np.flatnonzero(~begins)
            new = np.full(len(at), -1, np.int32)
            if len(k):
                new[k] = np.minimum.reduceat(least, np.stack([by[k - 1] + 1, by[k] + 1], 1).ravel())[::2]
            z[at], lcp[at] = z[by], new
        alone = (lcp < 0) & np.append(lcp[1:] < 0, True)
        if alone.any():
            z, lcp = z[~alone], lcp[~alone]
    o = np.arange(b + 2)[:, None]
    flags |= twice & (o >= a) & (o <= np.minimum(nl, b)) & (o >= length - nr)
    edge = np.diff(flags.astype(np.int8), axis=0, prepend=0)
    row, lo = np.nonzero(edge.T == 1)
    hi = np.nonzero(edge.T == -1)[1] - 1
    return row, lo, hi


def halves(a, b):
    """The two halves of a range of distances a to b; one of width 0 is its own half."""
    mid = F.floor((a + b) / 2).cast("int")
    return F.filter(F.array(F.struct(a.alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), b.alias("b"))), lambda x: x["a"] <= x["b"])


def banded(rows: DataFrame, length: int) -> DataFrame:
    """rows (a, b, grp, suffix, left, right, twice) for each half of their range a to b: strings that start at such a distance share a bytes before and length - b
    after the anchor, which with grp make the half's grp. same: a hash of the b bytes before and the length - a after, all that the half looks at."""
    last = lambda c, n: F.substring(c, F.greatest(F.octet_length(c) - n + 1, F.lit(1)), n)
    r = rows.withColumn("h", F.explode(halves(F.col("a"), F.col("b")))).select("grp", "suffix", "left", "right", "twice", "h.a", "h.b")
    r = r.where((F.octet_length("left") >= F.col("a")) & (F.octet_length("right") >= length - F.col("b")))
    r = r.select("a", "b", F.xxhash64("grp", "a", "b", last(F.col("left"), F.col("a")), F.substring("right", F.lit(1), length - F.col("b"))).alias("grp"), "suffix", last(F.col("left"), F.col("b")).alias("left"), F.substring("right", F.lit(1), length - F.col("a")).alias("right"), "twice")
    return r.withColumn("same", F.unhex(F.md5(F.concat(F.octet_length("left").cast("string").cast("binary"), F.lit(":").cast("binary"), "left", "right"))))


def whole_runs(runs_: DataFrame) -> DataFrame:
    """Runs of distances (suffix, lo, hi) with those that meet or overlap in a suffix made one: the parts of a run found in several halves. A suffix has at most
    one run for each two distances."""
    r = F.sort_array(F.collect_list(F.struct("lo", "hi")))
    last = lambda xs: F.element_at(xs, -1)
    grown = lambda xs, x: F.concat(F.slice(xs, 1, F.size(xs) - 1), F.array(F.struct(last(xs)["lo"].alias("lo"), F.greatest(last(xs)["hi"], x["hi"]).alias("hi"))))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    one = F.aggregate(r, none, lambda xs, x: F.when((F.size(xs) > 0) & (F.get(xs, F.size(xs) - 1)["hi"] + 1 >= x["lo"]), grown(xs, x)).otherwise(F.concat(xs, F.array(x))))
    return runs_.groupBy("suffix").agg(one.alias("r")).select("suffix", F.inline("r"))


def again(by: str, names: list[str]):
    """A task over rows sorted by `by`: the columns `names` of the rows whose value another row has too."""

    def task(batches):
        held, it, last = None, iter(batches), False
        while not last:
            b = next(it, None)
            last = b is None
            t = pa.Table.from_batches([b]) if b is not None else None
            t = t if held is None else held if t is None else pa.concat_tables([held, t])
            if t is None or not len(t):
                continue
            a = t.column(by).to_numpy()
            same = a[1:] == a[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            # the last row waits for its follower, with the row before it if that has the same value
            end = len(a) if last else len(a) - 1
            back = 0 if last else 2 if len(a) > 1 and same[-1] else 1
            held = None if last else t.slice(len(a) - back)
            out = t.slice(0, end).filter(pa.array(keep[:end]))
            yield from out.select(names).to_batches()

    return task


def hashed_words(col: pa.Array):
    """(row, hashes of its words in order) for each text with a word; letters A-Z lower-cased."""
    for at, bounds, data in chunks(col, STEP):
        if len(data) > 2 * STEP:  # then it is one text
            yield at, long_hashes(data)
        elif len(data):
            start, h = word_hashes(data, bounds)
            first = np.searchsorted(start, bounds)
            yield from ((at + i, h[a:b]) for i, (a, b) in enumerate(zip(first[:-1], first[1:])) if b > a)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, from the words' hashes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + MUL) * powers(INV, len(h)), dtype=np.uint64)])
    return mix((total[k:] - total[:-k]) * powers(BASE, len(h) - k + 1))


def word_spans(docs: DataFrame, words: int) -> DataFrame:
    """key (MD5 of a text) and the byte ranges (start, end) of its runs of `words` words that also start anywhere else, stored.

    Two equal runs hold the same anchor: of their runs of half as many words the first with the smallest hash. So only runs around an anchor that occurs again are
    looked up; none is left out by a cap or a sample.
    """
    parts, half = common.task_count(docs.sparkSession), words // 2
    texts = docs.where(F.octet_length("text") >= 2 * words - 1).select(F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("key"), "text")

    def anchored(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = rolled(h, half)
        at = np.unique(sliding_min(g >> np.uint64(32) << np.uint64(32) | np.arange(len(g), dtype=np.uint64), words - half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return at, g[at].astype(np.int64)

    def find(batches):
        for b in batches:
            got = [anchored(h) for _, h in hashed_words(b.column("text")) if len(h) >= words]
            if got:
                h, n = np.unique(np.concatenate([g for _, g in got]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["anchor", "n"])

    common_ = texts.mapInArrow(common.lean(find), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    common_ = common.stored(common_, "word-anchors")

    def place(batches):
        for b in batches:
            rows, at, ats = [], [], []
            for i, h in hashed_words(b.column("text")):
                if len(h) >= words:
                    p, g = anchored(h)
                    rows.append(np.full(len(p), i)), at.append(p), ats.append(g)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ats)), b.column("key").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(at))], names=["anchor", "key", "at"])

    marked = texts.mapInArrow(common.lean(place), "anchor long, key binary, at long").join(common_, "anchor", "left_semi")
    near = common.stored(marked.groupBy("key").agg(F.collect_set("at").alias("ats")), "word-places")

    def look(batches):
        for b in batches:
            for i, h in hashed_words(b.column("text")):
                raw = b.column("text")[i].as_py().encode()
                at = np.array(b.column("ats")[i].as_py(), np.int64)
                at = np.unique((at[:, None] - np.arange(words - half + 1)).ravel())
                at = at[(at >= 0) & (at <= len(h) - words)]
                edges = np.array([m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)], np.int64)
                run = rolled(h, words)[at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array([b.column("key")[i].as_py()] * len(at), pa.binary()), pa.array(edges[at, 0]), pa.array(edges[at + words - 1, 1])], names=["run", "key", "start", "end"])

    likely = common.perhaps(texts, near, "near").where("near").drop("near")
    found = likely.join(near, "key").mapInArrow(common.lean(look), "run long, key binary, start long, end long").repartition(parts, "run").sortWithinPartitions("run")
    found = found.mapInArrow(common.lean(again("run", ["key", "start", "end"])), "key binary, start long, end long")
    marks = common.stored(found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "word-ranges")
    common.discard(common_, near)
    return marks


def spans(docs: DataFrame, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """(copies, marks), stored. copies: the keys (MD5) of texts that several rows have, rep: the smallest doc_id among them. marks: for other texts' keys
    the byte ranges `ranges` (start, end) covered by a string of `length` bytes that also starts elsewhere."""
    parts = common.task_count(docs.sparkSession)
    raw = F.encode("text", "UTF-8")
    keyed = docs.where(F.octet_length("text") >= length).select("doc_id", F.unhex(F.md5(raw)).alias("key"), raw.alias("raw"))
    copies = keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", "rep")
    copies = common.stored(copies, "text-copies")
    # a text that several rows have is looked at once: every byte of it is repeated
    single = keyed.join(common.checked_broadcast(copies, 80), "key", "left").where(F.col("rep").isNull() | F.col("rep").eqNullSafe(F.col("doc_id"))).select("key", "raw")

    def find(batches):
        for b in batches:
            for rows, offs, texts in pieces(b.column("raw"), length - 1):
                part, at, h = anchors(texts, length)
                _, first, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                lead = np.zeros(len(h), bool)
                lead[first] = True
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), b.column("key").take(pa.array(np.array(rows, np.int64)[part])), pa.array(at + np.array(offs, np.int64)[part]), pa.array(lead), pa.array(count[which] > 1)], names=["anchor", "key", "at", "lead", "twice"])

    # an anchor that comes often in the texts looked at together goes on once from there
    seen = common.stored(single.mapInArrow(common.lean(find), "anchor long, key binary, at long, lead boolean, twice boolean"), "anchors")
    found = seen.where("lead").select("anchor", "key", "at").repartition(parts, "anchor").sortWithinPartitions("anchor")

    hits = found.mapInArrow(common.lean(again("anchor", ["key", "at"])), "key binary, at long").union(seen.where("twice").select("key", "at")).groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    hits = common.stored(hits, "anchor-hits")
    common.discard(seen)
    reach = length - GRAM

    def cut(batches):
        from pyspark import TaskContext

        shard, done = TaskContext.get().partitionId(), 0
        for b in batches:
            own: dict[tuple, list] = {}  # equal suffixes of the batch, with what precedes them, are one
            for k, x, ats in zip(b.column("key"), b.column("raw"), b.column("ats")):
                k, raw = k.as_py(), x.as_py()
                for p in ats.as_py():
                    grp = xxhash.xxh3_64_intdigest(raw[p : p + GRAM]) - (1 << 63)
                    own.setdefault((grp, raw[p : p + length], raw[max(0, p - reach) : p]), []).append((k, p))
            # the shard's transform: suffixes in order, each with what precedes it
            cols = [[] for _ in range(7)]
            for grp, right, left in sorted(own):
                held = own[grp, right, left]
                for i, (k, p) in enumerate(held):
                    for c, v in zip(cols, (grp, shard << 36 | done, k, p, left if i == 0 else None, right if i == 0 else None, len(held) > 1)):
                        c.append(v)
                done += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["grp", "suffix", "key", "at", "left", "right", "twice"])

    likely = common.perhaps(single, hits, "hit").where("hit").drop("hit")
    shards = likely.join(hits, "key").mapInArrow(common.lean(cut), "grp long, suffix long, key binary, at long, left binary, right binary, twice boolean")
    shards = common.stored(shards, "shard-suffixes")
    own = shards.where("left is not null").select("grp", "suffix", "left", "right", "twice")
    many = common.stored(own.groupBy("grp").count().where(F.col("count") > HOT).select("grp"), "hot-anchors")
    hot_groups = common.checked_broadcast(many, 8)
    cool = own.join(hot_groups, "grp", "left_anti").select(F.lit(0).alias("a"), F.lit(reach).alias("b"), "grp", "suffix", "left", "right", "twice")
    # a hot anchor is dealt out by what precedes and follows it, for each half of the distances apart, and again for a half that stays hot. Suffixes that a half
    # cannot tell apart are one there, so that a half of a single distance is never hot
    hot, levels, work = own.join(hot_groups, "grp", "left_semi").withColumns({"a": F.lit(0), "b": F.lit(reach)}), [], []
    while hot.limit(1).count():
        level = common.stored(banded(hot, length), "hot-suffixes")
        stand = level.groupBy("a", "b", "grp", "same").agg(F.min("suffix").alias("suffix"), F.min("left").alias("left"), F.min("right").alias("right"), ((F.count("*") > 1) | F.max("twice")).alias("twice"))
        size = common.stored(level.groupBy("a", "b", "grp").agg(F.count_distinct("same").alias("n"), F.max("twice").alias("twice"), F.count("*").alias("c")).where("c > 1 or twice").select("a", "b", "grp", "n"), "hot-sizes")
        work += [level, size]
        levels.append((level.drop("left", "right"), stand.join(size.where(F.col("n") <= HOT), ["a", "b", "grp"], "left_semi")))
        hot = level.join(size.where(F.col("n") > HOT), ["a", "b", "grp"], "left_semi").drop("same")
    merged = cool
    for _, stand in levels:
        merged = merged.unionAll(stand.select(cool.columns))
    merged = merged.repartition(parts, "grp", "a").sortWithinPartitions("a", "b", "grp", "suffix")

    def merge(batches):
        held, size, band = [], 0, None

        def flush():
            t = pa.concat_tables(held)
            row, lo, hi = repeats(t.column("grp").to_numpy(), t.column("left").to_pylist(), t.column("right").to_pylist(), t.column("twice").to_numpy(), length, *band)
            rows = pa.array(row)
            return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(rows) for c in ("a", "b", "grp", "suffix")] + [pa.array(lo), pa.array(hi)], names=["a", "b", "grp", "suffix", "lo", "hi"])

        for t in blocks(batches):
            own = (t.column("a")[0].as_py(), t.column("b")[0].as_py())
            if held and (size >= BATCH or own != band):
                yield flush()
                held, size = [], 0
            band = own
            held.append(t)
            size += len(t)
        if held:
            yield flush()

    runs_ = common.stored(merged.mapInArrow(common.lean(merge), "a int, b int, grp long, suffix long, lo long, hi long"), "repeat-runs")
    # what holds for a suffix that stands for equal ones holds for each of them
    found_runs = runs_.where(F.col("b") == reach).where("a = 0").select("suffix", "lo", "hi")
    for level, _ in levels:
        stood = level.join(runs_, ["a", "b", "grp", "suffix"]).select("a", "b", "grp", "same", "lo", "hi")
        found_runs = found_runs.unionAll(level.join(stood, ["a", "b", "grp", "same"]).select("suffix", "lo", "hi"))
    if levels:
        found_runs = whole_runs(found_runs)
    # and so it does for the other places of a suffix in its shard
    ranges = shards.select("suffix", "key", "at").join(found_runs, "suffix").select("key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end"))
    marks = common.stored(ranges.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "repeat-ranges")
    common.discard(hits, shards, many, runs_, *work)
    return copies, marks


def blocks(batches):
    """Tables of whole groups of one band (no group is cut) over batches sorted by a, b and grp."""
    held = None
    for x in batches:
        t = pa.Table.from_batches([x])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not len(t):
            continue
        band, g = t.column("a").to_numpy().astype(np.int64) << 32 | t.column("b").to_numpy(), t.column("grp").to_numpy()
        new = np.flatnonzero((band[1:] != band[:-1]) | (g[1:] != g[:-1])) + 1
        bands_ = np.flatnonzero(band[1:] != band[:-1]) + 1
        cut = int(new[-1]) if len(new) else 0
        for lo, hi in zip([0, *bands_[bands_ < cut]], [*bands_[bands_ < cut], cut]):
            if hi > lo:
                yield t.slice(int(lo), int(hi - lo))
        held = t.slice(cut)
    if held is not None and len(held):
        yield held


def union(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = 400, words: int | None = None) -> DataFrame:
    """docs with sfx_n_bytes, sfx_n_removed, sfx_spans (array of start, end), sfx_kept (binary) and sfx_text (the kept runs
    as text, without the parts of characters that a cut leaves); text is kept as it was.

    Every byte covered by a string of `length` bytes of the text's UTF-8 that also starts anywhere else, in the same text too, is removed; strings are
    judged on the input. Null text is empty. Rows with equal texts remove each other whole if long enough; ids may be null or repeated. An empty table gives an
    empty result. docs is read several times and must give the same rows each time. All repeats are found: candidates are cut by no cap or sample. With `words`, runs of so many words that also start anywhere else, whatever their
    bytes and the white space in them, go too; they are judged on the input as well.
    """
    copies, marks = spans(docs, length)
    each = [marks, word_spans(docs, words)] if words else [marks]
    none = F.array().cast(marks.schema["ranges"].dataType)
    found = copies.select("key", F.lit(True).alias("sfx_copy"), none.alias("ranges"))
    for m in each:
        found = found.unionAll(m.select("key", F.lit(False).alias("sfx_copy"), "ranges"))
    found = common.stored(found.groupBy("key").agg(F.max("sfx_copy").alias("sfx_copy"), F.flatten(F.collect_list("ranges")).alias("sfx_ranges")), "text-marks")
    common.discard(copies, *each)
    names = docs.columns
    # texts without a mark stay where they are
    j = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("key"))
    j = common.perhaps(j, found, "marked")
    whole = j.where("not marked").select("row", F.lit(False).alias("sfx_copy"), none.alias("sfx_ranges"))
    j = j.where("marked").join(found, "key", "left").select("row", "sfx_copy", "sfx_ranges").unionAll(whole).select("row.*", "sfx_copy", "sfx_ranges")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in common.slices(batches, "text"):
            n, gone, sp, kept, txt = [], [], [], [], []
            for x, copy, r in zip(b.column("text"), b.column("sfx_copy"), b.column("sfx_ranges")):
                t = (x.as_py() or "").encode()
                u = [(0, len(t))] if copy.as_py() else union(r.as_py() or [])
                edges = [0, *(e for s in u for e in s), len(t)]
                n.append(len(t)), gone.append(sum(e - s for s, e in u)), sp.append([{"start": s, "end": e} for s, e in u])
                left = [t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)] if u else [t]
                kept.append(b"".join(left)), txt.append("".join(p.decode("utf-8", "ignore") for p in left))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sp, kind), pa.array(kept, pa.binary()), pa.array(txt, pa.string())], names=[*names, "sfx_n_bytes", "sfx_n_removed", "sfx_spans", "sfx_kept", "sfx_text"])

    return j.mapInArrow(common.lean(task), f"{fields}, sfx_n_bytes long, sfx_n_removed long, sfx_spans array<struct<start:long,end:long>>, sfx_kept binary, sfx_text string")
