"""Exact n-gram Jaccard join with signature trees.

Documents are sets of hashed word n-grams. Equal sets are one node. A set is cut by the grams' hashes into more parts than two similar sets can have grams that only
one of them holds, so that two such sets have an equal part (pigeonhole), and the nodes that share a part form a candidate list. Over each list a signature tree is built:
leaves hold a few nodes in order of size, inner nodes the OR of their token bitmaps and the range of their sizes. A dual traversal visits
pairs of tree nodes and leaves out those whose largest possible overlap is too small or whose members are already joined. The pairs it finds are verified on the exact sets.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language_id import LOWER, chunks

MUL = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3
INV = pow(BASE, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text hashed together, and entries of the tables of powers.
STEP = 256 << 10
KEPT = 1 << 19
#: Members of one task's list; longer lists are dealt out as pairs of blocks.
BLOCK = 4096
#: Nodes of a group of overlapping lists up to which it is always one list.
FEW = 64
#: Bits of a signature to a gram: in the first looks at a list, and in those where pairs that the bounds passed were no links.
NARROW, WIDE = 2, 16
#: Bytes of a part's key. Of unlike parts few have one key, and their documents are told apart later.
KEY = 6
#: Cuts of a set into parts, by a hash of their own each, before parts without grams count.
CUTS = 8
#: The first size of each class of sizes.
CLASSES = [1]
while CLASSES[-1] < 1 << 40:
    CLASSES.append(max(CLASSES[-1] + 1, CLASSES[-1] * 27 // 20))


def _powers(x: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(x, k, 1 << 64))
        k *= 2
    return out


_cache: dict[int, np.ndarray] = {}


def powers(x: int, n: int) -> np.ndarray:
    """x to the powers 0 to n - 1, modulo 2 to the 64th; tables longer than a run are not kept."""
    if n > KEPT:
        return _powers(x, n)
    if x not in _cache:
        _cache[x] = _powers(x, KEPT)
    return _cache[x][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of texts that lie one after another in data; bounds are their ends, 0 first."""
    low = LOWER[data].astype(np.uint64)
    space = SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    low += np.uint64(1)
    low *= powers(INV, len(low))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low, dtype=np.uint64)])
    return start, mix((total[end] - total[start]) * powers(BASE, len(low))[start] + (end - start).astype(np.uint64) * MUL)


def long_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, which is cut at white space into pieces of about STEP bytes."""
    out, lo = [], 0
    while lo < len(data):
        hi = lo + STEP
        while hi < len(data) and not SPACES[data[hi - 1]]:
            near = np.flatnonzero(SPACES[data[hi : hi + STEP]])
            hi = hi + int(near[0]) + 1 if len(near) else hi + STEP
        piece = data[lo:hi]
        out.append(word_hashes(piece, np.array([0, len(piece)]))[1])
        lo = hi
    return np.concatenate(out)


def sets(col: pa.Array, k: int):
    """(row, sorted distinct 64-bit hashes of its k-word grams) for each row with a word; whole texts, letters A-Z lower-cased."""
    for at, bounds, data in chunks(col, STEP):
        if not len(data):
            continue
        if len(data) > 2 * STEP:  # then it is one text
            h = long_hashes(data)
            bounds, first = bounds[[0, -1]], np.array([0, len(h)])
        else:
            start, h = word_hashes(data, bounds)
            first = np.searchsorted(start, bounds)
        gram = h.copy()
        for j in range(1, k):
            gram[: max(0, len(h) - j)] = mix(gram[: max(0, len(h) - j)] * np.uint64(5) + h[j:] + np.uint64(j))
        for i in range(len(bounds) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield at + i, np.unique(gram[a : b - k + 1])
            elif b > a:
                x = h[a : a + 1]
                for j in range(1, b - a):
                    x = mix(x * np.uint64(5) + h[a + j : a + j + 1] + np.uint64(j))
                yield at + i, x


def bitmap(s: np.ndarray, per: int = NARROW) -> np.ndarray:
    """Bits of a set: a power of two of them, at least `per` to a member and 512 in all."""
    width = 1 << max(9, int(per * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(8)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (or rows of them) at a smaller width: a bit is set if any that it stands for is."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return x


class Tree:
    """A signature tree over members sorted by size."""

    LEAF = 32

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], percent: int):
        self.ids, self.sizes, self.maps, self.p = ids, sizes, maps, percent
        self.parent = np.arange(len(ids))
        self.nodes: list[tuple] = []  # (lo, hi, or-bitmap, most excess, children)
        self.root = self.build(0, len(ids))

    def build(self, lo: int, hi: int) -> int:
        if hi - lo <= self.LEAF:
            kids, parts = (), self.maps[lo:hi]
        else:
            mid = (lo + hi) // 2
            kids = (self.build(lo, mid), self.build(mid, hi))
            parts = [self.nodes[x][2] for x in kids]
        words = min(len(m) for m in parts)
        union = fold(parts[0], words)
        for m in parts[1:]:
            union = union | fold(m, words)
        # members of a set that share a bit with another of its members, at this width
        excess = max(int(n) - int(np.bitwise_count(fold(m, words)).sum()) for n, m in zip(self.sizes[lo:hi], self.maps[lo:hi]))
        self.nodes.append((lo, hi, union, excess, kids))
        return len(self.nodes) - 1

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def possible(self, small: int, large: int, overlap: int) -> bool:
        """Whether sizes (the least of each side) and an upper bound of the overlap allow 100 |a & b| >= p |a | b|."""
        return (100 + self.p) * overlap >= self.p * (small + large)

    def joined(self, a: int, b: int) -> bool:
        la, ha, lb, hb = *self.nodes[a][:2], *self.nodes[b][:2]
        r = self.find(la)
        return all(self.find(i) == r for i in range(la, ha)) and all(self.find(i) == r for i in range(lb, hb))

    def pairs(self, spanning: bool) -> list[tuple[int, int]]:
        """Pairs of members that pass every bound. Spanning: those that join what is not yet joined; else all of unlike parent."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            la, ha, ua, ea, ka = self.nodes[a]
            lb, hb, ub, eb, kb = self.nodes[b]
            if a != b:
                if 100 * self.sizes[ha - 1] < self.p * self.sizes[lb]:
                    continue
                words = min(len(ua), len(ub))
                excess = min(e for e, u in ((ea, ua), (eb, ub)) if len(u) == words)
                over = int(np.bitwise_count(fold(ua, words) & fold(ub, words)).sum()) + excess
                if not self.possible(int(self.sizes[la]), int(self.sizes[lb]), min(over, int(self.sizes[ha - 1]))):
                    continue
            if self.joined(a, b):
                continue
            if ka and kb:
                stack += [(ka[0], kb[0]), (ka[1], kb[1]), (ka[0], kb[1])] + ([(ka[1], kb[0])] if a != b else [])
            elif ka or kb:
                stack += [(x, b) for x in ka] if ka else [(a, x) for x in kb]
            else:
                self.leaves(la, ha, lb, hb, spanning, out)
        return out

    def leaves(self, la: int, ha: int, lb: int, hb: int, spanning: bool, out: list) -> None:
        """The pairs of the members of two leaves, or of one, each with all of its partners at once."""
        widths = {len(m) for m in self.maps[lb:hb]}
        others = {w: np.stack([m if len(m) == w else np.zeros(w, np.uint64) for m in self.maps[lb:hb]]) for w in widths}
        for i in range(la, ha):
            at = max(lb, i + 1)
            for w in widths:
                # each bit of one that the other lacks is a member that it lacks
                words = min(w, len(self.maps[i]))
                js = np.array([j for j in range(at, hb) if len(self.maps[j]) == w], np.int64)
                js = js[100 * self.sizes[i] >= self.p * self.sizes[js]]
                if not len(js):
                    continue
                m, n = fold(self.maps[i], words), fold(others[w][js - lb], words)
                over = np.minimum(self.sizes[i] - np.bitwise_count(m & ~n).sum(1, dtype=np.int64), self.sizes[js] - np.bitwise_count(n & ~m).sum(1, dtype=np.int64))
                for j in js[(100 + self.p) * over >= self.p * (self.sizes[i] + self.sizes[js])].tolist():
                    x, y = self.find(i), self.find(j)
                    if x != y:
                        out.append((i, j))
                        if spanning:
                            self.parent[y] = x


def runs(batches, key: str):
    """(rows of one key) over record batches sorted by it."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        k = t.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if not len(cut):
            held = t
            continue
        held, t = t.slice(int(cut[-1])), t.slice(0, int(cut[-1])).combine_chunks()
        for a, b_ in zip([0, *cut[:-1]], cut):
            yield t.slice(int(a), int(b_ - a))
    if held is not None and len(held):
        yield held.combine_chunks()


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def cuts(n: int, percent: int):
    """(class, parts, most grams that only one of two linked sets holds) for each class of sizes in which a set of n grams may be one of two linked sets whose smaller one is of that class."""
    c = bisect.bisect_right(CLASSES, n) - 1
    while c >= 0 and percent * n <= 100 * (CLASSES[c + 1] - 1):
        top = CLASSES[c + 1] - 1
        apart = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
        # of the parts beyond one more than that a few may be empty
        yield c, apart + 2 + apart // 12, apart
        c -= 1


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the parts of a sorted set; two sets that link, and are not equal, share one.

    Of m parts, a apart, two linked sets have m - a equal ones at least; where one of the two has over a parts that hold grams, one of the equal parts holds grams. A set
    that has not is cut again by another hash, CUTS times at most, and has keys of each cut: so two such sets meet in the first cut in which one of them has, or in
    the last one, where parts without grams have keys too. Where only equal sets link there are no keys.
    """
    out = [np.zeros(0, np.uint64)]
    h = mix(s + MUL)
    for c, m, apart in cuts(len(s), percent):
        if not apart:
            continue
        for cut in range(CUTS):
            at = (mix(s + np.uint64(cut)) if cut else s) >> np.uint64(32)
            part = (at * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            by = np.argsort(part, kind="stable") if cut else slice(None)
            part = part[by]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own, total = part[first], np.add.reduceat(h[by], first)
            if cut == CUTS - 1 and len(own) <= apart:
                none = np.setdiff1d(np.arange(m), own)
                own, total = np.concatenate([own, none]), np.concatenate([total, np.zeros(len(none), np.uint64)])
            out.append(mix(total + mix(own.astype(np.uint64) * MUL + np.uint64((cut << 32) + c + 1))))
            if len(own) > apart:
                break
    return np.concatenate(out)


def features(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit hash of the set) and parts: KEY bytes of the key of each of its parts."""

    def task(batches):
        for b in batches:
            ns, s1, s2, keys = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [None] * b.num_rows
            for i, s in sets(b.column("text"), k):
                ns[i] = len(s)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                s1[i], s2[i] = np.uint64(d >> 64).astype(np.int64), np.uint64(d & (1 << 64) - 1).astype(np.int64)
                keys[i] = low_bytes(part_keys(s, percent), KEY)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns), pa.array(s1), pa.array(s2), pa.array(keys, pa.binary())], names=["doc_id", "n", "s1", "s2", "parts"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(task), "doc_id long, n long, s1 long, s2 long, parts binary")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): documents link when 100 |a & b| >= percent |a | b|.

    Sets: distinct k-word grams of the whole text; with fewer words the whole sequence; none without words, which links with nothing. component_id is the
    smallest doc_id reachable. Rows of one doc_id are one document and share a component; a null doc_id has a null component. Repeated
    rows are returned as often as they occur; an empty table gives an empty result. No list, candidate or link is capped: a list of more than BLOCK
    members is dealt out as pairs of blocks. A traversal takes a pair that passes the bounds for joined, so that a large group of copies gives a spanning
    tree and not all its pairs; lists in which such a pair fails verification are traversed again with wide signatures, which hardly pass a pair that is no link,
    and those in which one fails even so a last time, for all pairs not joined by then.
    """
    spark = docs.sparkSession
    parts = common.task_count(spark)
    f = common.stored(features(docs, k, percent), "gram-features")
    live = f.where("n > 0 and doc_id is not null")
    same = live.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("s1", "s2", "rep")
    same = common.checked_broadcast(common.stored(same, "gram-classes"), 80)
    work: list[DataFrame] = []  # stored frames that the result does not read
    reps = live.join(same, ["s1", "s2"], "left").where("rep is null or rep = doc_id")
    buckets = 4 * parts

    def dealt(batches):
        # keys with their nodes go as bytes: a row to each bucket, not to each key
        for b in common.slices(batches, "parts"):
            got = [x or b"" for x in b.column("parts").to_pylist()]
            key = from_low(b"".join(got), KEY)
            node = np.repeat(b.column("node").to_numpy(), [len(x) // KEY for x in got])
            at = (key >> np.uint64(8 * KEY - 32)) * np.uint64(buckets) >> np.uint64(32)
            by = np.argsort(at, kind="stable")
            own, first = np.unique(at[by], return_index=True)
            ends = [*first[1:], len(by)]
            keys = [low_bytes(key[by[i:j]], KEY) for i, j in zip(first, ends)]
            # equal bytes of the ids lie together, which packs them
            nodes = [np.ascontiguousarray(node[by[i:j]].astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for i, j in zip(first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary())], names=["bucket", "keys", "nodes"])

    grams = reps.select(F.col("doc_id").alias("node"), "parts").mapInArrow(common.lean(dealt), "bucket long, keys binary, nodes binary").repartition(parts, "bucket").sortWithinPartitions("bucket")

    def lists(batches):
        for t in runs(batches, "bucket"):
            key = from_low(b"".join(t.column("keys").to_pylist()), KEY)
            node = np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel() for x in t.column("nodes").to_pylist()])
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
            by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            by = by[np.lexsort((node[by], key[by]))]
            key, node = key[by], node[by]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[new], node[new]
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(at, len(key)))
            name = np.add.reduceat(mix(node.astype(np.uint64) * MUL + np.uint64(1)), at).astype(np.int64)
            keep = np.zeros(len(at), bool)
            keep[np.unique(name, return_index=True)[1]] = True  # of lists with the same members one is enough
            keep &= size > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[np.repeat(keep, size)]), pa.array(node[np.repeat(keep, size)])], names=["list", "node"])

    member = common.stored(grams.mapInArrow(common.lean(lists), "list long, node long").distinct(), "gram-lists")
    work.append(member)
    # the parts have met; the result, which the caller reads later, needs none of them
    f, whole = common.stored(f.select("doc_id", "n", "s1", "s2"), "gram-sizes"), f
    common.discard(whole)

    def signed(members: DataFrame, per: int) -> DataFrame:
        """node, n and bits of the members, with `per` bits to a gram."""

        def signatures(batches):
            for b in batches:
                rows, ns, maps = [], [], []
                for i, s in sets(b.column("text"), k):
                    rows.append(i), ns.append(len(s)), maps.append(bitmap(s, per).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), pa.array(maps, pa.binary())], names=["node", "n", "bits"])

        found = common.stored(members.select("node").distinct(), "gram-nodes")
        nodes = common.checked_broadcast(found, 16)
        held = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text").mapInArrow(common.lean(signatures), "node long, n long, bits binary")
        held = common.stored(held, "gram-signatures")
        common.discard(found)
        work.append(held)
        return held

    def traverse(spanning: bool):
        def task(batches):
            for t in runs(batches, "list"):
                ids, sizes = t.column("node").to_numpy(), t.column("n").to_numpy()
                tree = Tree(ids, sizes, [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()], percent)
                own: dict = {}
                for i, r in enumerate(t.column("root").to_pylist()):
                    tree.parent[i] = own.setdefault(r, i)
                got = tree.pairs(spanning)
                if got:
                    i, j = np.array(got).T
                    yield pa.RecordBatch.from_arrays([t.column("of").combine_chunks().take(pa.array(i)), pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["of", "a", "b"])

        return task

    def compare(batches):
        for b in common.slices(batches, "x", STEP):
            ok = np.zeros(b.num_rows, bool)
            other = sets(b.column("y"), k)
            at, y = -1, None
            for i, x in sets(b.column("x"), k):
                while at < i:
                    at, y = next(other, (b.num_rows, None))
                if at == i:
                    n = len(np.intersect1d(x, y, True))
                    ok[i] = 100 * n >= percent * (len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    def verified(members: DataFrame, held: DataFrame, spanning: bool) -> tuple[DataFrame, DataFrame]:
        """(of, a, b) of the pairs that pass the bounds, and (a, b, ok) by their exact sets. members: list, node, root. of: the list as members name it."""
        members = members.withColumn("of", F.col("list"))
        size = members.groupBy("list").count().where(F.col("count") > BLOCK)
        if size.limit(1).count():
            # a long list: its members, dealt into blocks, meet as pairs of blocks
            m = members.join(size, "list", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / (BLOCK // 2)), F.lit(1)))
            m = m.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            members = m.withColumn("list", F.when(F.col("blocks") > 1, F.xxhash64("list", F.least("own", "with"), F.greatest("own", "with"))).otherwise(F.col("list"))).drop("count", "blocks", "own", "with").distinct()
        m = members.join(held, "node").repartition(parts, "list").sortWithinPartitions("list", "n", "node")
        pairs = common.stored(m.mapInArrow(common.lean(traverse(spanning)), "of long, a long, b long").where("a <> b"), "gram-pairs")
        once = common.stored(pairs.select("a", "b").distinct(), "gram-once")
        found = common.stored(once.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "gram-ends")
        ends = common.checked_broadcast(found, 16)
        # texts are smaller than their sets of hashes
        texts = docs.join(ends, docs["doc_id"] == ends["node"], "left_semi").select("doc_id", "text")
        both = once.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        ok = both.mapInArrow(common.lean(compare), "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok"))
        ok = common.stored(ok, "gram-verdicts")
        common.discard(once, found)
        work.extend((pairs, ok))
        return pairs, ok

    def failures(pairs: DataFrame, ok: DataFrame) -> DataFrame:
        """The lists in which a pair that passed the bounds is no link."""
        return pairs.join(ok.where("not ok"), ["a", "b"], "left_semi").select(F.col("of").alias("list")).distinct()

    def rooted(members: DataFrame, links: DataFrame) -> DataFrame:
        """Members of the lists that hold more than one component as yet, each with its root."""
        m = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        m = common.stored(m, "gram-rooted")
        work.append(m)
        open_ = m.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
        m = common.stored(m.join(open_, "list", "left_semi"), "gram-open")
        work.append(m)
        return m

    # lists of about one length that overlap, as those of a group of near copies do, are one list where that asks for fewer comparisons: then each node is sent once,
    # not with each of its lists. Short lists would tie the long ones together
    size = member.groupBy("list").agg(F.count("*").alias("c"), F.min("node").alias("low"))
    at = lambda c: F.xxhash64(F.floor(F.log2("c") / 2), c)
    sized = common.stored(member.join(size, "list").withColumns({"at": at("node"), "low": at("low")}), "gram-sized")
    met = components(sized.where("low <> at").select(F.col("low").alias("a"), F.col("at").alias("b"))).toDF("at", "group")
    grouped = common.stored(sized.join(met, "at"), "gram-grouped")
    work += [sized, grouped]
    sized = grouped
    cost = sized.groupBy("group").agg(F.sum(F.col("c").cast("double")).alias("cost"), F.approx_count_distinct("node", 0.02).cast("double").alias("n"))
    near = common.stored(cost.where(f"n <= {FEW} or n * n <= cost").select("group"), "gram-groups")
    near_ = common.checked_broadcast(near, 8)
    grouped = sized.join(near_, "group", "left_semi").select(F.xxhash64("group").alias("list"), "node").distinct()
    others = sized.join(near_, "group", "left_anti")
    # of the other lists each node's longest first: most copies are joined there, and lists that are joined need no second look
    longest = others.groupBy("node").agg(F.max_by("list", F.struct("c", "list")).alias("list")).select("list", "node")
    member = common.stored(grouped.withColumn("grouped", F.lit(True)).union(others.select("list", "node").withColumn("grouped", F.lit(False))), "gram-members")
    work.append(member)
    narrow = signed(member, NARROW)
    pairs, ok = verified(member.where("grouped").select("list", "node").union(longest).withColumn("root", F.col("node")), narrow, True)
    links = ok.where("ok").select("a", "b")
    failed = failures(pairs, ok).join(member.where("grouped").select("list").distinct(), "list", "left_semi")
    rest = member.where("not grouped").drop("grouped")
    if rest.limit(1).count():
        pairs, ok = verified(rooted(rest, links), narrow, True)
        links = links.union(ok.where("ok").select("a", "b"))
        failed = failed.union(failures(pairs, ok)).distinct()
    wide = None
    for spanning in (True, False):
        failed = common.stored(failed, "gram-failed")
        work.append(failed)
        if not failed.limit(1).count():
            break
        again = rooted(member.drop("grouped").join(failed, "list", "left_semi"), links)
        wide = signed(again, WIDE) if wide is None else wide
        pairs, ok = verified(again, wide, spanning)
        links = links.union(ok.where("ok").select("a", "b"))
        failed = failures(pairs, ok)
    common.discard(near)
    root = components(links).toDF("rep", "root")
    root = common.checked_broadcast(common.stored(root, "gram-roots"), 32)
    common.discard(*work)
    out = f.join(same.withColumnRenamed("rep", "cls"), ["s1", "s2"], "left")
    out = out.withColumn("rep", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")).otherwise(F.col("doc_id"))).join(root, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def components(links: DataFrame) -> DataFrame:
    return common.components(links.sparkSession, links)
