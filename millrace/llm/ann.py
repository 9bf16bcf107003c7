"""Approximate nearest neighbours by inner product: inverted file of coarse centroids, product-quantised residuals, asymmetric tables, exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = assign(x, c)
        n = np.bincount(a, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest row of c by Euclidean distance, in blocks of rows."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def chain(c: np.ndarray, at: np.ndarray) -> list[int]:
    """The rows `at` of c in an order that keeps near ones together: halved along the direction of most spread, again and again."""
    if len(at) <= 2:
        return at.tolist()
    x = c[at] - c[at].mean(0)
    by = at[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
    return chain(c, by[: len(by) // 2]) + chain(c, by[len(by) // 2 :])


class Index:
    """Coarse centroids and residual codebooks, fitted on a bounded sample; `probes` lists at least are visited per query."""

    def __init__(self, sample: np.ndarray, rows: int, sub: int = 2, recall: float = 0.97, top: int = 20, held: int = 200, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.pad = -self.dim % sub
        self.sub = sub
        x = self.padded(sample)
        # the held-out part sets the number of probes: as many lists as hold the wanted share of its neighbours in the rest
        held = min(held, len(x) // 4)
        q, x = x[:held], x[held:]
        self.lists = int(np.clip(round(rows**0.5), 1, max(1, min(4096, len(x) // 8))))
        c = kmeans(x, self.lists, rng)
        self.centroids = c[chain(c, np.arange(len(c)))]
        a = assign(x, self.centroids)
        r = self.shape(x - self.centroids[a])[0].reshape(len(x), -1, sub)
        self.books = np.stack([kmeans(r[:, m], min(256, max(1, len(x))), rng, 6) for m in range(r.shape[1])])
        near = np.argsort(-(q @ x.T), 1)[:, :top]
        order = self.order(q)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.lists)[None], 1)
        need = np.sort(np.take_along_axis(rank, a[near], 1).ravel())
        self.probes = int(need[min(len(need) - 1, int(recall * len(need)))]) + 1 if len(need) else self.lists

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float32), ((0, 0), (0, self.pad)))

    def order(self, x: np.ndarray) -> np.ndarray:
        """The lists in order of their centroids' inner products with each (padded) row."""
        return np.argsort(-(x @ self.centroids.T), 1, kind="stable") if len(x) else np.zeros((0, self.lists), np.int64)

    @staticmethod
    def shape(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals of length 1, and their lengths: codes hold the direction, so that vectors close to their centroid are told apart as well as others."""
        size = np.sqrt((r * r).sum(1, dtype=np.float32))
        return r / np.where(size > 0, size, 1)[:, None], size

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The list and the code of each row: a byte a subspace, then the residual's length."""
        x = self.padded(x)
        a = assign(x, self.centroids)
        r, size = self.shape(x - self.centroids[a])
        r = r.reshape(len(x), -1, self.sub)
        codes = np.stack([assign(r[:, m], b) for m, b in enumerate(self.books)], 1).astype(np.uint8)
        return a, [c.tobytes() for c in np.concatenate([codes, size.astype(np.float32).view(np.uint8).reshape(len(x), 4)], 1)]

    def probed(self, q: np.ndarray, counts: np.ndarray, least: int, home: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries x lists) whether a query visits a list, and whether that list is one of its home lists: its first ones that hold `home` vectors.
        Visited: the first `probes` lists, and further ones until they hold `least` vectors."""
        order = self.order(self.padded(q))
        before = np.cumsum(counts[order], 1) - counts[order]
        seen, near = np.zeros(order.shape, bool), np.zeros(order.shape, bool)
        np.put_along_axis(seen, order, (np.arange(self.lists) < self.probes) | (before < least), 1)
        np.put_along_axis(near, order, before < home, 1)
        return seen, near & seen

    def search(self, q: np.ndarray, probe: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries x codes) scores by asymmetric tables, -inf where the code's list is not probed. probe: queries x lists; codes come in order of their lists."""
        q = self.padded(q)
        table = np.einsum("qms,mks->mqk", q.reshape(len(q), -1, self.sub), self.books)
        out = np.full((len(q), len(codes)), -np.inf, np.float32)
        at = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        for lo, hi in zip(at, [*at[1:], len(lists)]):
            rows = np.flatnonzero(probe[:, lists[lo]])
            if not len(rows):
                continue
            score = np.zeros((len(rows), hi - lo), np.float32)
            for m in range(len(self.books)):
                score += table[m][rows][:, codes[lo:hi, m]]
            size = np.ascontiguousarray(codes[lo:hi, -4:]).view(np.float32).T
            out[rows, lo:hi] = score * size + (q[rows] @ self.centroids[lists[lo]])[:, None]
        return out


def matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) with an id and a finite, non-zero vector of the table's most frequent dimension."""
    v = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    dim = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return common.stored(v.where(F.size("embedding") == (dim[0] if dim else 0)).distinct(), "vectors")


def layout(counts: np.ndarray, unit_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, units) of each list: neighbouring small lists share a unit of about unit_rows rows, larger lists have several of their own."""
    first, parts, unit, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, unit_rows
    for k, c in enumerate(counts):
        if c > room and room < unit_rows:
            unit, room = unit + 1, unit_rows
        first[k], parts[k] = unit, max(1, -(-int(c) // unit_rows))
        unit, room = (unit + parts[k], unit_rows) if parts[k] > 1 else (unit, room - c)
    return first, parts


BEST = "array<struct<d:float,v:bigint>>"


def neighbours(vectors: DataFrame, is_query, top: int = 20, keep: int = 80, fit_rows: int = 20_000, unit_rows: int = 2_048, slice_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which is_query holds, its top rows by inner product, its own id left out.

    The index is fitted on the fit_rows rows smallest by hash of id and holds every row. Its lists are laid out in units of about unit_rows rows; a larger
    list is split, so that many equal vectors never meet in one task. A query visits as many lists as held-out rows of the sample needed, and more until
    they hold `keep` others. It is searched in two rounds: first its nearest lists with 8 x keep rows, whose keep-th score is its bound, then the rest, from which
    only what reaches the bound comes back. Codes of a unit are held by a task and its queries stream past; a unit with over slice_rows queries is dealt
    out with a copy of its codes for each so many. The inner products of the best `keep` are taken on the original vectors in double precision; ties go to the
    smaller vec_id. Equal vectors are one entry; the ids of an entry are taken in order. Rows that usable() leaves out take no part; repeated rows count once, and of an id with several vectors each is a candidate and a query;
    of fewer candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    n = v.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal vectors are one entry of the index, so that many of them do not crowd out others; of each entry the ids that can be among the nearest stay
    same = Window.partitionBy("embedding")
    members = v.withColumn("n", F.row_number().over(same.orderBy("vec_id"))).where(F.col("n") <= top + 1).withColumn("entry", F.min("vec_id").over(same))
    members = common.stored(members, "vector-members")
    entries = members.where("n = 1").select("vec_id", "embedding")
    sample = entries.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(fit_rows).select("embedding").toArrow()
    index = Index(matrix(sample.column("embedding")), entries.count(), top=top)
    shared = spark.sparkContext.broadcast(index)  # its size is bounded: 4096 centroids and 256 codes a subspace

    def encode(batches):
        for b in batches:
            lists, codes = shared.value.encode(matrix(b.column("embedding")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(lists, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "list", "codes"])

    coded = common.stored(entries.mapInArrow(common.lean(encode), "vec_id long, list int, codes binary"), "vector-codes")
    counts = np.zeros(index.lists, np.int64)
    for k, c in coded.groupBy("list").count().collect():  # a row for each list
        counts[k] = c
    first, parts = layout(counts, unit_rows)
    places = spark.createDataFrame([(k, int(first[k]), int(parts[k])) for k in range(index.lists)], "list int, first long, parts long")
    laid = coded.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("unit"), F.col("vec_id").alias("id"), "list", F.col("codes").alias("data"))
    q = v.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    q = q.withColumn("query", F.xxhash64("query_id", "embedding"))

    def send(home: bool):
        def task(batches):
            for b in batches:
                x = matrix(b.column("embedding"))
                seen, near = shared.value.probed(x, counts, keep + 1, 8 * keep)
                to = seen & (near if home else ~near)
                bound = np.full(len(x), -np.inf, np.float32) if home else b.column("bound").to_numpy(zero_copy_only=False)
                out = [[], [], [], []]
                for i in range(len(x)):
                    ls = np.flatnonzero(to[i])
                    us = np.concatenate([np.arange(first[k], first[k] + parts[k]) for k in ls]) if len(ls) else np.zeros(0, np.int64)
                    own = np.repeat(ls, parts[ls])
                    for u in np.unique(us):
                        for c, y in zip(out, (u, i, own[us == u].tolist(), bound[i])):
                            c.append(y)
                rows = pa.array(out[1], pa.int64())
                data = pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()).take(rows)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), b.column("query").take(rows), b.column("query_id").take(rows), data, pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.float32())], names=["unit", "query", "id", "data", "probe", "bound"])

        return task

    def look(batches):
        held = None  # (unit, slice), lists, ids, codes
        for b in batches:
            at = b.column("at").to_pylist()
            cut = [i for i in range(len(at)) if i == 0 or at[i] != at[i - 1]]
            for lo, hi in zip(cut, [*cut[1:], len(at)]):
                t, key = b.slice(lo, hi - lo), (at[lo]["unit"], at[lo]["s"])
                if at[lo]["kind"] == 0:
                    if held is None or held[0] != key:
                        held = (key, [], [], [])
                    held[1].append(t.column("list").to_numpy()), held[2].append(t.column("id").to_numpy())
                    held[3].append(np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8).reshape(len(t), -1))
                    continue
                if held is None or held[0] != key:
                    continue
                if isinstance(held[1], list):
                    lists, ids, codes = (np.concatenate(x) for x in held[1:])
                    by = np.lexsort((ids, lists))
                    held = (key, lists[by], ids[by], codes[by])
                _, lists, ids, codes = held
                for i in range(0, len(t), 64):
                    part = t.slice(i, 64)
                    x = np.frombuffer(b"".join(part.column("data").to_pylist()), np.float32).reshape(len(part), -1)
                    probe = np.zeros((len(part), shared.value.lists), bool)
                    for k, ls in enumerate(part.column("probe").to_pylist()):
                        probe[k, ls] = True
                    score, bound = shared.value.search(x, probe, lists, codes), part.column("bound").to_numpy()
                    best = []
                    for k, row in enumerate(score):
                        least = bound[k]
                        if len(row) > keep:
                            least = max(least, np.partition(row, len(row) - keep)[len(row) - keep])
                        j = np.flatnonzero((row >= least) & (row > -np.inf))
                        j = j[np.lexsort((ids[j], -row[j]))[:keep]]
                        best.append([{"d": -float(row[y]), "v": int(ids[y])} for y in j])
                    some = np.flatnonzero([len(x) > 0 for x in best])
                    kind = pa.list_(pa.struct([("d", pa.float32()), ("v", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(some), pa.int64()), part.column("query").take(pa.array(some)), part.column("id").take(pa.array(some)), pa.array([best[k] for k in some], kind)], names=["unit", "query", "query_id", "best"])

    def round_of(queries: DataFrame, home: bool) -> DataFrame:
        """(unit, query, query_id, best) of the queries in the units that they visit in this round; stored."""
        routes = common.stored(queries.mapInArrow(common.lean(send(home)), "unit long, query long, id long, data binary, probe array<int>, bound float"), "vector-routes")
        n = common.stored(routes.groupBy("unit").agg(F.ceil(F.count("*") / slice_rows).alias("slices")), "vector-units")
        n = common.checked_broadcast(n, 24)
        none = F.lit(None)
        at = lambda kind: F.struct("unit", F.col("s").cast("int").alias("s"), F.lit(kind).alias("kind")).alias("at")
        left = laid.join(n, "unit").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        left = left.select("unit", "s", at(0), none.cast("long").alias("query"), "id", "list", "data", none.cast("array<int>").alias("probe"), none.cast("float").alias("bound"))
        right = routes.join(n, "unit").withColumn("s", F.pmod("query", "slices")).select("unit", "s", at(1), "query", "id", none.cast("int").alias("list"), "data", "probe", "bound")
        both = left.unionAll(right).repartition(common.task_count(spark), "unit", "s").drop("unit", "s").sortWithinPartitions("at", "list", "id")
        return common.stored(both.mapInArrow(common.lean(look), f"unit long, query long, query_id long, best {BEST}"), "vector-found")

    def merged(found: DataFrame) -> DataFrame:
        """(query, query_id, best): the keep best of all units, in two steps so that no group is long."""
        for by in ((F.pmod("unit", F.lit(32)).alias("unit"), "query", "query_id"), ("query", "query_id")):
            found = found.groupBy(*by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, keep).alias("best"))
        return found

    near = round_of(q, True)
    bound = merged(near).select("query", F.when(F.size("best") >= keep, -F.element_at("best", -1)["d"]).otherwise(F.lit(float("-inf")).cast("float")).alias("bound"))
    rest = q.join(bound, "query", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf")).cast("float")))
    found = merged(near.unionAll(round_of(rest, False))).select("query", "query_id", F.explode("best.v").alias("entry")).distinct()
    pairs = found.join(members, "entry").where("vec_id <> query_id").join(q.select("query", F.col("embedding").alias("q")), "query")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    out = pairs.select("query", "query_id", "vec_id", dot.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("query_id", "rank", "vec_id", "score")
