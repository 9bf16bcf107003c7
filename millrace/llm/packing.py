"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import bisect
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUT = "doc_id long, piece int, piece_tokens long, bin_id string, bin_capacity int, bin_offset int"


def pack(sizes: list[int], capacities: tuple[int, ...], costs: tuple[float, ...] | None = None) -> list[tuple[int, int, int]]:
    """(bin, capacity, offset) for each size, none of them above the largest capacity.

    Best-fit decreasing, jointly over the permitted lengths: a piece goes to the open bin it leaves least room in. If none has room, a bin is opened at a
    length that depends on the smallest length that holds the piece; at the end each bin is downsized to the smallest permitted length that holds its contents.
    Every such choice of lengths is tried on all the pieces and the packing of least cost is taken, ties to the smaller lengths. Costs default to the lengths.
    """
    caps = sorted(capacities)
    cost = dict(zip(capacities, costs or [float(c) for c in capacities]))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    used = sorted({bisect.bisect_left(caps, s) for s in sizes})
    best = None
    for pick in itertools.product(*[caps[k:] for k in used]):
        opened = dict(zip(used, pick))
        bins, fill = trial(sizes, order, {caps[k]: c for k, c in opened.items()}, caps)
        size = [caps[bisect.bisect_left(caps, max(1, f))] for f in fill]
        total = sum(cost[c] for c in size)
        if best is None or total < best[0]:
            best = total, bins, size
    return [(b, best[2][b], o) for b, o in best[1]] if best else []


def trial(sizes: list[int], order: list[int], opened: dict[int, int], caps: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) for each size, fill of each bin) of best fit in the given order. opened: the length a bin is opened at, by the smallest that holds its first piece."""
    free: list[int] = []  # distinct room values of open bins, ascending
    at: dict[int, list[int]] = {}
    fill: list[int] = []
    placed = [(0, 0)] * len(sizes)
    for i in order:
        s = sizes[i]
        k = bisect.bisect_left(free, s)
        if k < len(free):
            room = free[k]
            b = at[room].pop()
            if not at[room]:
                del at[room]
                free.pop(k)
        else:
            room = opened[caps[bisect.bisect_left(caps, s)]]
            b = len(fill)
            fill.append(0)
        placed[i] = (b, fill[b])
        fill[b] += s
        if room - s:
            if room - s not in at:
                bisect.insort(free, room - s)
                at[room - s] = []
            at[room - s].append(b)
    return placed, fill


def best_fit(docs: DataFrame, size_col: str = "size", capacities: tuple[int, ...] = (512, 1024, 2048, 4096), costs: tuple[float, ...] | None = (576, 1088, 2112, 4160), group_rows: int = 20_000) -> DataFrame:
    """One row per piece of a document: doc_id, piece, piece_tokens, bin_id, bin_capacity, bin_offset.

    costs: of a sequence of each length; by default its tokens and 64 more for being a sequence, so that few long ones compete with many that fit closely.
    A document longer than the largest length is cut into pieces of that length and a rest; one of size null or 0 takes a piece of 0 tokens.
    Documents are dealt at random (by a hash of id, size and a draw) into groups of about group_rows, each packed by one task, so that a task's memory and the share of
    half-filled last bins stay the same at any scale. Null ids and repeated rows are packed like others; an empty table gives an empty result.
    """
    sized = common.stored(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")), "pack-sizes")
    groups = max(1, -(-sized.count() // group_rows))
    # a random draw, which is stored, deals apart the rows that repeat an id and size
    g = common.stored(sized.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", F.rand(7)), F.lit(groups)).cast("int")), "pack-groups")
    common.discard(sized)
    top = max(capacities)

    def task(t: pa.Table) -> pa.Table:
        grp = t.column("grp")[0].as_py()
        rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("size").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        pieces = [(d, k, min(top, n - k * top)) for d, n in rows for k in range(max(1, -(-n // top)))]
        where = pack([p[2] for p in pieces], capacities, costs)
        cols = [*zip(*pieces)], [*zip(*where)]
        return pa.table({
            "doc_id": pa.array(cols[0][0], pa.int64()), "piece": pa.array(cols[0][1], pa.int32()), "piece_tokens": pa.array(cols[0][2], pa.int64()),
            "bin_id": pa.array([f"{grp}-{b}" for b in cols[1][0]], pa.string()), "bin_capacity": pa.array(cols[1][1], pa.int32()), "bin_offset": pa.array(cols[1][2], pa.int32()),
        })

    return g.groupBy("grp").applyInArrow(task, OUT)
