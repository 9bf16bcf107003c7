"""Token counts: whole documents are encoded once, and tokens are attributed to sections by their offsets."""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the usual pre-token pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "fraction")
OUT = "tok_n long, tok_bytes long, tok_sections array<double>, tok_crossing long"


class Encoder:
    """Encodes texts with a byte-level vocabulary file of ranks; spans are cumulated token byte lengths, so they tile the text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.length[v] = len(k)
        self.enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of the whole text end."""
        ids = self.enc.encode_ordinary(text)
        return np.cumsum(self.length[np.asarray(ids, np.int64)])


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """(tokens per section, tokens that cross a boundary). ends: token ends; bounds: section ends, ascending, the last one the text's end.

    start: a token counts for the section of its first byte. majority: for the one that holds most of its bytes, ties to the
    earlier. fraction: each section gets the share of the token's bytes that it holds.
    """
    out = np.zeros(len(bounds))
    if not len(ends):
        return out, 0
    starts = np.concatenate([[0], ends[:-1]])
    lo = np.searchsorted(bounds, starts, "right")
    hi = np.searchsorted(bounds, ends - 1, "right")
    cross = np.flatnonzero(lo != hi)
    same = lo if rule == "start" else np.delete(lo, cross)
    out += np.bincount(same, minlength=len(bounds))
    if rule != "start":
        for i in cross:
            ks = np.arange(lo[i], hi[i] + 1)
            edges = np.clip(np.concatenate([[starts[i]], bounds[ks]]), starts[i], ends[i])
            share = np.diff(edges)
            if rule == "fraction":
                out[ks] += share / (ends[i] - starts[i])
            else:
                out[ks[np.argmax(share)]] += 1
    return out, len(cross)


def count(docs: DataFrame, separator: str = "\n", rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with tok_n, tok_bytes, tok_sections (tokens of each section in order) and tok_crossing; text is dropped.

    Sections end after each separator; the separator belongs to the section before it. Null text has no sections and null
    tok_sections, empty text none. Rows are independent: nulls, repeated rows and further columns pass through.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), OUT])
    sep = separator.encode()

    def task(batches):
        enc = Encoder(vocabulary)
        for b in common.slices(batches, "text"):
            n, size, secs, cross = [], [], [], []
            for x in b.column("text"):
                t = x.as_py()
                if t is None:
                    n.append(0), size.append(0), secs.append(None), cross.append(0)
                    continue
                raw = t.encode()
                bounds = np.cumsum([len(p) + len(sep) for p in raw.split(sep)])
                bounds[-1] -= len(sep)
                if len(bounds) > 1 and bounds[-1] == bounds[-2] or not raw:
                    bounds = bounds[:-1]
                ends = enc.ends(t)
                got, c = attribute(ends, bounds, rule)
                n.append(len(ends)), size.append(len(raw)), secs.append(got), cross.append(c)
            cols = [b.column(f.name) for f in rest] + [pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(secs, pa.list_(pa.float64())), pa.array(cross, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in rest), "tok_n", "tok_bytes", "tok_sections", "tok_crossing"])

    return docs.select("text", *[F.col(f"`{f.name}`") for f in rest]).mapInArrow(task, schema)
