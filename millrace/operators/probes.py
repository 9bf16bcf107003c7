"""Reading plans: a document as probes (doc_id, mode, kind, axis, text, n_tokens). Probes do not depend on queries and are made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MODES = ("naive", "firstp", "perchunk", "rows", "grid")


def chunk_list(text: Column, words: Column, size: int, stand_ins: bool = True) -> Column:
    """The non-blank chunks of a text in order; without any a stand-in, its first 200 characters or 'empty', or none without stand_ins."""
    if not stand_ins:
        return X.chunks(words, size)
    head = F.substring(F.coalesce(text, F.lit("")), 1, 200)
    return X.bound(X.chunks(words, size), lambda cs: F.when(F.size(cs) > 0, cs).otherwise(F.array(F.when(head != "", head).otherwise(F.lit("empty")))))


def chunked(docs: DataFrame, size: int = 100, tokens=X.words, stand_ins: bool = True) -> DataFrame:
    """doc_id, idx, chunk, n: the chunks of chunk_list. tokens: text -> array of tokens, white-space words by default."""
    d = docs.select("doc_id", chunk_list(F.col("text"), tokens(F.col("text")), size, stand_ins).alias("cs"))
    return d.select("doc_id", F.size("cs").alias("n"), F.posexplode("cs").alias("idx", "chunk"))


def square(n):
    return F.ceil(F.sqrt(n)).cast("int")


def lines(cs: Column, near_square: bool = False) -> tuple[Column, Column]:
    """The rows and the columns of the grid of a document's chunks, each an array of chunks. Cells stay virtual: row = idx div width, column = idx mod width."""
    n = F.size(cs)
    k = square(n)
    w = F.ceil(n / k).cast("int") if near_square else k
    rows = F.transform(F.sequence(F.lit(0), F.ceil(n / w).cast("int") - 1), lambda r: F.slice(cs, r * w + 1, w))
    cols = F.transform(F.sequence(F.lit(0), F.least(w, n) - 1), lambda c: F.transform(F.sequence(c, n - 1, w), lambda i: F.get(cs, i)))
    return rows, cols


def axes(docs: DataFrame, size: int = 100, near_square: bool = False, stand_ins: bool = True) -> DataFrame:
    """doc_id, kind, axis, cs (chunks): row and column probes of each document, made where its text is read. A text without words has none without stand_ins."""
    def both(cs):
        tagged = lambda xs, kind: F.transform(xs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("axis"), x.alias("cs")))
        rows, cols = lines(cs, near_square)
        made = F.concat(tagged(rows, "r"), tagged(cols, "c"))
        return made if stand_ins else F.when(F.size(cs) > 0, made)

    d = docs.select("doc_id", X.bound(chunk_list(F.col("text"), X.words(F.col("text")), size, stand_ins), both).alias("a"))
    return d.select("doc_id", F.inline("a"))


def all_probes(docs: DataFrame, size: int = 100, modes: tuple[str, ...] = MODES, tokens=X.words, stand_ins: bool = True) -> DataFrame:
    """doc_id, mode, kind, axis, text, n_tokens: the probes of every mode from one pass over a text, without a shuffle. tokens: text -> array of tokens.

    A text without tokens is read by its stand-in (chunk_list); without stand_ins it has its naive probe alone, of which a null text leaves text and n_tokens null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = lambda mode, kind, axis, t, n: F.struct(F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), axis.cast("int").alias("axis"), t.alias("text"), n.cast("int").alias("n_tokens"))

    def of_words(ws):
        # joined chunks are split at single spaces; a text without words has only its head
        count = lambda t: F.when(F.size(ws) > 0, F.size(F.split(t, " "))).otherwise(F.lit(0) if tokens is not X.words else X.n_words(t))

        def of_chunks(cs):
            axis = lambda mode, kind, xs: F.filter(F.transform(xs, lambda x, i: one(mode, kind, i, F.array_join(x, " "), count(F.array_join(x, " ")))), lambda p: F.trim(p["text"]) != "")
            rows, cols = lines(cs)
            plan = {
                "naive": lambda: F.array(one("naive", "r", F.lit(0), *((text, F.size(ws)) if stand_ins else (F.col("text"), F.when(F.col("text").isNotNull(), F.size(ws)))))),
                "firstp": lambda: F.array(one("firstp", "r", F.lit(0), F.get(cs, F.lit(0)), count(F.get(cs, F.lit(0))))),
                "perchunk": lambda: F.transform(cs, lambda c, i: one("perchunk", "r", i, c, count(c))),
                "rows": lambda: axis("rows", "r", rows),
                "grid": lambda: F.concat(axis("grid", "r", rows), axis("grid", "c", cols)),
            }
            made = F.concat(*[plan[m]() for m in modes])
            return made if stand_ins else F.filter(made, lambda p: (F.size(ws) > 0) | (p["mode"] == "naive"))

        return X.bound(chunk_list(text, ws, size), of_chunks)

    # the first chunk needs no words beyond it
    words = F.slice(F.filter(F.split(text, r"(?U)\s+", size + 2), lambda w: w != ""), 1, size) if tuple(modes) == ("firstp",) and tokens is X.words else tokens(text)
    return docs.select("doc_id", X.bound(words, of_words).alias("p")).select("doc_id", F.inline("p"))


def probes(docs: DataFrame, mode: str, size: int = 100, tokens=X.words) -> DataFrame:
    return all_probes(docs, size, (mode,), tokens)


def labelled(docs: DataFrame, size: int = 100, stand_ins: bool = True) -> DataFrame:
    """Near-square row and column probes whose chunks are numbered from 1 within the probe."""
    a = axes(docs, size, True, stand_ins)
    text = F.array_join(F.transform("cs", lambda x, i: F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit("]: "), x, F.lit("\n\n"))), "")
    return a.select("doc_id", "kind", "axis", text.alias("text"))
