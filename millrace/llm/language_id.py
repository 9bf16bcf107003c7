"""Language identification by Bayesian evidence fusion: text likelihood, declared markup language, address suffix and host priors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LANGS = ("de", "en", "es", "fr")
#: The background class, for texts in any other language or in none.
OTHER = "other"
BUCKETS = 1 << 14
#: Added to each count of a language: low, so that unseen trigrams speak for the background even where the sample is small.
SMOOTH = 0.1
#: A weight is this many times a log probability, rounded: sums of integers do not depend on how rows are batched.
SCALE = 1000
#: Bytes of text looked at together.
STEP = 512 << 10
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hash bucket of each byte trigram, letters A-Z as a-z."""
    b = LOWER[data]
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return code >> np.uint32(18)


def chunks(col: pa.Array, step: int = STEP):
    """(first row, row bounds, bytes) for runs of rows of about `step` bytes in a string column; null is empty."""
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(off, off[at] + step, "right")) - 1)
        yield at, off[at : end + 1] - off[at], data[off[at] : off[end]]
        at = end


def score_texts(col: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of weights per row and language, trigrams per row) for whole texts."""
    sums, n = np.zeros((len(col), weights.shape[1]), np.int64), np.zeros(len(col), np.int64)
    for at, bounds, data in chunks(col):
        rows = slice(at, at + len(bounds) - 1)
        n[rows] = np.maximum(np.diff(bounds) - 2, 0)
        if len(data) < 3:
            continue
        idx = trigrams(data)
        lo = np.minimum(bounds[:-1], len(idx))
        hi = np.maximum(np.minimum(bounds[1:] - 2, len(idx)), lo)
        for k in range(weights.shape[1]):
            c = np.concatenate([[0], np.cumsum(weights[idx, k], dtype=np.int64)])
            sums[rows, k] = c[hi] - c[lo]
    return sums, n


def declared_language(c: Column, langs: tuple[str, ...]) -> Column:
    """A declared tag as one of langs, 'other' or 'none'."""
    x = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^\\s*([A-Za-z]*)", 1))
    return F.when(x == "", "none").when(x.isin(*langs), x).otherwise("other")


def fit(records: DataFrame, langs: tuple[str, ...] = LANGS, rows: int = 4_000) -> np.ndarray:
    """Naive-Bayes weights (BUCKETS x languages and the background) from a bounded sample of labelled records: the `rows` smallest by hash of id and text.

    The sample is cut by a hash value, so that texts are counted where they are read; a row per bucket and language reaches the driver.
    The background is half uniform and half the languages' pooled counts, flattened, so that the trigrams that languages share do not speak for one of them.
    """
    lab = records.select(declared_language(F.col("declared"), langs).alias("l"), "text", F.xxhash64("id", "text").alias("h")).where(F.col("l").isin(*langs) & (F.length("text") > 2))
    cut = lab.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    counts = np.full((BUCKETS, len(langs)), SMOOTH)
    if cut is not None:

        def task(batches):
            for b in common.slices(batches, "text"):
                col, names = b.column("text"), b.column("l").to_pylist()
                got = np.zeros((BUCKETS, len(langs)), np.int64)
                for at, bounds, data in chunks(col):
                    if len(data) < 3:
                        continue
                    idx = trigrams(data)
                    for i in range(len(bounds) - 1):
                        own = idx[bounds[i] : max(bounds[i], bounds[i + 1] - 2)]
                        got[:, langs.index(names[at + i])] += np.bincount(own, minlength=BUCKETS)
                b_, l_ = np.nonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(b_, pa.int64()), pa.array(l_, pa.int64()), pa.array(got[b_, l_], pa.int64())], names=["b", "l", "n"])

        for b, l, n in lab.where(F.col("h") <= cut).select("l", "text").mapInArrow(common.lean(task), "b long, l long, n long").groupBy("b", "l").agg(F.sum("n")).collect():  # noqa: E741
            counts[b, l] += n
    flat = ((counts - SMOOTH).sum(axis=1) + 1) ** 0.3
    background = (flat / flat.sum() + 1 / BUCKETS) / 2
    return np.round(SCALE * np.log(np.column_stack([counts / counts.sum(axis=0), background]))).astype(np.int32)


def scored(records: DataFrame, weights: np.ndarray, langs: tuple[str, ...] = LANGS, keep_text: bool = False) -> DataFrame:
    """records with lid_ll (weight sums per language and of the background) and lid_n (trigrams); text is dropped unless kept."""
    rest = [f for f in records.schema.fields if keep_text or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lid_ll array<bigint>, lid_n bigint"])
    names = [f.name for f in rest]

    def task(batches):
        for b in common.slices(batches, "text"):
            sums, n = score_texts(b.column("text"), weights)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * weights.shape[1], pa.int32()), pa.array(sums.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), ll, pa.array(n, pa.int64())], names=[*names, "lid_ll", "lid_n"])

    return records.mapInArrow(common.lean(task), schema)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a dotted host; none for a host without a dot."""
    return F.regexp_extract(host, r"\.([^.]*)$", 1)


def domain_of(host: Column) -> Column:
    """The last two labels, or the whole host where it has one."""
    return F.regexp_extract(host, r"([^.]*\.[^.]*|^[^.]*)$", 1)


def fuse(s: DataFrame, langs: tuple[str, ...] = LANGS, evidence: int = 50, kappa: float = 20.0, alpha: float = 0.5, least: float = 0.5, votes: DataFrame | None = None) -> DataFrame:
    """s (declared, host, lid_ll, lid_n, ...) with lid_lang, lid_p, lid_kept.

    log posterior = text + declared + host prior. Text: the log likelihood, scaled down to at most `evidence` independent trigrams. Declared: P(tag | language),
    by grouped counts of tags against the text's best language, smoothed by alpha. Host prior: counts of the text's best language per host, smoothed
    towards its domain's, that towards its address suffix's and that towards all, kappa pseudo-documents each. Kept: some text, and
    a posterior of at least `least` for a language. The background is a class like the languages, but for its tags: mostly other or none, a hundredth
    for each language; where it wins, lid_lang is OTHER and the record is rejected. A null or empty host has only the prior of all; a text under three bytes votes for nothing and is rejected.
    """
    classes = (*langs, OTHER)
    n = len(classes)
    best = F.array_position("lid_ll", F.array_max("lid_ll")).cast("int")
    v = (votes if votes is not None else s).where("lid_n > 0").select("host", declared_language(F.col("declared"), langs).alias("d"), best.alias("k"))
    v = common.stored(v.groupBy("host", "d").agg(*[F.count_if(F.col("k") == i + 1).alias(f"c{i}") for i in range(n)]), "language-votes")
    cs = [f"c{i}" for i in range(n)]
    tags = [*langs, "other", "none"]
    seen = {r[0]: list(r[1:]) for r in v.groupBy("d").agg(*[F.sum(c) for c in cs]).collect()}  # a row for each tag
    total = [sum(x[i] for x in seen.values()) for i in range(n)]
    tag_ll = {d: [float(np.log((seen.get(d, [0] * n)[i] + alpha) / (total[i] + alpha * len(tags)))) for i in range(n)] for d in tags}
    for d in tags:
        tag_ll[d][-1] = float(np.log(0.01 if d in langs else (1 - 0.01 * len(langs)) / 2))
    top = [(x + 1.0) / (sum(total) + n) for x in total]
    by_host = v.groupBy("host").agg(*[F.sum(c).cast("double").alias(c) for c in cs]).where("host is not null and host <> ''").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})

    def smoothed(t: DataFrame, key: str, parent: str) -> DataFrame:
        size = sum((F.col(c) for c in cs), F.lit(0.0))
        return t.withColumn(key, F.array(*[(F.col(c) + kappa * F.get(F.col(parent), F.lit(i))) / (size + kappa) for i, c in enumerate(cs)]))

    sums = [F.sum(c).alias(c) for c in cs]
    suf = smoothed(by_host.groupBy("suffix").agg(*sums).withColumn("p0", F.array(*[F.lit(x) for x in top])), "p1", "p0").select("suffix", "p1")
    dom = smoothed(by_host.groupBy("suffix", "domain").agg(*sums).join(suf, "suffix"), "p2", "p1").select("suffix", "domain", "p2")
    prior = smoothed(by_host.join(dom, ["suffix", "domain"]), "p3", "p2").select("host", F.transform("p3", lambda x: F.ln(x)).alias("lid_prior"))
    prior = common.checked_broadcast(common.stored(prior, "language-priors"), 120)
    j = s.join(prior, "host", "left")
    d = F.create_map(*[x for t in tags for x in (F.lit(t), F.array(*[F.lit(y) for y in tag_ll[t]]))])
    none = F.array(*[F.lit(float(np.log(x))) for x in top])
    j = j.withColumns({"lid_tag": F.element_at(d, declared_language(F.col("declared"), langs)), "lid_prior": F.coalesce("lid_prior", none), "lid_scale": F.lit(1.0 / SCALE) * F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(F.col("lid_n"), F.lit(1)))})
    j = j.withColumn("lid_post", F.array(*[F.get("lid_ll", F.lit(i)) * F.col("lid_scale") + F.get("lid_tag", F.lit(i)) + F.get("lid_prior", F.lit(i)) for i in range(n)]))
    j = j.withColumn("lid_top", F.array_max("lid_post"))
    p = F.lit(1.0) / F.aggregate(F.transform("lid_post", lambda x: F.exp(x - F.col("lid_top"))), F.lit(0.0), lambda a, x: a + x)
    lang = F.element_at(F.array(*[F.lit(x) for x in classes]), F.array_position("lid_post", F.col("lid_top")).cast("int"))
    return j.withColumns({"lid_lang": lang, "lid_p": p}).withColumn("lid_kept", (F.col("lid_n") > 0) & (F.col("lid_p") >= least) & (F.col("lid_lang") != OTHER)).drop("lid_tag", "lid_prior", "lid_scale", "lid_post", "lid_top")


def identify(records: DataFrame, langs: tuple[str, ...] = LANGS, keep_text: bool = False, fit_rows: int = 4_000, **how) -> DataFrame:
    """records (id, text, declared, host and any further columns but lid_*) with lid_lang, lid_p, lid_kept; see fuse.

    With keep_text the text is scored twice, for the votes and for the verdicts, and never shuffled or stored; without it the scores are stored once.
    Null or empty texts are rejected, repeated rows judged alike, an empty table gives an empty result.
    """
    weights = fit(records, langs, fit_rows)
    if keep_text:
        votes = scored(records.select("text", "declared", "host"), weights, langs)
        return fuse(scored(records, weights, langs, True), langs, votes=votes, **how)
    return fuse(common.stored(scored(records, weights, langs), "language-scores"), langs, **how)
