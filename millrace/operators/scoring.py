"""The judge boundary, the reduction of probe scores to document scores, ranking and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def lexical(cand: DataFrame, queries: DataFrame, probes: DataFrame) -> DataFrame:
    """cand (item_id, doc_id) x probes with k, the distinct words a probe shares with the item, and score, its log odds (six decimals).

    Probes are made once per document; words are compared only for candidate pairs, and only those of probes that fit (column fits, if any); others have null k and score.
    """
    low = lambda c: F.array_distinct(X.words(F.lower(c)))
    q = queries.select("item_id", low(F.col("text")).alias("qw"))
    p = probes.withColumn("pw", low(F.col("text"))).drop("text")
    fits = F.col("fits") if "fits" in probes.columns else F.lit(True)
    p = p.withColumn("pw", F.when(fits, F.col("pw")))
    j = cand.join(q, "item_id").join(p, "doc_id").withColumn("k", F.when(fits, F.size(F.array_intersect("qw", "pw"))))
    return j.withColumn("score", F.round(F.ln((F.col("k") + 0.5) / (F.size("qw") - F.col("k") + 0.5)), 6)).withColumn("n_query", F.size("qw")).drop("qw", "pw")


def judged(rows: DataFrame, judge: Callable[[list[str]], list[dict[str, float]]], batch: int = 512) -> DataFrame:
    """rows with top_logprobs map<string,double> from a judge of prompts (column prompt), called on batches; a judge error ends the task."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("top_logprobs", T.MapType(T.StringType(), T.DoubleType()))])

    def task(frames):
        for pdf in frames:
            got: list[dict[str, float]] = []
            for i in range(0, len(pdf), batch):
                got += judge(pdf["prompt"].iloc[i : i + batch].tolist())
            yield pdf.assign(top_logprobs=got)

    return rows.mapInPandas(task, schema)


def http_judge(server: str, model: str, timeout: float = 1800) -> Callable[[list[str]], list[dict[str, float]]]:
    """A judge behind a completions endpoint; answers come back in the order of their index, an answer without logprobs is an empty map."""

    def call(prompts: list[str]) -> list[dict[str, float]]:
        import json
        import urllib.request

        body = json.dumps({"model": model, "prompt": prompts, "max_tokens": 1, "logprobs": 20, "temperature": 1.0, "top_p": 1.0}).encode()
        req = urllib.request.Request(f"{server.rstrip('/')}/v1/completions", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            choices = sorted(json.load(r)["choices"], key=lambda c: c["index"])
        return [dict(((c.get("logprobs") or {}).get("top_logprobs") or [{}])[0] or {}) for c in choices]

    return call


#: The answers that a judge may give, in order of preference.
VARIANTS = (("Yes", "No"), (" Yes", " No"), ("YES", "NO"), ("yes", "no"))


def local_judge(load: Callable[[], Callable[[list[str]], list[dict[str, float]]]]) -> Callable[[list[str]], list[dict[str, float]]]:
    """A judge in the worker's own process: load() makes it at its first batch and it is kept for the next ones."""
    held: list = []

    def call(prompts: list[str]) -> list[dict[str, float]]:
        if not held:
            held.append(load())
        return held[0](prompts)

    return call


def skipping(judge: Callable, errors: tuple[type[BaseException], ...] = (MemoryError,)) -> Callable[[list[str]], list[dict[str, float] | None]]:
    """The judge, but a prompt that runs out of memory has a null answer instead of ending the task; the rest of its batch is asked one by one."""

    def call(prompts: list[str]) -> list[dict[str, float] | None]:
        try:
            return judge(prompts)
        except errors:
            return [None] if len(prompts) == 1 else [x for p in prompts for x in call([p])]

    return call


def calibrated(top: dict[str, float], variants: tuple[tuple[str, str], ...] = VARIANTS, valid: Callable[[str], bool] = lambda _: True) -> tuple[str, str]:
    """The answer pair whose yes is likeliest in a probe's answers, the first of equals and the first of all if none is there. valid: whether a
    variant is a single token of the model; those that are not are left out."""
    have = [(top[y], -i) for i, (y, _) in enumerate(variants) if y in top and valid(y)]
    return variants[-max(have)[1]] if have else variants[0]


def option_probes(rows: DataFrame, judge: Callable, batch: int = 512) -> DataFrame:
    """rows (prompt, n_tokens, ...) with probe struct<prob,latency,calc_tflops>: the option judge's P(A) against B, seconds of its batch per prompt, analytic cost.

    A null answer (see skipping) makes the probe's fields null.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("top_logprobs", T.MapType(T.StringType(), T.DoubleType())), T.StructField("latency", T.DoubleType())])

    def task(frames):
        import time

        for pdf in frames:
            got, took = [], []
            for i in range(0, len(pdf), batch):
                part, t = pdf["prompt"].iloc[i : i + batch].tolist(), time.time()
                got += judge(part)
                took += [(time.time() - t) / len(part)] * len(part)
            yield pdf.assign(top_logprobs=got, latency=took)

    top, none = F.col("top_logprobs"), F.lit(None).cast("double")
    at = lambda k: F.coalesce(F.try_element_at(top, F.lit(k)), F.lit(-1e9))
    asked = lambda c: F.when(top.isNotNull(), c).otherwise(none)
    probe = F.struct(asked(X.softmax_first(at("A"), at("B"))).alias("prob"), asked(F.col("latency")).alias("latency"), asked(X.forward_tflops(F.col("n_tokens"))).alias("calc_tflops"))
    return rows.mapInPandas(task, schema).withColumn("probe", probe).drop("top_logprobs", "latency")


def naive_guard(score: Column, n_tokens: Column, most: int | None = 32_000) -> Column:
    """The score, or null for a text of over `most` tokens; no limit if that is null."""
    return score if most is None else F.when(n_tokens <= most, score)


def grid_costs(probes: DataFrame) -> DataFrame:
    """(item_id, doc_id) with the sums of latency and cost over its probes (item_id, doc_id, latency, calc_tflops): null if any is."""
    total = lambda c: F.when(F.count_if(F.col(c).isNull()) == 0, F.sum(c)).alias(c)
    return probes.groupBy("item_id", "doc_id").agg(total("latency"), total("calc_tflops"))


def query_costs(docs: DataFrame) -> DataFrame:
    """item_id with naive_tflops, which leaves out nulls, and grid_tflops, which is null if any is."""
    return docs.groupBy("item_id").agg(F.coalesce(F.sum("naive_tflops"), F.lit(0.0)).alias("naive_tflops"), F.when(F.count_if(F.col("grid_tflops").isNull()) == 0, F.sum("grid_tflops")).alias("grid_tflops"))


def prompt_overhead(queries: DataFrame, tokens=X.words) -> int:
    """The median number of tokens of the prompt around an empty document, cut to an integer."""
    n = queries.agg(F.percentile(F.size(tokens(X.prompt(F.col("text"), F.lit("")))), F.lit(0.5))).first()[0]
    return int(n or 0)


def within_budget(scored: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    return scored.withColumn("fits", F.col("n_tokens") + overhead <= budget)


def reduce_axes(scored: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, doc_id, mode) with score: the best row probe, and for grid the best column probe added; an axis without evidence gives -1e9.

    Probes that do not fit are left out; a document none of whose probes fits keeps the sentinel. failed: its only probe (naive, firstp) did not fit.
    """
    fits = F.col("fits") if "fits" in scored.columns else F.lit(True)
    best = lambda kind: F.coalesce(F.max(F.when(fits & (F.col("kind") == kind), F.col("score"))), F.lit(X.NO_EVIDENCE))
    r = scored.groupBy("item_id", "doc_id", "mode", *extra).agg(best("r").alias("rm"), best("c").alias("cm"), F.count_if(fits).alias("sent"), F.sum(F.when(fits, X.call_flops(F.col("n_tokens")))).alias("flops"))
    score = F.when(F.col("sent") == 0, F.lit(X.NO_EVIDENCE)).otherwise(F.col("rm") + F.when(F.col("mode") == "grid", F.col("cm")).otherwise(F.lit(0.0)))
    return r.select("item_id", "doc_id", "mode", *extra, score.alias("score"), "sent", "flops", ((F.col("sent") == 0) & F.col("mode").isin("naive", "firstp")).alias("failed"))


def cells(chunks: DataFrame, axis_scores: DataFrame, top: int = 5) -> DataFrame:
    """(item_id, doc_id) with the sum of the best `top` products row x column over real cells, and how many. axis_scores: item_id, doc_id, kind, axis, p."""
    k = F.ceil(F.sqrt("n")).cast("int")
    w = F.ceil(F.col("n") / k).cast("int")
    c = chunks.select("doc_id", F.floor(F.col("idx") / w).cast("int").alias("row"), (F.col("idx") % w).cast("int").alias("col"))
    r = axis_scores.where("kind = 'r'").select("item_id", "doc_id", F.col("axis").alias("row"), F.col("p").alias("pr"))
    s = axis_scores.where("kind = 'c'").select("item_id", "doc_id", F.col("axis").alias("col"), F.col("p").alias("pc"))
    j = c.join(r, ["doc_id", "row"]).join(s, ["item_id", "doc_id", "col"]).withColumn("s", F.col("pr") * F.col("pc")).where("s is not null")
    w_ = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("s"), "row", "col")
    return j.withColumn("rn", F.row_number().over(w_)).where(F.col("rn") <= top).groupBy("item_id", "doc_id").agg(F.sum("s").alias("total"), F.count("*").alias("cells"))


def ranked(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """scores with is_gold, rank (score down, doc_id up) and rank0, the ascending place with golds first among equals."""
    s = scores.join(gold.select("item_id", "doc_id", F.lit(True).alias("is_gold")), ["item_id", "doc_id"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    by = ("item_id", "mode")
    return s.withColumns({
        "rank": F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("score"), "doc_id")),
        "rank0": F.row_number().over(Window.partitionBy(*by).orderBy(F.asc("score"), F.desc("is_gold"), "doc_id")) - 1,
    })


def query_metrics(r: DataFrame) -> DataFrame:
    """(item_id, mode) with n, n_gold, NDCG and recall at 5 and 10, and AUC; null AUC if golds or others are missing, 0 NDCG and recall without golds."""
    aggs = [F.count("*").alias("n"), F.count_if("is_gold").alias("n_gold"), F.sum(F.when(F.col("is_gold"), F.col("rank0"))).alias("rs"), F.count_if("failed").alias("fails"), F.sum("sent").alias("calls"), F.sum("flops").alias("flops")]
    for k in (5, 10):
        hit = F.col("is_gold") & (F.col("rank") <= k)
        aggs += [F.coalesce(F.sum(F.when(hit, F.lit(1.0) / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"dcg{k}"), F.count_if(hit).alias(f"hit{k}")]
    q = r.groupBy("item_id", "mode").agg(*aggs)
    cols = {}
    for k in (5, 10):
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1.0))
        cols[f"ndcg{k}"] = F.when(F.col("n_gold") > 0, F.round(F.col(f"dcg{k}") / ideal, 6)).otherwise(F.lit(0.0))
        cols[f"recall{k}"] = F.when(F.col("n_gold") > 0, F.round(F.col(f"hit{k}") / F.col("n_gold"), 6)).otherwise(F.lit(0.0))
    g, o = F.col("n_gold"), F.col("n") - F.col("n_gold")
    cols["auc"] = F.when((g > 0) & (o > 0), F.round((F.col("rs") - g * (g - 1) / 2) / (g * o), 6))
    return q.withColumns(cols).select("item_id", "mode", "n", "n_gold", "fails", "calls", "flops", *cols)


def metric_table(q: DataFrame, *by: str) -> DataFrame:
    """A row per mode (and further keys): quality means over items with golds, cost means over all items."""
    g = lambda c: F.round(F.avg(F.when(F.col("n_gold") > 0, F.col(c))), 4)
    return q.groupBy(*by, "mode").agg(
        F.round(100 * (1 - F.sum("fails") / F.greatest(F.sum("n"), F.lit(1))), 4).alias("success_pct"), F.round(F.sum("calls") / F.count("*"), 4).alias("calls"),
        F.round(F.sum("flops") / F.lit(1e12) / F.count("*"), 4).alias("tflops"), *[g(c).alias(c) for c in ("ndcg5", "recall5", "ndcg10", "recall10", "auc")])
