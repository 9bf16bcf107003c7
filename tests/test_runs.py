"""Sources, sinks, the result store, judges and settings."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from millrace import config
from millrace.functions import text as X
from millrace.operators import pools as P
from millrace.operators import scoring as S
from millrace.sources import sinks, store, tables


def test_settings_from_a_command_line():
    run = config.parsed(config.RankingRun, ["--domain", "pony", "--modes", "naive,grid", "--pool-size", "0", "--overwrite"])
    assert run.domains == ("pony",) and run.modes == ("naive", "grid") and run.overwrite and run.protocol == "full-corpus"
    assert run.model_name == "Qwen3-4B-Instruct-2507" and run.table_name == "table_pony_Qwen3-4B-Instruct-2507_8192_p0"
    assert len(config.RankingRun().domains) == 8 and config.RankingRun().protocol == "pooled100+goldinjected"
    assert config.parsed(config.LocalizationRun, ["--out_csv", "x.csv"]).out_csv == "x.csv"
    assert run.key("pony", "grid") != config.RankingRun().key("pony", "grid")


def test_http_judge_sends_its_settings_and_orders_answers():
    seen = []

    class Stub(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            choices = [{"index": i, "logprobs": {"top_logprobs": [{"Yes": -float(len(p)), " No": -1.0}]} if p != "none" else None} for i, p in enumerate(body["prompt"])]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": choices[::-1]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    judge = S.http_judge(f"http://127.0.0.1:{server.server_port}/", "a-model")
    got = judge(["a", "none", "abc"])
    server.shutdown()
    assert got == [{"Yes": -1.0, " No": -1.0}, {}, {"Yes": -3.0, " No": -1.0}]
    assert seen == [("/v1/completions", {"model": "a-model", "prompt": ["a", "none", "abc"], "max_tokens": 1, "logprobs": 20, "temperature": 1.0, "top_p": 1.0})]
    assert S.calibrated({" Yes": -0.5, "Yes": -0.7, "yes": -0.5}) == (" Yes", " No") and S.calibrated({}) == ("Yes", "No")
    assert S.calibrated({" Yes": -0.5, "Yes": -0.7}, valid=lambda v: v == "Yes") == ("Yes", "No")


def test_option_probes_skip_what_runs_out_of_memory(spark):
    def load():
        def judge(prompts):
            if any(len(p) > 5 for p in prompts):
                raise MemoryError
            return [{"A": -0.5, "B": -1.5} for _ in prompts]

        return judge

    rows = spark.createDataFrame([(1, "abc", 10), (2, "too long", 20), (3, "", 30)], "doc_id long, prompt string, n_tokens int")
    got = {r.doc_id: r.probe for r in S.option_probes(rows, S.skipping(S.local_judge(load)), 2).collect()}
    assert abs(got[1].prob - 0.7310585786) < 1e-9 and got[2].prob is None and got[2].calc_tflops is None and got[2].latency is None and got[3].calc_tflops > got[1].calc_tflops
    flat = spark.createDataFrame([(1, d, p.latency, p.calc_tflops) for d, p in got.items()], "item_id int, doc_id long, latency double, calc_tflops double")
    assert {r.doc_id: r.calc_tflops is None for r in S.grid_costs(flat).collect()} == {1: False, 2: True, 3: False}


def test_run_goes_on_from_what_is_stored(spark, tmp_path):
    queries, asked = spark.range(9).select(F.col("id").cast("string").alias("item_id")), []

    def score(part):
        asked.extend(sorted(r.item_id for r in part.collect()))
        return part.select("item_id", F.lit("d").alias("doc_id"), F.lit("naive").alias("mode"), F.col("item_id").cast("double").alias("score"), F.lit(1).alias("sent"), F.lit(2.0).alias("flops"), F.lit(False).alias("failed"))

    kept = store.Store(spark, f"file://{tmp_path}/runs", "k")
    kept.append(queries.where("item_id < 4"), score)
    # a batch that ended before it was marked does not count
    score(queries.where("item_id = 5")).withColumn("score", F.lit(99.0)).withColumn("batch", F.lit(7).cast("long")).write.mode("append").parquet(f"{kept.path}/scores")
    asked.clear()
    metrics = lambda s: s.agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    assert store.resumed(kept, queries, score, metrics, batches=2).collect() == [(9, 36.0)]
    assert sorted(asked) == ["4", "5", "6", "7", "8"]
    c = kept.counters().first()
    assert (c.queries, c.docs, c.calls, c.flops, c.fails) == (9, 9, 9, 18.0, 0) and c.latency > 0
    asked.clear()
    assert store.resumed(kept, queries, score, metrics).first().n == 9 and not asked
    store.resumed(kept, queries, score, metrics, overwrite=True)
    assert len(asked) == 9
    # what cannot be read counts as nothing
    broken = tmp_path / "runs" / "b" / "done"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    assert store.Store(spark, f"file://{tmp_path}/runs", "b").pending(queries).count() == 9


def test_sheets_and_reports(spark, tmp_path):
    t = spark.createDataFrame([("1", "Cell (1, 2)", 1.5), ("2", None, None), ("3", 'a "b", <c> & d\nnext', 2.5)], "query_id string, Rank_1 string, score double")
    sinks.excel(t, f"{tmp_path}/t.xlsx")
    sinks.csv(t, f"file://{tmp_path}/t.csv")
    want = [("1", "Cell (1, 2)", "1.5"), ("2", None, None), ("3", 'a "b", <c> & d\nnext', "2.5")]
    for name in ("t.xlsx", "t.csv"):
        got = tables.sheet(spark, f"{tmp_path}/{name}")
        assert got.columns == t.columns and [tuple(r) for r in got.collect()] == want
    with pytest.raises(FileNotFoundError, match="none.xlsx"):
        tables.sheet(spark, f"{tmp_path}/none.xlsx")
    assert sinks.markdown(t.limit(1)).splitlines() == ["| query_id | Rank_1 | score |", "| :--- | :--- | ---: |", "| 1 | Cell (1, 2) | 1.5 |"]
    assert sinks.averages(t) == "Avg score: 2.00"
    rows, seen = sinks.counted(spark.createDataFrame([(True, 1500), (False, 9), (True, 700)], "fits boolean, n_tokens int"))
    assert rows.count() == 3 and seen.get == {"sent": 2, "over": 1, "kilo_tokens": 2}


def test_corpus_and_examples(spark, tmp_path):
    spark.createDataFrame([("pony", 1, "old", 0), ("pony", 1, "new", 1), ("biology", 1, "b", 2), ("economics", 7, "e", 3)], "domain string, id long, content string, place int").write.parquet(f"{tmp_path}/c")
    got = tables.corpus(spark, f"{tmp_path}/c", ("pony", "biology"), "place")
    assert sorted(map(tuple, got.collect())) == [("biology", "1", "b"), ("pony", "1", "new")]
    spark.createDataFrame([("pony", 5, "q", [1, 9])], "domain string, id int, query string, gold_ids array<int>").write.parquet(f"{tmp_path}/e")
    e = tables.examples(spark, f"{tmp_path}/e")
    assert tuple(e.first()) == ("pony", "5", "q", None, ["1", "9"], None)
    assert [tuple(r) for r in P.resolved(e, got).collect()] == [("5", "1")]
    assert X.basename(F.lit("a/b/c")) is not None and spark.range(1).select(X.basename(F.lit("a/b/c"))).first()[0] == "c"


def test_pool_is_full_however_many_are_barred(spark):
    docs, items = spark.range(300).select(F.col("id").alias("doc_id")), spark.createDataFrame([(1,), (2,)], "item_id long")
    gold = spark.range(60).select(F.lit(1).cast("long").alias("item_id"), F.col("id").alias("doc_id"))
    own = spark.range(250).select(F.lit(2).cast("long").alias("item_id"), F.col("id").alias("doc_id"))
    p = P.injected(items, docs, gold, 80, own_excluded=own).groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("is_gold").alias("g"), F.min("doc_id").alias("least")).collect()
    assert {r.item_id: (r.n, r.g) for r in p} == {1: (80, 60), 2: (50, 0)} and [r.least for r in p if r.item_id == 2] == [250]


def test_golds_find_texts_at_word_edges(spark):
    docs = spark.createDataFrame([(1, "xx alpha beta gammaray"), (2, "alpha  beta gamma"), (3, "b"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "b"), (3, "ha beta ga"), (4, ""), (5, None), (6, "beta")], "item_id long, text string")
    assert sorted(map(tuple, P.golds(items, docs).collect())) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (6, 1), (6, 2)]
