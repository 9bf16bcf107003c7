from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import localize as L
from millrace.operators import probes as R


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_log_odds_cases(spark):
    def m(**kw):
        return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(float(v)))]) if kw else F.create_map().cast("map<string,double>")

    for given, want in (({}, -1e9), ({"Yes": -0.5, "No": -1.5, "x": -3}, 1.0), ({"Yes": -0.5, "x": -3}, 4.5), ({"No": -0.5, "x": -3}, -4.5), ({"x": -3}, -55.0)):
        assert one(spark, X.log_odds(m(**given), "Yes", "No")) == want


def test_length_buckets(spark):
    for n, want in ((0, "xs"), (1999, "xs"), (2000, "s"), (7999, "s"), (8000, "m"), (20000, "l"), (50000, "xl"), (100000, "xxl")):
        assert one(spark, X.length_bucket(F.lit(n))) == want


def test_coordinates(spark):
    for text, want in (("Cell (1, 2)", ["1,2"]), ("cell(3,4) (5,6)", ["3,4"]), ("(5,6)", ["5,6"]), ("N/A", []), ("", []), ("nan", []), (None, []), ("(01,2)", ["01,2"])):
        assert one(spark, X.coordinates(F.lit(text).cast("string"))) == want


def test_localization_cases(spark):
    truth = spark.createDataFrame([(str(i), "(1,1)", "(2,2)") for i in range(4)], "query_id string, cell_1 string, cell_2 string")
    preds = spark.createDataFrame([("0", "(1,1)", "(2,2)", "(9,9)", None), ("1", "(9,9)", "(1,1)", "(2,2)", None), ("2", "(9,9)", "(8,8)", "(7,7)", "(1,1)")], "query_id string, Rank_1 string, Rank_2 string, Rank_3 string, Rank_4 string")
    got = {r[0]: tuple(r)[1:] for r in L.metrics(L.ground_truth(truth), L.predictions(preds)).collect()}
    assert got == {"0": (100.0, 66.67, 83.33, 100.0, 87.5), "1": (50.0, 66.67, 50.0, 75.0, 60.42), "2": (0.0, 0.0, 0.0, 35.0, 8.75), "3": (0.0, 0.0, 0.0, 0.0, 0.0)}


def test_every_chunk_in_one_row_and_one_column(spark):
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (1, 2, 3, 5, 10, 50)], "doc_id long, text string")
    p = R.probes(docs, "grid", 1).groupBy("doc_id").agg(F.count_if(F.col("kind") == "r"), F.count_if(F.col("kind") == "c"), F.sum("n_tokens")).collect()
    assert {r[0]: tuple(r)[1:] for r in p} == {1: (1, 1, 2), 2: (1, 2, 4), 3: (2, 2, 6), 5: (2, 3, 10), 10: (3, 4, 20), 50: (7, 8, 100)}


def test_empty_document_keeps_a_probe(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [r.text for r in R.probes(docs, "rows").collect()] == ["empty", "empty"]
