import random
from collections import defaultdict

import brute
import corpus_pipeline as c


def test_stages_run_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in c.STAGES:
        out = c.common.stored(stage(spark, docs, sf), name)
        if name != c.STAGES[-1][0]:
            assert tuple(out.columns) == c.COLUMNS
        if name == "ngram_jaccard_join":
            assert 0 < out.count() < n
        docs = out
    assert docs.agg({"piece_tokens": "sum"}).first()[0] > 0


def test_one_row_of_repeated_rows_stays(spark):
    rng = random.Random(4)
    a, b, e, f = (" ".join(f"word{rng.randint(0, 9999)}" for _ in range(120)) for _ in range(4))
    rows = [(7, a), (7, a), (9, a), (None, b), (None, b), (3, e), (None, e + " end"), (4, f), (4, "another text of one id"), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = c.common.stored(c.near_duplicates(spark, docs, ""), "near")
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([(7, a), (None, b), (3, e), (4, f), (4, "another text of one id"), (5, None)], key=repr)
    left = c.repeated_passages(spark, near, "").collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([(7, a), (None, b), (3, e), (4, f), (4, "another text of one id")], key=repr)


def test_stages_against_brute_force(spark):
    """Near duplicates and repeated passages of sf0.001, and of an empty table, against brute force; a mix keeps its targets and a packing every word."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", c.F.lit(1))
    rows = {r.doc_id: r for r in docs.collect()}
    part = brute.jaccard_join([(i, r.text) for i, r in rows.items()], 5, 80)
    near = c.common.stored(c.near_duplicates(spark, docs, sf), "near")
    stay = sorted(i for i, (_, root) in part.items() if root == i)
    assert sorted(r.doc_id for r in near.collect()) == stay
    left = c.common.stored(c.repeated_passages(spark, near, sf), "left")
    want = {i: n for i, (n, gone, *_) in zip(stay, brute.suffix_dedup([rows[i].text for i in stay], 400)) if gone == 0 and brute.WORD.search(rows[i].text or "")}
    got = {r.doc_id: r.text for r in left.collect()}
    assert {i for i in want if got.get(i) != rows[i].text} == set() and all(len(got[i].encode()) < len(rows[i].text.encode()) for i in set(got) - set(want))
    size, taken = defaultdict(int), defaultdict(int)
    for i, t in got.items():
        size[rows[i].source] += len(brute.WORD.findall(t))
    mixed = c.common.stored(c.mixture(spark, left, sf), "mixed")
    for r in mixed.collect():
        taken[r.source] += len(brute.WORD.findall(r.text))
    longest = max(len(brute.WORD.findall(t)) for t in got.values())
    assert all(abs(taken[s] - t) <= longest for s, t in brute.targets(size).items())
    packed = c.packing_stage(spark, mixed, sf).collect()
    assert sum(r.piece_tokens for r in packed) == sum(taken.values())
    for _, stage in c.STAGES[1:]:
        assert stage(spark, left.limit(0), sf).count() == 0


def test_passages_of_over_50_words_go(spark):
    """Passages of 51 words that several documents share go whatever their bytes, spaces and case, and those of 50 words and under 400 bytes stay; sf0.001 against brute force."""
    rng = random.Random(8)
    some = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    p, q, r = some(51), some(50), some(51)
    rows = [(1, f"{some(70)} {p} {some(30)}"), (2, f"{some(20)}\n{p.replace(' ', '  ').upper()}\n{some(9)}"), (3, f"{q} {some(60)}"), (4, f"{some(60)} {q}"), (5, r), (6, f"é {r} {some(3)}"), (7, None), (None, some(200))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(c.STAGES)["suffix_array_dedup"]
    got = {x.doc_id: brute.WORD.findall(x.text) for x in stage(spark, docs, "").collect()}
    want = {d: brute.WORD.findall(t or "") for d, t in rows}
    want[1] = want[1][:70] + want[1][121:]
    want[2] = want[2][:20] + want[2][71:]
    want[6] = want[6][:1] + want[6][52:]
    assert got == {d: w for d, w in want.items() if w and d != 5}

    near = c.common.stored(c.near_duplicates(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ""), "near")
    texts = {x.doc_id: x.text for x in near.collect()}
    first = brute.suffix_dedup(list(texts.values()), 400)
    runs = {d: [tuple(w[i : i + 51]) for i in range(len(w) - 50)] for d, w in ((d, brute.WORD.findall(brute.lower(t or ""))) for d, t in texts.items())}
    count = brute.Counter(x for v in runs.values() for x in v)
    changed = {d for (d, v), x in zip(runs.items(), first) if x[1] or any(count[y] > 1 for y in v)}
    assert len(changed) > sum(x[1] > 0 for x in first)
    left = {x.doc_id: x.text for x in stage(spark, near, "").collect()}
    assert all((left.get(d) != t) == (d in changed) for d, t in texts.items() if brute.WORD.search(t or ""))


def test_stages_leave_little_on_disk(spark):
    """What is written to the shared folder while a stage runs is deleted but for what its result reads, and the shuffle files of stored frames go with them."""
    import os
    import time

    sf = "/root/testdata/sf0.001"
    root = c.common.shared_dir(spark).removeprefix("file://") + "/millrace"
    at = lambda: {x.rsplit("-", 1)[0]: x for x in set(os.listdir(root)) - before}
    c.common.stored(spark.range(3), "first")
    before = set(os.listdir(root))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c.near_duplicates(spark, docs, sf)
    assert "gram-features" not in at() and "numbered" in at()
    before = set(os.listdir(root))
    dict(c.STAGES)["suffix_array_dedup"](spark, docs, sf)
    assert set(at()) == {"text-marks"}

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    old = files()
    out = c.common.stored(spark.range(1000).groupBy((c.F.col("id") % 7).alias("k")).count().repartition(3, "k"), "shuffled")
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old and out.count() == 7
    assert spark.conf.get(c.common.SHUFFLES_GO, None) is None


def test_rows_that_perhaps_meet_a_key(spark):
    """No row with one of the keys is passed over, and few others are not, with one bitmap and with several, and with no keys."""
    rows = spark.range(60_000).select(c.F.unhex(c.F.md5(c.F.col("id").cast("string"))).alias("key"), "id")
    for n in (0, 500, 20_000):
        keys = c.common.stored(rows.where(c.F.col("id") < n).select("key"), "keys")
        got = {r.id: r.held for r in c.common.perhaps(rows, keys, "held").select("id", "held").collect()}
        assert len(got) == 60_000 and all(got[i] for i in range(n)) and sum(got.values()) - n < 0.15 * (60_000 - n)
