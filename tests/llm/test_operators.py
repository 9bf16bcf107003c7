"""The operators against brute force on small fixtures with nulls, empties, ties, repeated rows and clashing column names."""

import functools
import hashlib
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, language_id, license_scan, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, warc

RNG = random.Random(3)
VOCAB = [f"word{i}" for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@functools.cache
def corpus():
    base, passage = prose(200), prose(90)
    rows = [(i, prose(120)) for i in range(20)] + [(20, None), (21, ""), (22, "  \n "), (23, "one two"), (24, "One  two"), (25, base), (26, base)]
    for i in range(12):
        w = base.split()
        w[i * 15] = "edited"
        rows.append((30 + i, " ".join(w)))
    rows += [(50 + i, prose(60) + "\n" + passage + "\n" + prose(60)) for i in range(4)]
    rows += [(60, "ab cd ef gh ij " * 300), (61, "é" * 900), (62, prose(6000))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, f"s{d % 4}" if d % 7 else None, "en") for d, t in corpus()], "doc_id long, text string, source string, n string")


def test_jaccard_join(spark, docs):
    for k, p in ((4, 85), (5, 80)):
        got = {r[0]: (r[1], r[2]) for r in ngram_join.join(docs, k, p).collect()}
        assert got == brute.jaccard_join(corpus(), k, p)


def test_jaccard_join_edges(spark, docs):
    assert ngram_join.join(docs.limit(0), 4, 85).count() == 0
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E")]
    got = sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()), key=repr)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]


def test_jaccard_join_repeats_long_lists(spark, monkeypatch):
    # documents 50 to 55 link only with 99; they pass the bitmap bound with many of 0 to 23 too, which link with 99 and are met first. Every list has more than BLOCK members
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    rng = random.Random(11)
    base = [f"base{i}" for i in range(300)]
    rows = []
    for d, n in ({i: 1 for i in range(24)} | {i: 6 for i in range(50, 56)} | {99: 0}).items():
        w, at = list(base), rng.randint(4, 20)
        for e in range(n):
            w[at + 45 * e] = f"edit{d}x{e}"
        rows.append((d, " ".join(w)))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.jaccard_join(rows, 4, 85) and {c for _, c in got.values()} == {0}


def test_jaccard_join_reads_lists_once(spark, monkeypatch):
    """A look at lists joins their members with the failed lists and with the open ones, once each, however often the members are read then."""
    rng = random.Random(12)
    rows = []
    for d in range(60):
        w = [f"base{i}" for i in range(300)]
        for e in range(rng.randint(1, 7)):
            w[rng.randint(0, 299)] = f"edit{d}x{e}"
        rows.append((d, " ".join(w)))
    held, stored = [], ngram_join.common.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "gram-rooted":
            held.append(out.count())
        return out

    monkeypatch.setattr(ngram_join.common, "stored", counted)
    seen = spark._jsparkSession.sharedState().statusStore()
    first = seen.executionsCount()
    got = {r[0]: (r[1], r[2]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.jaccard_join(rows, 4, 85)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made, ran = 0, seen.executionsList()
    for i in range(first, ran.size()):
        run = ran.apply(i).executionId()
        values, nodes = seen.executionMetrics(run), seen.planGraph(run).allNodes()
        for x in (nodes.apply(j) for j in range(nodes.size())):
            if re.search(r"Join \[list#\d+L?\], \[list#\d+L?\], LeftSemi", x.desc()):
                metrics = (x.metrics().apply(j) for j in range(x.metrics().size()))
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    assert held and 0 < made <= 2 * sum(held)


def test_signature_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, False), rng.integers(0, 1 << 63, x, dtype=np.uint64)])) for x in rng.integers(0, 60, 40)]
    sets.sort(key=len)
    tree = ngram_join.Tree(np.arange(40), np.array([len(s) for s in sets]), [ngram_join.bitmap(s) for s in sets], 85)
    found = set(tree.pairs(False))
    for i in range(40):
        for j in range(i + 1, 40):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                assert (i, j) in found


def test_suffix_dedup(spark, docs):
    got = {r.doc_id: (r.sfx_n_bytes, r.sfx_n_removed, len(r.sfx_spans), hashlib.sha256(bytes(r.sfx_kept)).hexdigest()) for r in suffix_dedup.dedup(docs).collect()}
    want = dict(zip([d for d, _ in corpus()], brute.suffix_dedup([t for _, t in corpus()], 400)))
    assert got == want
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_suffix_dedup_deals_out_hot_anchors(spark, monkeypatch):
    """Anchors with over HOT suffixes, texts over a step, null and repeated ids give what brute force gives."""
    rng = random.Random(11)
    passage, long = prose(120, rng), " ".join(prose(300, rng) for _ in range(140))
    texts = [prose(rng.randint(0, 60), rng) + " " + passage[rng.choice((0, 0, 50)) : rng.choice((None, None, 600))] + " " + prose(rng.randint(0, 60), rng) for _ in range(40)]
    texts += [passage, passage, long[:5000] + long, long[200_000:] + passage, "", None, texts[0], texts[3]]
    assert len(long) > suffix_dedup.STEP
    rows = [(None if i % 9 == 4 else i if i % 9 != 5 else i - 1, t) for i, t in enumerate(texts)]
    want = sorted(zip([d for d, _ in rows], brute.suffix_dedup(texts, 400)), key=repr)
    for hot in (suffix_dedup.HOT, 3):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, (r.sfx_n_bytes, r.sfx_n_removed, len(r.sfx_spans), hashlib.sha256(bytes(r.sfx_kept)).hexdigest())) for r in got), key=repr) == want


def test_merge_of_transforms():
    """Repeats from interleaved shard lists, against counting every string."""
    for seed in range(60):
        rng = random.Random(seed)
        length, gram = rng.choice((8, 12)), 3
        reach, bank = length - gram, [bytes(rng.choices(b"ab", k=30)) for _ in range(3)]
        rows = []
        for _ in range(rng.randint(1, 14)):
            x, g, p = bytearray(rng.choice(bank)), rng.randint(0, 2), rng.randint(0, 26)
            if rng.random() < 0.6:
                x[rng.randrange(30)] = ord("c")
            rows.append((g, rng.randint(0, 2), bytes([65 + g]) * gram + bytes(x[p : p + rng.choice((0, 2, reach))]), bytes(x[max(0, p - reach) : p])))
        rows.sort()  # by group and shard, each shard's in order
        seen = {}
        for i, (g, _, right, left) in enumerate(rows):
            for o in range(max(0, length - len(right)), min(len(left), reach) + 1):
                seen.setdefault((g, o, left[len(left) - o :], right[: length - o]), []).append((i, o))
        want = {x for v in seen.values() if len(v) > 1 for x in v}
        got = suffix_dedup.repeats(np.array([r[0] for r in rows]), [r[3] for r in rows], [r[2] for r in rows], np.zeros(len(rows), bool), length, 0, reach)
        assert {(int(i), o) for i, lo, hi in zip(*got) for o in range(lo, hi + 1)} == want


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r.mix_size
    want = brute.targets(size)
    for s, t in want.items():
        own = [r for r in rows if r.source == s]
        assert all(abs(r.mix_target - t) < 1e-6 and r.mix_taken <= 2 * r.mix_size for r in own)
        assert abs(sum(r.mix_taken for r in own) - t) <= 1
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.mix_taken, r.mix_positions)
    assert sorted(map(key, rows), key=repr) == sorted(map(key, again), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_keeps_clashing_columns(spark, docs):
    own = docs.select("doc_id", "text", "source", *[F.col("doc_id").alias(c) for c in ("target", "slope", "source_size", "size", "part", "cap", "w", "level", "skey", "at1", "one.two")])
    own = own.unionAll(own.where("doc_id is null or doc_id < 3")).unionAll(own.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(own).collect()
    assert len(rows) == own.count() and all(r.target == r.slope == r["one.two"] for r in rows)


def test_quality_features(spark, docs):
    labels = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    junk = spark.createDataFrame([(99, "\n".join(["a%% b$$ c d e f g h"] * 3)), (98, "x\ny\nx\n \n \n")], "doc_id long, text string")
    rows = quality.judge(docs.select("doc_id", "text").union(junk), labels).collect()
    for r in rows:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == brute.base_features(r.text)
        assert r.q_base_failed == (r.q_n_words < 20 or 100 * r.q_n_repeat_words > 30 * r.q_n_words) and not (r.q_base_failed and r.q_kept)
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 70000), (2, None, "x" * 70000), (3, "http://b/", None), (4, "u\r\nv", ""), (5, "http://c/", "é"), (None, "http://d/", "é"), (5, "http://c/", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.archive_pages(pages, f"file://{tmp_path}/w")
    got = warc.read(spark, files).collect()
    assert len(got) == 7 and all(r.block_ok and r.error is None and r.payload_ok is not False for r in got)
    kinds = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == sorted([("urn:page:1", "response", None, 70000), ("urn:page:2", "revisit", "urn:page:1", 70000), ("urn:page:3", "response", None, 0), ("urn:page:4", "revisit", "urn:page:3", 0),
                            ("urn:page:5", "response", None, 2), ("urn:page:5", "response", None, 2), ("urn:page:null", "revisit", "urn:page:5", 2)], key=repr)


def test_warc_damage():
    import io

    good = warc.record("urn:a", "response", "http://a", b"hello")
    out = list(warc.members(io.BytesIO(good + good[:-9]), 7))
    assert out[0][2] is None and out[1][2] is not None
    assert warc.parse(out[0][1].replace(b"hello", b"hellO"))["payload_ok"] is False
    assert warc.parse(out[0][1][:-6])["error"] is not None


def test_packing_fills_and_fits():
    sizes = [RNG.randint(1, 4096) for _ in range(500)]
    placed = packing.pack(sizes, (512, 1024, 2048, 4096))
    bins = {}
    for s, (b, cap, o) in zip(sizes, placed):
        bins.setdefault(b, []).append((o, s, cap))
    for own in bins.values():
        own.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[0][0] == 0
        assert own[-1][0] + own[-1][1] <= own[0][2] and (own[0][2] == 512 or own[-1][0] + own[-1][1] > own[0][2] // 2)
    assert sum(sizes) / sum(own[0][2] for own in bins.values()) > 0.95


def test_packing_fills_skewed_sizes():
    rng = random.Random(5)
    for lo, hi in ((520, 699), (270, 399)):
        sizes = [rng.randint(lo, hi) for _ in range(5000)]
        bins = {b: cap for b, cap, _ in packing.pack(sizes, (512, 1024, 2048, 4096))}
        assert sum(sizes) / sum(bins.values()) > 0.9


def test_packing_deals_repeated_rows_apart(spark):
    d = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("size"))
    got = packing.best_fit(d, group_rows=1000).withColumn("grp", F.substring_index("bin_id", "-", 1)).groupBy("grp").count().collect()
    assert len(got) == 4 and all(800 < r["count"] < 1200 for r in got)


def test_packing_is_least_of_all_openings():
    rng = random.Random(8)
    for costs in ((4.0, 8.0, 16.0), (6.0, 10.0, 18.0), (9.0, 10.0, 11.0)):
        sizes = [rng.randint(1, 16) for _ in range(12)]
        placed = packing.pack(sizes, (4, 8, 16), costs)
        paid = sum(dict(zip((4, 8, 16), costs))[c] for c in {b: c for b, c, _ in placed}.values())
        assert paid <= brute.best_fit_cost(sizes, (4, 8, 16), costs) + 1e-9


def test_packing_query_keeps_every_token(spark):
    d = spark.createDataFrame([(1, 9000), (2, None), (None, 5), (3, 0), (3, 0)], "doc_id long, size long")
    got = packing.best_fit(d).collect()
    assert sum(r.piece_tokens for r in got) == 9005 and len(got) == 7
    assert packing.best_fit(d.limit(0)).count() == 0


def test_token_attribution():
    ends, bounds = np.array([2, 5, 9]), np.array([3, 9])
    assert token_counts.attribute(ends, bounds, "start")[0].tolist() == [2, 1]
    assert token_counts.attribute(ends, bounds, "majority")[0].tolist() == [1, 2]
    assert token_counts.attribute(ends, bounds, "fraction")[0].round(3).tolist() == [1.333, 1.667]
    assert token_counts.attribute(ends, bounds)[1] == 1


def test_token_counts_sum_to_whole(spark, docs):
    for r in token_counts.count(docs).collect():
        assert sum(r.tok_sections or []) == r.tok_n


def test_neighbours_against_brute(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (None, [1.0] * 16), (703, [1.0] * 3)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(v, F.col("vec_id") % 20 == 0).collect()
    s = x.astype(float) @ x.astype(float).T
    hit = 0
    for q in range(0, 600, 20):
        order = [i for i in np.lexsort((np.arange(600), -s[q])) if i != q][:20]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert len(own) == 20 and all(abs(r.score - s[q, r.vec_id]) < 1e-9 for r in own)
        hit += len(set(order) & {r.vec_id for r in own})
    assert hit / 600 >= 0.9
    # fewer rows than asked for: every other one; repeated rows count once
    few = v.where("vec_id < 8").unionAll(v.where("vec_id = 3"))
    assert sorted(r.vec_id for r in ann.neighbours(few, F.col("vec_id") == 0).collect()) == list(range(1, 8))
    # many equal vectors, in lists larger than a unit, with queries in slices, do not crowd out others
    y = x.copy()
    y[50:500] = y[0]
    many = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "vec_id long, embedding array<float>")
    got, s, hit = ann.neighbours(many, F.col("vec_id") % 20 == 0, keep=25, unit_rows=64, slice_rows=8).collect(), y.astype(float) @ y.astype(float).T, 0
    for q in range(0, 600, 20):
        order = [i for i in np.lexsort((np.arange(600), -s[q])) if i != q][:20]
        hit += len(set(order) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 600 >= 0.9
    assert ann.neighbours(v.limit(0), F.lit(True)).count() == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = d.select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("declared"), F.col("source").alias("host"), F.col("lang").alias("truth"))
    extra = spark.createDataFrame([(-1, None, "en", None, "en"), (-2, "", None, "", "en")], r.schema)
    got = language_id.identify(r.union(extra)).collect()
    long = [x for x in got if x.lid_n > 60]
    assert sum(x.lid_lang == x.truth for x in long) / len(long) > 0.97
    assert not any(x.lid_kept for x in got if x.id < 0)
    assert language_id.identify(r.limit(0)).count() == 0


def test_language_id_rejects_other_languages_and_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    other = [
        "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência.",
        "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。",
        "4785380592391139 88 12 99381 77 0012 5550 1234 9876 4321",
        "### $$$ %%% &&& *** @@@ !!! ??? ~~~ ^^^ ### || || ++",
    ]
    extra = spark.createDataFrame([(-1 - i, t, tag, None) for i, t in enumerate(other) for tag in (None, "xx")], d.schema)
    got = language_id.identify(d.union(extra)).collect()
    assert not [(x.id, x.lid_lang, x.lid_p) for x in got if x.id < 0 and x.lid_kept]
    own = [x for x in got if x.id >= 0 and x.lid_n > 0]
    assert sum(x.lid_kept for x in own) / len(own) > 0.97


def test_license_scan(spark):
    each = [(k, t) for k, ts in license_scan.TEMPLATES.items() for t in ts]
    header = "\n".join("# " + x for x in ("Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software", "distributed under the License is distributed on an \"AS IS\" BASIS,", "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."))
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [
        (1, "some code\nReleased under the MIT License.\n" + "word " * 40, "a/b/x.txt"), (2, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"), (3, "nothing here", "a/b/c/y.txt"), (4, "nothing", "z/q.txt"), (5, None, "a/n.txt"),
        (6, "the the under", None), (3, "nothing here", "a/b/c/y.txt"), (7, "Copyright (c) 2020 Example Corp. All rights reserved.\n" + "int main " * 60, "m/a.c"), (8, mit, "t/LICENSE"), (9, "x = 1", "t/deep/er/f.py"), (10, "", "t/e.txt"), (11, "plain", None),
        (12, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance\n" + "y = 2\n" * 30, "h/one.py"), (13, "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + mit.replace(". ", ".\n"), "t2/COPYING"), (14, "q", "t2/x"), (15, "Redistribution and use in source and binary forms, with or without modification, are permitted.", "t/LICENSE.bsd"),
    ]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, path string, near int, `d.at` int")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0
    for (i, *_), (name, score) in zip(rows, brute.license_scores([r[1] for r in rows], each)):
        assert got[i].lic_own == name and (name is None or abs(got[i].lic_score - score) < 1e-8), i
    assert {i: (r.lic_license, r.lic_inherited_from) for i, r in got.items() if r.lic_own is None} == {
        3: ("Apache-2.0", "a"), 4: (None, None), 5: ("Apache-2.0", "a"), 6: (None, None), 9: (got[8].lic_license if got[8].lic_score >= got[15].lic_score else "BSD-3-Clause", "t"), 10: (got[9].lic_license, "t"), 11: (None, None), 14: ("MIT", "t2")}
    assert got[7].lic_own == "proprietary" and got[8].lic_own == "MIT" and got[12].lic_own == "Apache-2.0" and not got[1].lic_is_file
    # a header that only joined lines reach
    wide = spark.createDataFrame([(1, "import os\n\n" + header + "\n\n" + "def f(x):\n    return x\n" * 40, "p/f.py")] + [(i, "the file is for use with a copy", f"p/{i}") for i in range(2, 9)], "doc_id long, text string, path string")
    assert [r.lic_own for r in license_scan.scan(wide).where("doc_id = 1").collect()] == ["Apache-2.0"]


def test_anchor_windows():
    data = prose(400).encode()
    part, at, h = suffix_dedup.anchors([data], 400)
    for i in range(len(data) - 399):
        assert ((at >= i) & (at <= i + 300)).any()


def test_string_chunks_cover_all_rows():
    col = pa.array(["a" * 5, None, "", "b" * 3])
    assert [(at, bounds.tolist()) for at, bounds, _ in language_id.chunks(col)] == [(0, [0, 5, 5, 5, 8])]


def test_part_keys_are_shared_by_all_links():
    """Sets that link share a part's key, also where many parts are empty; passages that many sets share make no candidates of them."""
    rng = np.random.default_rng(5)
    for p in (50, 80, 85):
        for n in (5, 6, 7, 13, 40, 300):
            for _ in range(60):
                base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
                a = np.unique(base[:n])
                lost, more = rng.integers(0, n // 3 + 1, 2)
                b = np.unique(np.concatenate([a[: len(a) - lost], base[n : n + more]]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= p * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(ngram_join.part_keys(a, p), ngram_join.part_keys(b, p)))
    # hashes crowded in one sixteenth of their range: nearly all parts are empty
    for n in (40, 300):
        a = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[n // 14 :], rng.integers(0, 1 << 60, 2, dtype=np.uint64)]))
        assert len(np.intersect1d(ngram_join.part_keys(np.unique(a), 85), ngram_join.part_keys(b, 85)))
    passage = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2)
    keys = [ngram_join.part_keys(np.unique(np.concatenate([passage, rng.integers(0, 1 << 63, 210, dtype=np.uint64) * np.uint64(2)])), 85) for _ in range(60)]
    met = sum(len(np.intersect1d(keys[i], keys[j])) > 0 for i in range(60) for j in range(i))
    assert met < 0.3 * 60 * 59 / 2


def test_part_keys_of_unlike_sets_differ():
    """Sets without a gram in common share no key, whatever their sizes, though parts of them are empty; sets that just link share one at each size of a class."""
    rng = np.random.default_rng(6)
    some = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    keys = np.concatenate([ngram_join.part_keys(np.unique(some(n)), 80) for n in range(150, 450)])
    assert len(np.unique(keys)) == len(keys)
    for n in [x + y for x in ngram_join.CLASSES if 10 < x < 2000 for y in (-1, 0, 1, 2)]:
        a = np.unique(some(n))
        b = np.unique(np.concatenate([rng.choice(a, n - n // 9, False), some(n // 9)]))
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert len(np.intersect1d(ngram_join.part_keys(a, 80), ngram_join.part_keys(b, 80)))
