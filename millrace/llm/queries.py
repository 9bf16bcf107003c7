"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, language_id, license_scan, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    folder = common.scratch(spark, "warc")
    files = warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    r = warc.read(spark, files)
    # a record that cannot be read ends the query: no page may be lost in silence
    ok = F.when(F.col("error").isNull(), page("record_id")).otherwise(F.raise_error(F.concat_ws(" ", "file", "offset", "error")).cast("long"))
    return r.select(ok.alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "block_ok", "payload_ok")


def op2_language_id(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    p = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z]+;", " ").alias("text"),
        F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1).alias("declared"), language_id.host_of(F.col("url")).alias("host"))
    out = language_id.identify(d.unionAll(p))
    return out.select("kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), F.col("lid_lang").alias("language"), F.round("lid_p", 6).alias("p"), F.col("lid_kept").alias("kept"))


def op3_token_counts(spark, sf_dir):
    out = token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("tok_n").alias("n_tokens"), F.col("tok_bytes").alias("n_bytes"), F.coalesce(F.size("tok_sections"), F.lit(0)).alias("n_sections"), F.get("tok_sections", F.lit(0)).cast("long").alias("first_section_tokens"), F.array_max("tok_sections").cast("long").alias("largest_section_tokens"), F.col("tok_crossing").alias("n_crossing"))


def op4_nearest_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, 85)


def op6_best_fit_packing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", common.n_words(F.col("text")).alias("size"))
    return packing.best_fit(d)


def op7_mixing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m = mixing.mix(d)
    m = m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"), F.get("mix_positions", F.lit(0)).alias("position"))
    return m.repartitionByRange(common.task_count(spark), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def op8_quality_rules(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    q = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ids)
    return q.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "score")])


def op9_license_scan(spark, sf_dir):
    # documents have no paths; these give every source a tree of languages and numbered folders, with a seventh of the files one level up
    d = table(spark, sf_dir, "documents")
    leaf = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 50).cast("string")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), leaf, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    s = license_scan.scan(d.select("doc_id", "text", path.alias("path")))
    return s.select("doc_id", "path", F.col("lic_own").alias("own_license"), F.col("lic_score").alias("score"), F.col("lic_is_file").alias("is_license_file"), F.col("lic_license").alias("license"), F.col("lic_inherited_from").alias("inherited_from"))


def op10_suffix_dedup(spark, sf_dir):
    d = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("sfx_n_bytes").alias("n_bytes"), F.col("sfx_n_removed").alias("n_removed"), F.size("sfx_spans").cast("long").alias("n_spans"), F.sha2("sfx_kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_warc": op1_warc, "op2_language_id": op2_language_id, "op3_token_counts": op3_token_counts, "op4_nearest_neighbours": op4_nearest_neighbours, "op5_ngram_join": op5_ngram_join, "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mixing": op7_mixing, "op8_quality_rules": op8_quality_rules, "op9_license_scan": op9_license_scan, "op10_suffix_dedup": op10_suffix_dedup,
}

_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))

ORACLES = {
    "op1_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) sha FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, n) first FROM p)
        SELECT page_id, n payload_bytes, {_B32} payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END refers_to,
        true block_ok, CASE WHEN page_id IS NOT DISTINCT FROM first THEN true END payload_ok FROM f""",
    "op7_mixing": r"""WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1), k AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] w, [0.6::DOUBLE, 0.0, -0.6][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] slope, source_size * 2.0::DOUBLE cap FROM s),
        l AS (SELECT *, cap / w level, coalesce(sum(cap) OVER o, 0) cb, coalesce(sum(w) OVER o, 0) wb FROM k WINDOW o AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        t AS (SELECT sum(source_size) * 1.5::DOUBLE budget, sum(w) tw FROM k), f AS (SELECT coalesce(sum(cap), 0) caps, coalesce(sum(w), 0) ws FROM l, t WHERE cb + level * (tw - wb) <= budget),
        g AS (SELECT source, source_size, slope, least(cap, (budget - caps) / CAST(tw - ws AS DOUBLE) * w) target FROM k, t, f),
        c AS (SELECT d.doc_id, size, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) c, floor(target + 0.5::DOUBLE) m FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        u AS (SELECT *, CASE WHEN c < m THEN least(size, m - c) ELSE 0 END + CASE WHEN c + source_size < m THEN least(size, m - c - source_size) ELSE 0 END taken, least(CAST(c AS DOUBLE) / greatest(target, 1.0::DOUBLE), 1.0::DOUBLE) u FROM c)
        SELECT doc_id, CAST(size AS BIGINT) size, source_size, target, CAST(taken AS BIGINT) taken, CASE WHEN c < m THEN CASE WHEN slope = 0 THEN u ELSE (sqrt((1-slope)*(1-slope) + 4*slope*u) - (1-slope)) / (2*slope) END END "position" FROM u""",
}
