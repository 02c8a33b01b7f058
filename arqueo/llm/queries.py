"""The operators with production parameters on the given tables, and the same questions in SQL where SQL can ask them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.llm import (
    alignment, exact_dedup, fingerprint, katz, language, line_dedup, mixing, near_join, packing, pages, periodic, personal, url_rules,
)
from arqueo.llm.common import WORD, landed, read, text_of

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decide(read(spark, folder, "documents"))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), keep_ids=False)


def op4_katz_score(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(read(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(read(spark, folder, "pages"))


def op6_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_edited(read(spark, folder, "documents"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "source", mixing.words(text_of()).alias("size"))
    taken = mixing.mix(landed(docs), size=F.col("size"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op8_near_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.join_groups(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find(read(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE_KINDS))
    counts = [personal.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in personal.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(personal.joined(base).cast("binary"), 256).alias("base_sha256"),
                        personal.joined(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.clean(read(spark, folder, "documents").select("doc_id", "text"), report=True)


def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge(read(spark, folder, "pages").select("page_id", "url"), url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.compare(read(spark, folder, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Of every tenth document (by hash of the id) the words from one place on are replaced by repetitions of a few of them."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    split = docs.select("doc_id", "text", number.alias("h"), F.when((number % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all(
        F.col("text"), F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    placed = split.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn(
        "p", F.expr("1 + (n - a) div (3 + floor(h / 10) % 8)"))
    words = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.transform(
        F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.find(with_planted_runs(read(spark, folder, "documents")), keep_runs=False)


JOBS = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_katz_score": op4_katz_score,
    "op5_main_text": op5_main_text,
    "op6_fingerprint": op6_fingerprint,
    "op7_source_mix": op7_source_mix,
    "op8_near_join": op8_near_join,
    "op9_personal_data": op9_personal_data,
    "op10_line_dedup": op10_line_dedup,
    "op11_url_rules": op11_url_rules,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2 * source_size AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
l AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         CAST(cap AS DOUBLE) / weight AS level,
         row_number() OVER o AS rank, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
e AS (
  SELECT *, (total - CAST(filled AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS share FROM l),
f AS (
  SELECT *, (SELECT x.share FROM e x WHERE x.share <= x.level ORDER BY x.rank LIMIT 1) AS even FROM e),
t AS (
  SELECT source, source_size, CASE WHEN even IS NULL OR level < even THEN CAST(cap AS DOUBLE)
                                   ELSE least(weight * even, CAST(cap AS DOUBLE)) END AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) AS BIGINT) END AS taken
FROM p""",
    "op11_url_rules": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS n FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT u.n, r.*, row_number() OVER (PARTITION BY u.n ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f ON f.n = u.n AND f.place = 1""",
}
