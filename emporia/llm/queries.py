"""The registered corpus queries, each over its whole table, and the SQL twins of those SQL can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emporia.llm import (
    decontamination, filter_audit, language, lm_scoring, mixing, quality, sharding, simhash, spelling, token_counts, token_files,
    toxicity, url_filter,
)
from emporia.llm.common import documents, table
from emporia.sources.store import scratch_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    prints = documents(spark, folder).select("doc_id", simhash.fingerprint(F.col("text")).alias("_fp"))
    return simhash.classify(prints)


@query
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    return sharding.shard(documents(spark, folder)).select(*columns)


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.sized(documents(spark, folder, "doc_id", "text", "source")).drop("text")
    return mixing.mix_sized(rows).drop("source")


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(documents(spark, folder)).drop("text")


ORACLES["op2_quality"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS words, string_split(text, chr(10)) AS lines FROM d
), g AS (
  SELECT *, [l FOR l IN lines IF regexp_matches(l, '[^ \t-\r]')] AS full_lines,
         [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, len(words) - 1)] AS windows
  FROM w
), places AS (
  SELECT doc_id, unnest(windows) AS win, generate_subscripts(windows, 1) AS i FROM g
), again AS (
  SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1
), f AS (
  SELECT g.doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM g LEFT JOIN covered ON g.doc_id = covered.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND 10 * n_symbols <= n_words
       AND 100 * n_repeat_words <= 20 * n_words
       AND 10 * n_dup_lines <= 3 * len(lines)
       AND word_chars BETWEEN 2 * n_words AND 20 * n_words
       AND 10 * len([l FOR l IN lines IF regexp_matches(l, '(\.\.\.|…)[ \t]*$')]) <= 3 * len(lines)
       AND 10 * len([l FOR l IN lines IF regexp_matches(l, '^[ \t]*[-•]')]) <= 9 * len(lines)
       AND 10 * len([x FOR x IN words IF regexp_matches(x, '\p{L}')]) >= 7 * n_words
       AND 100 * len(list_distinct(words)) >= 5 * n_words AS kept
FROM b
"""

# Fixed values of the contract: the URL rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES_SCHEMA)
    return url_filter.judge_urls(table(spark, folder, "pages", "page_id", "url"), rules).drop("url")


ORACLES["op8_url_filter"] = r"""
WITH r(host, path, verdict) AS (VALUES """ + ", ".join(map(str, URL_RULES)) + r"""
), u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
)
SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
       coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY p.page_id, p.host, p.path
"""


@query
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark", "item_id", "text")
    return decontamination.overlaps(documents(spark, folder), items).drop("key")


def held_out():
    """True for the third of the rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = table(spark, folder, "labels", "doc_id", "toxic").where(~held_out())
    model = toxicity.train(docs, labels)
    return toxicity.scored(docs.withColumn("held_out", held_out()), model).drop("text")


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_path(spark)
    token_files.write_token_files(documents(spark, folder), files)
    return token_files.read_documents(spark, files, with_ids=False)


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder)).drop("text")


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness to the benchmark's texts, with all documents as the background."""
    docs = documents(spark, folder)
    return lm_scoring.score(docs, table(spark, folder, "benchmark", "text")).drop("text")


@query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, folder, "labels", "doc_id", "quality", "toxic"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words
  FROM documents
), k AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)
  } AS fails
  FROM d LEFT JOIN k ON d.doc_id = k.doc_id
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS letters FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT letters, array_to_string(letters, '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o
), t AS (
  SELECT *, fails[letters[step]] AS own, list_bool_or([false] || [fails[x] FOR x IN letters[:step - 1]]) AS earlier,
         len([x FOR x IN letters IF fails[x]]) AS n_fails
  FROM (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL) g, s
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letters[step] AS letter,
         CAST(coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (own AND earlier), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (own AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM t GROUP BY ALL
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder))


# DuckDB has no CRC-32: the table of bytes comes from the polynomial, and bytes from code points below 256.
ORACLES["op11_spelling"] = r"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS crc_of
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS raw
  FROM documents
), low AS (
  SELECT doc, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), bytes AS (
  SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END
                     FOR c IN string_split(doc || ':' || run, '')]) AS b
  FROM low
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, crc_of[xor(c, x) % 256 + 1]))) AS h
  FROM bytes, t
), noisy AS (
  SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, l, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(l)) AS i FROM v)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(other_n) AS best_n, min(other) FILTER (other_n = top) AS best
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word, n
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
         CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n
  FROM v LEFT JOIN best ON v.word = best.word
), chain AS (
  SELECT word, word AS at, form AS onward FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.onward
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM f JOIN chain c ON f.word = c.word AND c.onward IS NULL
"""


@query
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang")
    model = language.train(docs, F.col("doc_id").isNotNull() & ~held_out())
    return language.identified(docs.drop("lang").withColumn("held_out", held_out()), model).drop("text")
