"""The operators' registered queries: each applies one, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import crf, decontaminate, divergence, importance, packing, piecetable, quality, shinglejoin, suffixdedup, suffixtree, templates, tokenfiles, urlfilter
from panelforge.llm.common import fresh_path, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_path())


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removed(table(spark, sf_dir, "documents"))


def op8_seekable_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), folder, bpe_path())
    return tokenfiles.read(spark, folder).drop("shard")


def op3_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.similar_groups(table(spark, sf_dir, "documents"))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list for the tables, which have none: by the length of each host, one list adds it for 60 days, and
    hosts of even length have their English pages listed from March 2024 on."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).dropna().distinct().withColumn("n", F.length("host"))
    name = F.when(F.col("n") % 3 == 0, "ads").when(F.col("n") % 3 == 1, "malware").otherwise("spam")
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") * 7 % 180).cast("int"))
    key = F.concat(F.lit("h:"), F.col("host"))
    added = hosts.select(name.alias("list"), key.alias("key"), F.lit("add").alias("action"), first.alias("effective_at"))
    removed = hosts.select(name.alias("list"), key.alias("key"), F.lit("remove").alias("action"), F.date_add(first, 60).alias("effective_at"))
    paths = hosts.where("n % 2 = 0").select(F.lit("paths").alias("list"), F.concat(F.lit("p:"), F.col("host"), F.lit("/en")).alias("key"), F.lit("add").alias("action"), F.lit("2024-03-01").cast("date").alias("effective_at"))
    return added.unionByName(removed).unionByName(paths)


def op9_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # pages have no fetch time: a day of 2024 by their id stands for it
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")))
    return urlfilter.evaluate(captures, dated_entries(pages))


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS DATE) AS fetched_at,
         lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host, length(host) AS n FROM captures WHERE host IS NOT NULL),
intervals AS (
  SELECT CASE n % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'malware' ELSE 'spam' END AS list, 'h:' || host AS key,
         DATE '2024-01-01' + CAST(n * 7 % 180 AS INTEGER) AS valid_from, DATE '2024-01-01' + CAST(n * 7 % 180 + 60 AS INTEGER) AS valid_to
  FROM hosts
  UNION ALL
  SELECT 'paths', 'p:' || host || '/en', DATE '2024-03-01', NULL FROM hosts WHERE n % 2 = 0),
keyed AS (
  SELECT c.*, string_split(host, '.') AS parts, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM captures c),
keys AS (
  SELECT page_id, fetched_at, unnest(list_distinct(list_concat(
           list_transform(range(0, greatest(len(parts) - 1, 1)), lambda i: 'h:' || array_to_string(parts[i + 1:], '.')),
           list_transform(range(1, len(segments) + 1), lambda i: 'p:' || host || '/' || array_to_string(segments[1:i], '/'))))) AS key
  FROM keyed WHERE host IS NOT NULL),
judged AS (
  SELECT k.page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM keys k JOIN intervals v ON k.key = v.key AND v.valid_from <= k.fetched_at AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
  GROUP BY k.page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host, CAST(coalesce(j.n, 0) AS BIGINT) AS n_active, coalesce(j.lists, '') AS lists, coalesce(j.n, 0) > 0 AS blocked
FROM captures c LEFT JOIN judged j USING (page_id)
"""


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.identify(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
  SELECT 0 AS origin, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
split AS (
  SELECT row_number() OVER () AS r, origin, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
held AS (SELECT r, origin, word, count(*) AS n FROM (SELECT r, origin, unnest(words) AS word FROM split) GROUP BY ALL),
raw AS (
  SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM held)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM raw, crc),
counts AS (
  SELECT bucket, sum(n) FILTER (origin = 0) AS s, sum(n) FILTER (origin = 1) AS t FROM held JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * (sum(s) OVER () + 10000)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM counts),
weights AS (SELECT r, sum(n * gain) AS weight FROM held JOIN hashed USING (word) JOIN gains USING (bucket) WHERE origin = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (r) WHERE origin = 0),
ordered AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= 10 * n // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN ordered USING (r)
"""


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecetable.digests(table(spark, sf_dir, "documents"), piece_path())


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
held AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n_lang, sum(sum(n)) OVER (PARTITION BY lang) AS all_lang, count(*) OVER (PARTITION BY lang) AS v FROM held GROUP BY lang, term HAVING count(*) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, n_lang, all_lang, v
  FROM groups g JOIN kept k USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM held GROUP BY ALL) h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
p AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (n_lang + 5)) // (all_lang + 5 * v) AS BIGINT) AS q
  FROM cells),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op9_temporal_url_filter": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op13_source_divergence": OP13_SQL}
