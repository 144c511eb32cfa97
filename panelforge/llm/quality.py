"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between two multinomials.

Words and word pairs are hashed into a fixed number of buckets. One multinomial over the buckets is
counted over every document, the other over trusted documents (``labels.quality`` = 1). A document's
score is the mean over its n-grams of log(target / corpus); below the threshold it is rejected. The
target is smoothed towards the corpus by as many pseudo-counts as there are buckets, so that few labels
give scores near 0 and reject little. Everything is DataFrame functions; the driver gets one row a bucket.

Cases: a null or empty text has no words, fails the base rules and has score 0; null ids and repeated rows
each get a row; without labels every document that passes the base rules is kept; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.native import BLANK_CHARS, count_chars, hashed, total, words

SYMBOLS = "#*$%&|<>"
#: Trusted documents that the target is fitted on: so many of those labelled 1, by the hash of their id.
TARGET_DOCUMENTS = 20_000
BUCKETS = 10_000
#: Mean log ratio under which a document is rejected.
LEAST_SCORE = -0.07
WINDOW = 5


def _grams(words_: Column, buckets: int) -> Column:
    """Buckets of words and of pairs of neighbours; the last word's pair is with the end."""
    single = F.transform(words_, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.zip_with(words_, F.slice(words_, 2, F.greatest(F.size(words_) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, F.coalesce(b, F.lit(""))), F.lit(buckets)).cast("int"))
    return F.concat(single, pairs)


def bucket_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, target_documents: int = TARGET_DOCUMENTS) -> list[float]:
    """log(target / corpus) of each bucket."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(target_documents)  # bounded, so it may be broadcast
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), _grams(words(docs["text"]), buckets).alias("_grams"))
    rows = rows.join(F.broadcast(good), F.col("_id") == F.col("_good"), "left")
    counts = rows.select(F.col("_good").isNotNull().alias("_in"), F.explode_outer("_grams").alias("_bucket")).where("_bucket is not null")
    counts = counts.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_if("_in").alias("t"))
    both = counts.select("_bucket", "n", "t", F.sum("n").over(W.partitionBy()).alias("all_n"), F.sum("t").over(W.partitionBy()).alias("all_t"))
    p = F.col("n") / F.col("all_n")
    ratio = F.log((F.col("t") + buckets * p) / (F.col("all_t") + buckets) / p)
    out = [0.0] * buckets
    for bucket, r in both.select("_bucket", ratio).collect():  # at most one row a bucket
        out[bucket] = r
    return out


def measured(docs: DataFrame, ratios: list[float], least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` as one struct column ``_row``, with the contract's columns beside it."""
    buckets = len(ratios)
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # a constant
    w, h, g, s = (F.col(c) for c in ("_w", "_h", "_g", "_s"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("_text"), words(F.col("_row.text").cast("string")).alias("_w"))
    rows = rows.withColumn("_h", hashed(w)).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_g", F.when(F.size(h) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only texts with a repeated window pay for the sort of their windows
    placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct(g)) < F.size(g), placed))
    twice = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
    rows = rows.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    p = F.col("_p")
    covered = total(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")))
    rows = rows.select(
        "_row",
        F.monotonically_increasing_id().alias("_place"),
        F.col("_row.doc_id").cast("long").alias("doc_id"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANK_CHARS, "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.aggregate(_grams(w, buckets), F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1)).alias("_sum"),
    )
    # a filter is not moved below a column that is not deterministic; below, each array would be computed again for each of its uses
    rows = rows.withColumn("n_repeat_words", F.when(F.col("_place") >= 0, F.col("n_repeat_words")))
    rows = rows.withColumn("score", F.when((F.col("n_words") > 0) & (F.col("_place") >= 0), F.col("_sum") / (2 * F.col("n_words"))).otherwise(F.lit(0.0))).drop("_sum")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: the base measures, the score and the verdict."""
    return measured(docs, bucket_ratios(docs, labels)).drop("_row", "_place")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return measured(docs, bucket_ratios(docs, labels)).where("kept").select("_row.*")
