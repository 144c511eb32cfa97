"""Importance resampling towards a target distribution: hashed n-gram gains and Gumbel noise.

Every n-gram of words falls into one of a fixed number of buckets; a bucket's gain is the log of its share in the
target (the benchmark's texts) over its share in the corpus, both with one pseudo-count, in thousandths and rounded
down. A text's weight is the sum of its features' gains. A document's score is its weight and Gumbel noise that
follows from its id alone, and the highest scores are the sample.

Identical texts are collapsed first: the documents are grouped by their full text, features are computed once a
distinct text, the corpus counts take them times the number of copies, and so is the weight computed once. Weights
go back to the documents by the digest of the text, before the noise that each document has of its own. A text that
holds over a thousandth of all rows is joined by salted keys; there are fewer than a thousand of those, so their list
may be broadcast. Ranks come from one range partitioning and the partitions' counts.

Cases: a null text has no words, as an empty one; a text without words has weight 0; a document with a null id has no
noise, so no score and no rank, and is not among those that are drawn from, but its text counts in the corpus; rows
that repeat count each, and those with equal score and id follow one another in rank; an empty table gives no rows;
without a target every t is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import keyed_bytes, materialise

BUCKETS = 10_000
SEED = 2024
#: A text with over this share of all rows is dealt over ``SALTS`` tasks.
HOT_SHARE, SALTS = 1000, 64
# ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text with A-Z lower-cased, on its UTF-8
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_MEMO = 1_000_000


def _features(buckets: int, longest: int):
    """Sparse bucket counts of each text; runs of up to ``longest`` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for pdf in batches:
            n_words, at, counts = [], [], []
            for raw in pdf["text"]:
                words = _WORDS(raw.lower())
                grams = Counter(words)
                for n in range(2, longest + 1):
                    grams.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
                if len(known) + len(grams) > _MEMO:
                    known.clear()
                known.update((g, zlib.crc32(g) % buckets) for g in grams if g not in known)
                n_words.append(len(words))
                at.append(np.fromiter(map(known.__getitem__, grams), np.int32, len(grams)))
                counts.append(np.fromiter(grams.values(), np.int64, len(grams)))
            yield pd.DataFrame({"digest": pdf["digest"], "copies": pdf["copies"], "n_words": n_words, "at": at, "counts": counts})

    return run


def distinct_features(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """One row a distinct text: its digest, number of copies, words, and buckets with counts."""
    texts = keyed_bytes(docs).select(F.coalesce("text", F.lit(b"")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    schema = "digest binary, copies long, n_words long, at array<int>, counts array<long>"
    return texts.select(_digest(F.col("text")).alias("digest"), "copies", "text").mapInPandas(_features(buckets, longest), schema)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences by bucket over all copies; the driver gets one row a bucket."""
    cells = features.select("copies", F.explode(F.arrays_zip("at", "counts")).alias("cell"))
    rows = cells.groupBy("cell.at").agg(F.sum(F.col("copies") * F.col("cell.counts"))).collect()
    out = np.zeros(buckets, np.int64)
    for at, n in rows:
        out[at] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    all_s, all_t, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))) for s, t in zip(corpus.tolist(), target.tolist())]


def weighted_texts(features: DataFrame, gain: list[int]) -> DataFrame:
    """Digest, copies, words, features and weight of every distinct text."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")  # a constant, one value a bucket
    parts = F.zip_with("at", "counts", lambda a, n: F.element_at(table, a + 1) * n)
    zero = F.lit(0).cast("long")
    return features.select("digest", "copies", "n_words", F.aggregate("counts", zero, lambda a, n: a + n).alias("n_features"), F.aggregate(parts, zero, lambda a, x: a + x).alias("weight"))


def weights_of_documents(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The weight of each document, joined back by its text's digest; frequent texts by salted keys."""
    rows = keyed_bytes(docs).select("doc_id", _digest(F.coalesce("text", F.lit(b""))).alias("digest"), F.monotonically_increasing_id().alias("place"))
    total = texts.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") * HOT_SHARE > total
    often = texts.where(hot).select(F.col("digest").alias("often"))  # fewer than HOT_SHARE rows
    rows = rows.join(F.broadcast(often), F.col("digest") == F.col("often"), "left")
    rows = rows.withColumn("salt", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("place"), F.lit(SALTS))).otherwise(0).cast("int")).drop("often")
    dealt = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop("copies")
    return rows.join(dealt, ["digest", "salt"]).drop("digest", "salt")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and id; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Ranks of the ``percent`` highest scores among documents with a score and ``least_words`` words."""
    spark = scored.sparkSession
    fit = (F.col("score").isNotNull() & (F.col("n_words") >= least_words)).alias("fit")
    order = [F.desc("fit"), F.desc("score"), "doc_id", "place"]
    dealt = scored.select("*", fit).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the low 33 bits of this id count the rows of a partition
    rows = materialise(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("number")), "ranked")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("n_fit"))  # one row a partition
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.expr(f"{int(percent)} * sum(n_fit) over () div 100").alias("n_drawn"))
    place = F.col("base") + F.col("number") + 1
    rank = F.when(F.col("fit") & (place <= F.col("n_drawn")), place)
    return rows.join(F.broadcast(bases), "part").withColumn("rank", rank)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = BUCKETS, longest: int = 1, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """Every document with its features, weight, score and, where it is drawn, its rank."""
    features = materialise(distinct_features(docs, buckets, longest), "features")
    goal = distinct_features(target.select(F.lit(0).cast("long").alias("doc_id"), target["text"].alias("text")), buckets, longest)
    texts = materialise(weighted_texts(features, gains(bucket_counts(features, buckets), bucket_counts(goal, buckets))), "weights")
    scored = weights_of_documents(docs, texts).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The sample itself: documents that were drawn, with their own columns and ``sample_rank``."""
    ranks = resample(docs, target, **options).where("rank is not null").groupBy("doc_id").agg(F.min("rank").alias("sample_rank")).withColumnRenamed("doc_id", "_drawn_id")
    return docs.join(ranks, docs["doc_id"].cast("long") == ranks["_drawn_id"]).drop(ranks["_drawn_id"])
