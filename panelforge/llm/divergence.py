"""Audit of how sources of a language diverge: smoothed term probabilities, distances between sources, telling terms.

A language keeps the terms that enough of its documents hold. Every (lang, source) group, and each language as a
whole, gives each kept term a probability in billionths, with pseudo-counts, in whole numbers throughout.

Distances between groups come from postings, the groups that hold a term. Terms that neither group holds add one
constant each. What a group's own terms add against another group's empty ones depends on that other group by a single
number, so running sums over the group's distinct counts give it; only terms that both hold need their pair of postings.

The terms that tell a group from its language come from an upper-bound search: the terms of a group with equal count
are one bucket, with equal probability p, and its terms' least probability in the language bounds f = p - q from
above. Buckets are evaluated best bound first until they hold enough terms; the k-th value found so far then stops the
search, since buckets whose bound is strictly below it cannot hold any of the first k. Ties stay in. No bucket is sorted or
sent as a whole: ranks are cut within each partition before any shuffle.

Cases: a null lang, source or text reads as an empty one, and rows that repeat count each, as documents of their own;
groups without terms are in the audit, with uniform probabilities; without kept terms distances are 0 and there are
no terms; a language of one source has no distances; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import materialise

LEAST_DOCUMENTS = 30
PSEUDO = 5
UNIT = 1_000_000_000
TOP = 50
# ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lower-cased, on UTF-8
_TERMS = re.compile(rb"[a-z\x80-\xff]+").findall
_HELD = 300_000


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("df", pa.int64())])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term, sent on whenever ``_HELD`` terms are held."""

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, df) in held.items():
            m = len(count)
            whole = lambda values, m=m: pa.array(np.fromiter(values, np.int64, m))
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, m), pa.repeat(source, m), pa.array(list(count), pa.binary()), whole(count.values()), whole(map(df.__getitem__, count))], schema=_COUNTS)
        held.clear()

    held, size = defaultdict(lambda: (Counter(), Counter())), 0
    for batch in batches:
        for lang, source, raw in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            terms = _TERMS(raw.lower())
            if not terms:
                continue
            count, df = held[lang, source]
            size -= len(count)
            count.update(terms)
            df.update(set(terms))
            size += len(count)
            if size > _HELD:
                yield from out()
                size = 0
    yield from out()


def _p(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + PSEUDO) / (total + PSEUDO * kept)) of SQL expressions, exact at any size; null without kept terms."""
    above = f"cast({UNIT} as decimal(10,0)) * cast({count} + {PSEUDO} as decimal(20,0))"
    return F.expr(f"1 + ({above}) div cast(nullif({total} + {PSEUDO} * {kept}, 0) as decimal(20,0))")


def audit_tables(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Groups (with their totals and the probability of a term they lack) and postings (with p and q), written once."""
    blank = lambda c, kind: F.coalesce(docs[c].cast(kind), F.lit("").cast(kind)).alias(c)
    rows = docs.select(blank("lang", "string"), blank("source", "string"), blank("text", "string").cast("binary").alias("text"))
    counts = rows.mapInArrow(_count_terms, "lang string, source string, term binary, n long, df long")
    counts = materialise(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least_documents).drop("df")
    postings = materialise(counts.drop("df").join(kept, ["lang", "term"]), "postings")

    langs = postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("all_lang"), F.count("*").alias("kept"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "n_terms", "all_lang", "kept"]).withColumn("p0", _p("0L", "total", "kept"))
    groups = materialise(groups, "groups")
    # groups were written, so their size is known: a small table is broadcast by Spark's own limit, a large one is joined by sorting
    told = postings.join(groups.select("lang", "source", "total", "all_lang", "kept"), ["lang", "source"])
    told = told.select("lang", "source", "term", "n", _p("n", "total", "kept").alias("p"), _p("n_lang", "all_lang", "kept").alias("q"))
    return groups, materialise(told, "told")


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("p0").alias(f"p0_{name}"), F.col("n_terms").alias(f"n_{name}"))
    both = side("a").join(side("b").drop("n_b"), "lang").where("a <> b")  # the rows of the result

    # sum of |p - x| over the terms of a at x = p0 of b, by running sums over a's distinct probabilities and all x in order
    steps = postings.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("x")).agg(F.count("*").alias("n"))
    nothing = F.lit(None)
    points = steps.select("lang", "a", "x", "n", nothing.cast("string").alias("b"), nothing.cast("long").alias("p0_a"), nothing.cast("long").alias("n_a"))
    points = points.unionByName(both.select("lang", "a", F.col("p0_b").alias("x"), F.lit(0).cast("long").alias("n"), "b", "p0_a", "n_a"))
    group = W.partitionBy("lang", "a")
    upto = group.orderBy("x").rangeBetween(W.unboundedPreceding, 0)
    points = points.withColumn("nx", F.col("n") * F.coalesce("x", F.lit(0)))
    for c, w in (("n_low", upto), ("n_all", group)):
        points = points.withColumn(c, F.sum("n").over(w))
    for c, w in (("s_low", upto), ("s_all", group)):
        points = points.withColumn(c, F.sum("nx").over(w))
    one_side = F.expr("x * n_low - s_low + (s_all - s_low) - x * (n_all - n_low)")
    half = points.where("b is not null").select("lang", "a", "b", one_side.alias("value"), "p0_a", F.col("x").alias("p0_b"), "n_a")

    left = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"))
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"))
    zero = groups.select("lang", "source", "p0")
    left = left.join(zero.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0_a")), ["lang", "a"])
    right = right.join(zero.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0_b")), ["lang", "b"])
    shared = left.join(right, ["lang", "term"]).where("a < b")
    shared = shared.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(p_a - p_b) - abs(p_a - p0_b) - abs(p_b - p0_a) + abs(p0_a - p0_b)")).alias("value"))

    # each unordered pair once: both one-sided sums, the shared terms, and the terms that neither holds
    kept = groups.groupBy("lang").agg(F.first("kept").alias("kept"))
    least, most = F.least("a", "b"), F.greatest("a", "b")
    flat = half.select("lang", least.alias("a"), most.alias("b"), (F.col("value") - F.col("n_a") * F.abs(F.col("p0_a") - F.col("p0_b"))).alias("value"), F.abs(F.col("p0_a") - F.col("p0_b")).alias("apart"))
    flat = flat.unionByName(shared.withColumn("apart", F.lit(None).cast("long")))
    pairs = flat.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("apart").alias("apart")).join(kept, "lang")
    pairs = pairs.select("lang", "a", "b", F.coalesce(F.col("value") + F.col("kept") * F.col("apart"), F.lit(0)).alias("value"))
    return pairs.select("lang", F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])).alias("_e"), "value").select("lang", "_e.source", "_e.item", "value")


def telling_terms(postings: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the first ``top`` terms of every group, by upper bounds of buckets."""
    by = ["lang", "source"]
    buckets = postings.groupBy(*by, "n").agg(F.first("p").alias("p"), F.min("q").alias("least"), F.count("*").alias("size"))
    buckets = buckets.withColumn("bound", F.col("p") - F.col("least")).where("bound > 0")
    ahead = W.partitionBy(*by).orderBy(F.desc("bound"), "n").rowsBetween(W.unboundedPreceding, -1)
    buckets = materialise(buckets.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).select(*by, "n", "bound", "ahead"), "buckets")
    found = postings.withColumn("value", F.col("p") - F.col("q")).where("value > 0").select(*by, "n", "value", F.col("term").cast("string").alias("item"))
    best = W.partitionBy(*by).orderBy(F.desc("value"), "item")

    def evaluated(which: DataFrame) -> DataFrame:
        return found.join(which.select(*by, "n"), [*by, "n"]).drop("n").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    first = materialise(evaluated(buckets.where(F.col("ahead") < top)), "first-terms")
    kth = first.where(F.col("rank") == top).select(*by, F.col("value").alias("kth"))
    rest = buckets.where(F.col("ahead") >= top).join(kth, by, "left").where("kth is null or bound >= kth")
    more = evaluated(rest)
    return first.unionByName(more).drop("rank").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(*by, "item", "value", "rank")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    groups, postings = audit_tables(docs, least_documents)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(groups, postings).withColumn("rank", F.row_number().over(order))
    rows = [f.withColumn("part", F.lit(part)) for part, f in (("pair", pairs), ("term", telling_terms(postings, top)))]
    return rows[0].unionByName(rows[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
