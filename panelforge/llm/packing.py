"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Every worker tokenises its documents, cuts each into pieces whose lengths sit in reciprocal-capacity
classes (1/1, 1/2, 1/3 ... of the capacity) and numbers its pieces within each class. A class with
slots of capacity/k takes exactly k pieces a sequence, so a sequence follows from a piece's number by
division: workers need only each other's counts by class, never each other's pieces. What the last
sequence of each class leaves over, fewer than k pieces a class however large the input, is packed
first-fit.

Cases: a null or empty text is one end token; a null ``doc_id`` stays null and its row is packed; rows
that repeat are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.bpe import encode_stream
from panelforge.llm.common import keyed_text, materialise

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, number long"


def slots(capacity: int) -> list[int]:
    """Slot lengths, longest first: capacity/k for k up to 32, then halves down to 1."""
    out = {capacity // k for k in range(1, 33) if capacity // k}
    s = min(out)
    while s > 1:
        s //= 2
        out.add(s)
    return sorted(out | {1}, reverse=True)


def cut_lengths(n: int, capacity: int, classes: list[int]) -> list[tuple[int, int]]:
    """(length, slot) of a document's pieces, in its order. A piece may leave 1/32 of its slot empty, no more."""
    out = [(capacity, capacity)] * (n // capacity)
    rest = n % capacity
    while rest:
        above = min(s for s in classes if s >= rest)
        if 32 * (above - rest) <= above:
            out.append((rest, above))
            break
        below = max(s for s in classes if s < rest)
        out.append((below, below))
        rest -= below
    return out


def _pieces(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes, part, number = slots(capacity), TaskContext.get().partitionId(), {}
        plans: dict[int, list[tuple[int, int]]] = {}
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode_stream(pdf["text"], tokenizer)):
                n, at = len(ids) // 4, 0
                if n not in plans and n < 65_536:
                    plans[n] = cut_lengths(n, capacity, classes)
                for length, slot in plans.get(n) or cut_lengths(n, capacity, classes):
                    k, raw = number.get(slot, 0), ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(raw), n, part, slot, k) + ((raw,) if with_ids else ()))
                    number[slot], at = k + 1, at + length
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")] + ["ids"] * with_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _first_fit(capacity: int):
    """The left-over pieces: a bounded number, since each class leaves fewer than fill one sequence."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "part", "class", "number"], ascending=[False, True, True, True], ignore_index=True)
        room: list[int] = []
        at = []
        for n in pdf["length"]:
            k = next((i for i, r in enumerate(room) if r >= n), len(room))
            if k == len(room):
                room.append(capacity)
            room[k] -= n
            at.append(k)
        pdf["bin"] = at
        pdf["slot"] = range(len(pdf))
        return pdf[["part", "class", "number", "bin", "slot"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document and where in which sequence; ``with_ids`` adds its ids."""
    schema = PIECE + (", ids binary" if with_ids else "")
    pieces = materialise(keyed_text(docs).mapInPandas(_pieces(tokenizer, capacity, with_ids), schema), "pieces")

    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("total")).withColumn("per", F.expr(f"{capacity} div class"))
    totals = totals.withColumn("full", F.expr("total div per"))
    ahead = W.orderBy(F.desc("class")).rowsBetween(W.unboundedPreceding, -1)  # over the classes, a fixed number
    totals = totals.withColumn("first", F.coalesce(F.sum("full").over(ahead), F.lit(0)))
    totals = totals.withColumn("after", F.sum("full").over(W.partitionBy()))
    starts = starts.join(totals.drop("total"), "class")

    placed = pieces.join(starts, ["class", "part"]).withColumn("index", F.col("base") + F.col("number"))
    whole = placed.where("index < full * per").withColumn("sequence_id", F.expr("first + index div per")).withColumn("slot", F.expr("index % per"))
    left = placed.where("index >= full * per")
    fitted = left.select("length", "part", "class", "number").groupBy().applyInPandas(_first_fit(capacity), "part int, class int, number long, bin long, slot long")
    rest = left.drop("slot").join(fitted, ["part", "class", "number"]).withColumn("sequence_id", F.col("after") + F.col("bin"))

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"] + (["ids"] if with_ids else [])
    both = whole.select(keep).unionByName(rest.select(keep))
    inside = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")
