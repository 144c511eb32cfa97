"""Removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``least`` bytes that covers it also starts somewhere else. The work is dealt by
content, so that no text need be compared with all others:

1. Blocks. The *anchor* of a string of ``least`` bytes is the leftmost smallest rolling hash in it, so equal
   strings have equal anchors at equal places. Neighbouring strings with one anchor form a block: its text
   runs from its first string's start to its last one's end. Blocks whose anchor occurs once in the corpus
   hold no repeated string. Blocks that occur twice repeat wholly, and one of each kind stands for all.
2. Shards. The different blocks of an anchor meet in a shard, which builds the suffix array of their text
   by Larsson-Sadakane refinement in numpy (ranks by prefix, doubled; only suffixes still tied are sorted
   again) and the common prefixes by Kasai's walk. Suffixes with ``least`` bytes in common repeat.
   An anchor with more blocks than ``SHARD_BLOCKS`` is dealt over several shards; each hands on its
   different strings as sorted digests, which a merge looks up in one another by binary search.
3. The repeated starts of each kind of block go back to the texts that have it, as runs. A kind that holds a
   thousandth of all blocks or more (so there are a thousand at most) has its copies dealt over ``SALTS`` tasks.

``without_repeats`` also takes a number of words: then a passage of so many words goes too if the same words stand somewhere else, whatever
its bytes are. Texts are coded for that, a word as ``CODE`` bytes of its hash, and the codes go through the same steps. Strings of
bytes are then judged only where they have fewer words inside: all others are found by their words.

Matches never cross documents and are judged on the input. Cases: null and empty texts have no bytes;
texts shorter than ``least`` lose none; null ids and repeated rows are documents like any other (two equal
rows repeat each other); an empty table gives no rows; other columns are ignored by ``removed`` and kept by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import exact, materialise, utf8_of, words_of
from panelforge.llm.shinglejoin import WordHashes

GRAM = 32
#: Blocks of one anchor that a shard takes.
SHARD_BLOCKS = 128
#: Bytes of text in one suffix array, about; an array takes under 2**21.
SHARD_BYTES = 500_000
#: Shards of one anchor for each range of digests in which they are merged.
SPAN_SHARDS = 16
#: Kinds of block with this share of all blocks are dealt over so many tasks.
HOT_SHARE = 1e-3
SALTS = 32
#: Bytes of a word's hash in a coded text.
CODE = 6
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MUL, _MUL2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes that are hashed at a time, so that the arrays stay in a core's cache.
_CHUNK = 1 << 17


def gram_hashes(x: np.ndarray, n: int, mul: int = _MUL) -> np.ndarray:
    """64-bit hashes of all substrings of n bytes: polynomials by doubling, then mixed."""
    v, have, out, size = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if n & have:
            if out is None:
                out, size = v, have
            else:
                k = len(x) - size - have + 1
                out = out[:k] * np.uint64(pow(mul, have, 1 << 64)) + v[size : size + k]
                size += have
        if size == n:
            break
        k = len(v) - have
        v, have = v[:k] * np.uint64(pow(mul, have, 1 << 64)) + v[have:], 2 * have
    h = out ^ (out >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchor_of(x: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of the string of ``least`` bytes at each place of ``x`` (under 2**24 bytes)."""
    h, w = gram_hashes(x, gram), least - gram + 1
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    v, have = key, 1
    while 2 * have <= w:
        v, have = np.minimum(v[: len(v) - have], v[have:]), 2 * have
    if w > have:
        v = np.minimum(v[: len(v) - (w - have)], v[w - have :])
    at = (v & np.uint64(0xFFFFFF)).astype(np.int64)
    return at, h[at]


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``x`` (under 2**21 symbols, 0 to 511) in the order of their first ``depth`` symbols at least.

    Larsson-Sadakane: the ranks by the first symbols are doubled. A suffix alone in its group has its
    rank for good; the groups with more are sorted again by the rank of what follows. A suffix's ranks and its
    place make one 64-bit number, so sorting needs no indirection.
    """
    n = len(x)
    if n >= 1 << 21:
        raise ValueError("a suffix array takes under 2**21 symbols")
    bits = np.uint64(21)
    place = np.uint64((1 << 21) - 1)
    padded = np.concatenate([x.astype(np.uint64), np.zeros(4, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(4):
        key = (key << np.uint64(9)) | padded[k : n + k]
    key = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    order = (key & place).astype(np.int64)
    k = key >> bits
    head = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.zeros(n + 1, np.uint64)  # the end has rank 0
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    h = 4
    while h < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        s = order[tied]
        key = np.sort((((rank[s] << bits) | rank[np.minimum(s + h, n)]) << bits) | s.astype(np.uint64))
        s, k = (key & place).astype(np.int64), key >> bits
        order[tied] = s
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head[tied] = new
        rank[s] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
        h *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix has in common with the one before it in ``order``.

    Kasai's walk in the order of the text: where a suffix and its neighbour both move on by one, their
    common prefix is shorter by one. So only the first of such a run is compared, all runs at once.
    """
    n, lcp = len(x), np.zeros(len(x), np.int64)
    if n < 2:
        return lcp
    above = np.full(n, -1, np.int64)
    above[order[1:]] = order[:-1]
    at = np.flatnonzero(above >= 0)
    to = above[at]
    moved = (at[1:] == at[:-1] + 1) & (to[1:] == to[:-1] + 1) & (x[at[:-1]] == x[to[:-1]])
    first = np.concatenate([[True], ~moved])
    a, b = at[first], to[first]
    length, todo, step = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(32)
    padded = np.concatenate([x.astype(np.int32), np.full(32, -1, np.int32)])
    while len(todo):
        i, j = a[todo] + length[todo], b[todo] + length[todo]
        same = padded[np.minimum(i, n)[:, None] + step] == padded[np.minimum(j, n)[:, None] + step]
        same[:, :] &= (np.maximum(i, j)[:, None] + step) < n
        got = np.where(same.all(1), 32, same.argmin(1))
        length[todo] += got
        todo = todo[got == 32]
    run = np.cumsum(first) - 1
    lcp[at] = length[run] - (at - a[run])
    return lcp[order]


def repeated_places(blocks: list[bytes], owned: list[int], least: int) -> list[np.ndarray]:
    """Of each block, which of its owned places start a string of ``least`` bytes that starts at another owned place too."""
    size = np.array([len(b) + 1 for b in blocks])
    start = np.cumsum(size) - size
    x = np.frombuffer(b"".join(b + b"\0" for b in blocks), np.uint8).astype(np.uint16) + 1
    x[start + size - 1] = 0  # closes a block
    order = suffix_array(x, least)
    group = np.cumsum(common_prefixes(x, order) < least)
    own = np.zeros(len(x) + 1, np.int32)
    np.add.at(own, start, 1)
    np.add.at(own, start + np.asarray(owned), -1)
    use = (np.cumsum(own)[:-1] > 0)[order]
    twice = np.zeros(len(x), bool)
    twice[order] = (np.bincount(group[use], minlength=int(group[-1]) + 1) > 1)[group]
    return [twice[s : s + n] for s, n in zip(start.tolist(), owned)]


def _runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Sorted places as the first and last of their runs."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist()


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _chunks(raw: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts that lie one after another, ``at`` their bounds, in pieces of about _CHUNK bytes, long ones cut with an overlap.

    Gives the bytes, and (text, place in it, place here, strings) of each part.
    """
    long = np.flatnonzero(np.diff(at) > _CHUNK)
    lo, last = 0, len(at) - 1
    for stop in [*long.tolist(), last]:
        while lo < stop:  # whole texts
            hi = min(stop, max(lo + 1, int(np.searchsorted(at, at[lo] + _CHUNK, side="right")) - 1))
            size = np.diff(at[lo : hi + 1])
            ok = np.flatnonzero(size >= least)
            if len(ok):
                here = at[lo:hi][ok] - at[lo]
                yield raw[at[lo] : at[hi]], np.stack([lo + ok, np.zeros_like(ok), here, size[ok] - least + 1], axis=1)
            lo = hi
        if stop < last:
            for k in range(0, int(at[stop + 1] - at[stop]) - least + 1, _CHUNK):
                piece = raw[at[stop] + k : min(at[stop] + k + _CHUNK + least - 1, at[stop + 1])]
                yield piece, np.array([[stop, k, 0, len(piece) - least + 1]])
            lo = stop + 1


def coded(raw: bytes | None, memo: WordHashes) -> bytes:
    """``CODE`` bytes for each word; A-Z count as a-z, and white space does not count."""
    words = words_of(raw)
    return np.fromiter(map(memo.__getitem__, words), "<u8", len(words)).view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes()


def _coded_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, with the codes of their texts one after another, and their bounds."""
    memo = WordHashes()
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            raw, at = utf8_of(batch.column("raw"))
            codes = [coded(raw[a:b].tobytes(), memo) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield batch, np.frombuffer(b"".join(codes), np.uint8), np.cumsum([0, *map(len, codes)])


def few_words(x: np.ndarray, places: np.ndarray, least: int, words: int) -> np.ndarray:
    """Which strings of ``least`` bytes have fewer words inside, white space on both sides of each within the string."""
    space = _SPACE[x]
    starts = np.zeros(len(x) + 1, np.int64)
    starts[2:] = np.cumsum(space[:-1] & ~space[1:])
    inside = starts[places + least] - starts[places + 1]
    return inside - ((inside > 0) & ~space[places + least - 1]) < words


def _blocks(least: int, words: int | None = None, code: bool = False):
    """A row for each block: its anchor's hash, a digest of its text, and where it starts in which text. With ``words`` blocks
    are of strings with fewer words inside alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, bounds in _coded_batches(batches) if code else ((b, *utf8_of(b.column("raw"))) for b in batches):
            doc_id, key = batch.column("doc_id"), batch.column("text_key")
            for x, parts in _chunks(raw, bounds, least):
                at, h = anchor_of(x, least)
                part = np.repeat(np.arange(len(parts)), parts[:, 3])
                p = np.arange(len(part)) - np.repeat(np.cumsum(parts[:, 3]) - parts[:, 3], parts[:, 3]) + parts[part, 2]
                if words is not None:
                    few = few_words(x, p, least, words)
                    part, p = part[few], p[few]
                    if not len(p):
                        continue
                a = at[p]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]) | (p[1:] != p[:-1] + 1)]))
                first, last = p[new], p[np.append(new[1:], len(p)) - 1]
                view, off = memoryview(x), (a[new] - first).tolist()
                digest = [
                    int.from_bytes(hashlib.blake2b(view[f : e + least], digest_size=8, salt=o.to_bytes(4, "little")).digest(), "little", signed=True)
                    for f, e, o in zip(first.tolist(), last.tolist(), off)
                ]
                text = pa.array(parts[part[new], 0])
                columns = {
                    "anchor": h[first].view(np.int64),
                    "block": np.array(digest, np.int64),
                    "doc_id": doc_id.take(text),
                    "text_key": key.take(text),
                    "first": (first - parts[part[new], 2] + parts[part[new], 1]).astype(np.int32),
                    "places": (last - first + 1).astype(np.int32),
                }
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))

    return run


def _cut_blocks(least: int, code: bool = False):
    """The bytes of the blocks that are asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        names = ["anchor", "block", "part", "parts", "places", "bytes"]
        for pdf in batches:
            out, size = [], 0
            for raw, asked in zip(pdf["raw"], pdf["asked"]):
                raw = coded(raw, memo) if code else raw
                for a in asked:
                    piece = raw[a["first"] : a["first"] + a["places"] - 1 + least]
                    out.append((a["anchor"], a["block"], a["part"], a["parts"], a["places"], piece))
                    size += len(piece)
                if size > 8_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    return run


SOLVED = "anchor long, block long, run_first array<int>, run_last array<int>, part int, span int, digests binary, owners binary, starts binary"


def _spans(parts: int) -> int:
    """Ranges of digests for an anchor of so many shards: a power of two."""
    return 1 << max(0, (parts - 1) // SPAN_SHARDS).bit_length()


def _digests(raw: bytes, places: int, least: int) -> np.ndarray:
    """128-bit digests of a block's strings, as two numbers each."""
    x = np.frombuffer(raw, np.uint8)
    out = np.empty(places, [("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = gram_hashes(x, least)[:places], gram_hashes(x, least, _MUL2)[:places]
    return out


def _shards(least: int):
    """Suffix arrays over whole groups of (anchor, part), by which the rows come sorted; several groups share an array."""

    def solve(held: list[tuple]) -> pd.DataFrame:
        out = []
        shared: dict[tuple[int, int], list[int]] = {}
        for i, (r, twice) in enumerate(zip(held, repeated_places([r[5] for r in held], [r[4] for r in held], least))):
            hit = np.flatnonzero(twice)
            if len(hit):
                out.append((r[0], r[1], *_runs(hit), r[2], None, None, None, None))
            if r[3] > 1:
                shared.setdefault((r[0], r[2]), []).append(i)
        for (anchor, part), own in shared.items():
            digests = np.concatenate([_digests(held[i][5], held[i][4], least) for i in own])
            owners = np.concatenate([np.full(held[i][4], held[i][1], np.int64) for i in own])
            starts = np.concatenate([np.arange(held[i][4], dtype=np.int32) for i in own])
            order = np.lexsort((digests["b"], digests["a"]))
            digests = digests[order]
            one = np.concatenate([[True], digests[1:] != digests[:-1]])  # one of equal strings stands for all
            digests, order = digests[one], order[one]
            owners, starts, spans = owners[order], starts[order], _spans(held[own[0]][3])
            span = (digests["a"] >> np.uint64(32)).astype(np.int64) * spans >> 32
            cut = np.searchsorted(span, np.arange(spans + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[k], cut[k + 1]
                out.append((anchor, None, None, None, part, k, digests[a:b].tobytes(), owners[a:b].tobytes(), starts[a:b].tobytes()))
        names = [c.split()[0] for c in SOLVED.split(", ")]
        res = pd.DataFrame(out, columns=names, dtype=object)
        return res.assign(**{c: exact(res[c].tolist()) for c in ("block", "part", "span")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, last, block = 0, None, None
        for pdf in batches:
            for r in pdf[["anchor", "block", "part", "parts", "places", "bytes"]].itertuples(index=False, name=None):
                if size > SHARD_BYTES and (r[0], r[2]) != last:
                    yield solve(held)
                    held, size = [], 0
                if (r[0], r[2]) == last and r[1] == block:  # the block of a repeated row, which repeats wholly
                    continue
                last, block = (r[0], r[2]), r[1]
                held.append(r)
                size += len(r[5])
        if held:
            yield solve(held)

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One anchor and range of digests: a part's strings that another part has too, by binary search in the sorted lists."""
    kind = np.dtype([("a", np.uint64), ("b", np.uint64)])
    lists = [np.frombuffer(b, kind) for b in pdf["digests"]]
    every = np.concatenate(lists)
    every = every[np.lexsort((every["b"], every["a"]))]
    again = np.unique(every[1:][every[1:] == every[:-1]])  # each list has a string once
    out = []
    for mine, owners, starts in zip(lists, pdf["owners"], pdf["starts"]):
        if not len(again):
            break
        # by the first number; the second decides among those with an equal first
        lo, hi = np.searchsorted(again["a"], mine["a"], side="left"), np.searchsorted(again["a"], mine["a"], side="right")
        hit = np.zeros(len(mine), bool)
        for k in range(int((hi - lo).max(initial=0))):
            at = np.minimum(lo + k, len(again) - 1)
            hit |= (lo + k < hi) & (again["b"][at] == mine["b"])
        owner, start = np.frombuffer(owners, np.int64)[hit], np.frombuffer(starts, np.int32)[hit]
        for o in np.unique(owner).tolist():
            out.append((pdf["anchor"].iloc[0], o, *_runs(np.sort(start[owner == o]))))
    return pd.DataFrame(out, columns=["anchor", "block", "run_first", "run_last"])


def repeated_runs(keyed: DataFrame, least: int, words: int | None = None, code: bool = False) -> DataFrame:
    """Of texts (doc_id, raw, text_key): doc_id, text_key and runs, the (first, last) start of repeated strings; of those with fewer
    ``words`` inside alone, or of the texts' codes."""
    schema = "anchor long, block long, doc_id long, text_key long, first int, places int"
    found = materialise(keyed.mapInArrow(_blocks(least, words, code), schema), "blocks")

    kinds = found.groupBy("anchor", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "first", "places")).alias("one"))
    more = kinds.groupBy("anchor").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds")).where("all_n > 1")
    kinds = materialise(kinds.join(more, "anchor").select("anchor", "block", "n", "kinds", "one"), "kinds")
    whole = kinds.where("n > 1").select("anchor", "block", F.array(F.lit(0)).alias("run_first"), F.array(F.col("one.places") - 1).alias("run_last"))

    # a block has under twice ``least`` bytes
    parts = F.ceil(F.col("kinds") / max(1, min(SHARD_BLOCKS, SHARD_BYTES // (2 * least)))).cast("int")
    different = kinds.where("kinds > 1").select("anchor", "block", "one.*", parts.alias("parts"), F.pmod(F.xxhash64("block"), parts).cast("int").alias("part"))
    asked = different.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "block", "part", "parts", "places", "first")).alias("asked"))
    texts = keyed.join(asked.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}), keyed["doc_id"].eqNullSafe(F.col("_d")) & (keyed["text_key"] == F.col("_k")))
    cut = texts.select("raw", "asked").mapInPandas(_cut_blocks(least, code), "anchor long, block long, part int, parts int, places int, bytes binary")
    dealt = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "block")
    solved = materialise(dealt.mapInPandas(_shards(least), SOLVED), "suffixes")
    inner = solved.where("span is null").select("anchor", "block", "run_first", "run_last")
    across = solved.where("span is not null").select("anchor", "span", "digests", "owners", "starts").groupBy("anchor", "span").applyInPandas(_merge, "anchor long, block long, run_first array<int>, run_last array<int>")

    runs = whole.unionByName(inner).unionByName(across)
    runs = runs.select("anchor", "block", F.explode(F.arrays_zip("run_first", "run_last")).alias("run"))
    least_n = max(2, math.ceil(HOT_SHARE * found.count()))
    hot = F.broadcast(kinds.where(F.col("n") >= least_n).select("anchor", "block", F.lit(SALTS).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    runs = runs.join(hot, ["anchor", "block"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    copies = found.join(hot, ["anchor", "block"], "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key", "first"), salts).cast("int")).drop("salts")
    hits = copies.join(runs, ["anchor", "block", "salt"]).select("doc_id", "text_key", F.struct((F.col("first") + F.col("run.run_first")).alias("a"), (F.col("first") + F.col("run.run_last")).alias("b")).alias("run"))
    # rows that repeat with their id have one set of runs
    return hits.groupBy("doc_id", "text_key").agg(F.collect_set("run").alias("runs"))


def _with_runs(rows: DataFrame, least: int, words: int | None = None) -> DataFrame:
    """``rows`` (_id, _text and others) with the repeated runs of their texts as ``_runs``, and of their codes as ``_word_runs``."""
    rows = rows.withColumn("_key", F.xxhash64("_text"))
    keyed = rows.select(F.col("_id").alias("doc_id"), F.col("_text").cast("binary").alias("raw"), F.col("_key").alias("text_key"))
    runs = repeated_runs(keyed, least, words).withColumn("word_runs", F.lit(None).cast("array<struct<a:int,b:int>>"))
    if words is not None:
        by_words = repeated_runs(keyed, words * CODE, code=True).withColumnRenamed("runs", "word_runs")
        runs = runs.unionByName(by_words, allowMissingColumns=True).groupBy("doc_id", "text_key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("runs", "word_runs")])
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), F.col("runs").alias("_runs"), F.col("word_runs").alias("_word_runs"))
    return rows.join(runs, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")


def removed_bytes(raw: bytes, runs, least: int) -> np.ndarray:
    """Which bytes go."""
    edge = np.zeros(len(raw) + 1, np.int32)
    if runs is not None and len(runs):
        np.add.at(edge, [r["a"] for r in runs], 1)
        np.add.at(edge, [r["b"] + least for r in runs], -1)
    return np.cumsum(edge)[:-1] > 0


def removed_words(raw: bytes, runs, words: int) -> np.ndarray:
    """Which bytes go with repeated words: theirs, and the white space up to the next word."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    gone = removed_bytes(bytes(CODE * len(spans)), runs, CODE * words).reshape(-1, CODE).all(1)
    out = np.zeros(len(raw), bool)
    for k in np.flatnonzero(gone).tolist():
        out[spans[k][0] : spans[k + 1][0] if k + 1 < len(spans) else spans[k][1]] = True
    return out


def kept_text(x: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes go."""
    lead = (x & 0xC0) != 0x80
    stays = np.maximum.reduceat(~gone, np.flatnonzero(lead))
    return x[stays[np.cumsum(lead) - 1]].tobytes().decode("utf-8", "surrogatepass")


def _cut(least: int):
    """What goes from texts with runs; rows without are null and stay so."""

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(text, runs):
            if r is None or not len(r):
                out.append((None, None, None, None))
                continue
            raw = _bytes(t)
            x, gone = np.frombuffer(raw, np.uint8), removed_bytes(raw, r, least)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(x[~gone].tobytes()).hexdigest(), kept_text(x, gone)))
        res = pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "kept_text"])
        return res.astype({"n_removed": "Int64", "n_spans": "Int64", "kept_sha256": object, "kept_text": object})

    # texts that lose nothing stay in the JVM
    return cut(F.when(F.col("_runs").isNotNull(), F.col("_text")), F.col("_runs"))


def removed(docs: DataFrame, least: int = 400) -> DataFrame:
    """One row a document: its bytes, those removed, their runs, the digest of what is left, and ``kept_text``,
    the text without the characters all of whose bytes go (empty where nothing is left or there was no text)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text"))
    text = F.coalesce("_text", F.lit(""))
    out = _with_runs(rows, least).withColumn("_cut", _cut(least))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.coalesce("_cut.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_cut.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("_cut.kept_sha256", F.sha2(text.cast("binary"), 256)).alias("kept_sha256"),
        F.coalesce("_cut.kept_text", text).alias("kept_text"),
    )


def _cut_words(least: int, words: int):
    """What is left of texts with runs of bytes or words; rows without are null and stay so."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series, word_runs: pd.Series) -> pd.Series:
        out = []
        for t, r, w in zip(text, runs, word_runs):
            if t is None:
                out.append(None)
                continue
            raw = _bytes(t)
            gone = removed_bytes(raw, r, least)
            if w is not None and len(w):
                gone = gone | removed_words(raw, w, words)
            out.append(kept_text(np.frombuffer(raw, np.uint8), gone))
        return pd.Series(out, dtype=object)

    return cut(F.when(F.col("_runs").isNotNull() | F.col("_word_runs").isNotNull(), F.col("_text")), F.col("_runs"), F.col("_word_runs"))


def without_repeats(docs: DataFrame, least: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with what repeats cut out of their texts; a row whose text goes wholly keeps an empty one.

    Strings of ``least`` bytes go that start somewhere else too. With ``words`` whole passages of so many words go whose words repeat,
    in any case of A-Z and with any white space, and strings of bytes with fewer words inside; of others, a broken word at an end stays."""
    others = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text"), *[docs[c].alias(f"_c{k}") for k, c in enumerate(others)])
    out = _with_runs(rows, least, words)
    text = F.coalesce(_cut(least)["kept_text"] if words is None else _cut_words(least, words), "_text")
    return out.select(*[F.col(f"_c{others.index(c)}").alias(c) if c in others else text.alias(c) for c in docs.columns])
