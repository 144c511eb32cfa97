"""Scores of texts by a probabilistic suffix tree over words.

The tree's nodes are contexts of one word and more, grown level by level: a context of k words is a candidate if it is
frequent and so are the contexts of k - 1 words in it, up to ``depth`` words or until a level has none. It is retained if its
next-symbol distribution diverges from its parent's (the distribution of the longest retained proper suffix)
by more than the description of its own costs. The distribution is smoothed: next symbols that are frequent after
the context have their discounted share; the rest of the mass goes to all other symbols as the parent
has them. A token is scored in the longest retained suffix of the words before it. Words are the tokens, and
every text ends in one end symbol.

A context and a symbol count as frequent from ``least_count`` occurrences on, at any size of the corpus, so the tree grows with it
and is a table. Frequent word sequences are found exactly: counters of pairs, one of 2^32 each, are summed over the corpus in ranges and
bound each pair's count from above; what they cannot rule out is counted. A filter of a fixed number of bits tells which pairs may be
frequent, and passes more of the others where it is full.
A text's score is a sum over the sequences in it, so that scoring is a join with their weights: the most frequent ones are broadcast, a
bounded number of rows, the others that a text has are joined with the distributed table, and add nothing less.
At the root are all words, with exact counts, and their number grows with the corpus: frequent ones are broadcast (their
number is bounded by the share), the tokens of others are joined with the distributed vocabulary.
What is many times the vocabulary (counts of each task, lookups of each text) is shuffled by ranges of hashes: one row holds all of a
task's or of a million tokens' in a range as columns of bytes, and a range is small, since there are more of them the more input there is.
Each step's result is written, and then its shuffle files and what was broadcast to it are let go, so that disk holds one step's at a time.

Cases: a null or empty text is one end symbol; a null ``doc_id`` has a null ``held_out`` and is not learned from;
rows that repeat are learned from and scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import exact, keyed_bytes, materialise, words_of
from panelforge.llm.shinglejoin import WordHashes, _mixed

#: Share of all tokens from which a word is broadcast; never under ``LEAST_COUNT`` occurrences, from which sequences are frequent.
WORD_SHARE, LEAST_COUNT = 2e-7, 8
#: Sequences whose weights are broadcast; the others' are joined.
HOT_SEQUENCES = 1 << 20
#: Words of the longest contexts.
DEPTH = 4
MOST_DEPTH = 8
#: Levels whose sequences, of two and of three words, are counted by hash first.
COUNTED_LEVELS = 2
#: Bits of a filter, which are sent to all tasks.
FILTER = 1 << 27
_FILTER_SHIFT = 64 - 27
_CHUNKS = 16
DISCOUNT = 0.5
END = np.uint64(0x5EED0F7E47E0D001)  # the end symbol's hash
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: bytes | None, memo: WordHashes) -> np.ndarray:
    words = words_of(text)
    t = np.empty(len(words) + 1, np.uint64)
    t[:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    t[-1] = END
    return t


def _joined(texts, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts in one array, and each token's place in its text."""
    rows = [tokens_of(t, memo) for t in texts]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.array([len(r) for r in rows])
    return np.concatenate(rows), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _parts(batches: Iterator[pd.DataFrame], memo: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_joined`` of about a million characters at a time."""
    for pdf in batches:
        held, size = [], 0
        for text in pdf["text"]:
            held.append(text)
            size += len(text or b"")
            if size > 1_000_000:
                yield _joined(held, memo)
                held, size = [], 0
        if held:
            yield _joined(held, memo)


def grams(t: np.ndarray, most: int) -> list[np.ndarray]:
    """For n from 1 to ``most``: a hash of the n tokens that end at each place (of no meaning where the text has fewer)."""
    out = [_mixed(t)]
    for _ in range(most - 1):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(_mixed(before * _M1 + t * _M2))
    return out


def _hashes(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _slot(h: np.ndarray) -> np.ndarray:
    """One of 2^32 counters of a sequence."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as bytes, plane by plane, so that equal first bytes take little."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), 1)


def _unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    data, widths = np.frombuffer(zstandard.decompress(raw), np.uint8), [np.dtype(t).itemsize for t in types]
    size, at, out = len(data) // sum(widths), 0, []
    for t, width in zip(types, widths):
        out.append(np.ascontiguousarray(data[at : at + size * width].reshape(width, size).T).view(t).ravel())
        at += size * width
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """The first value, then differences."""
    return np.concatenate([sorted_[:1], sorted_[1:] - sorted_[:-1]])


def _ranges(sorted_: np.ndarray, chunks: int) -> list[slice]:
    """Where hashes of each range, by their first bits, lie among sorted ones."""
    kind = sorted_.dtype.type
    first = np.arange(1, chunks, dtype=kind) << kind(8 * sorted_.itemsize - (chunks.bit_length() - 1))
    ends = [0, *np.searchsorted(sorted_, first).tolist(), len(sorted_)]
    return [slice(*x) for x in zip(ends, ends[1:])]


def _packed(slots: np.ndarray, counts: np.ndarray) -> bytes:
    """Counters as bytes, those above zero alone, in order of slot: a task has few of them, however many tasks there are."""
    return _pack(_steps(slots.astype("<u4")), counts.astype("<i4"))


def _unpacked_slots(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, counts = _unpack(raw, "<u4", "<i4")
    return np.cumsum(steps, dtype=np.uint32), counts


def _unpacked(raw: bytes) -> np.ndarray:
    return _unpacked_slots(raw)[1]


COUNTED = "level int, chunk int, counts binary"


def _count(depth: int, chunks: int = _CHUNKS):
    """Of training texts, about two million tokens at a time and by ranges of hashes: words with counts (of no level), and counters of sequences
    of two words and more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        held, size, slots = [], 0, [[] for _ in range(depth)]

        def flush() -> Iterator[pd.DataFrame]:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"level": None, "chunk": range(chunks), "counts": [_pack(_steps(w[x]), n[x].astype("<i4")) for x in _ranges(w, chunks)]})
            for level in range(depth):
                s, n = np.unique(np.concatenate(slots[level]), return_counts=True)
                slots[level] = []
                yield pd.DataFrame({"level": level, "chunk": range(chunks), "counts": [_packed(s[x], n[x]) for x in _ranges(s, chunks)]})

        for t, at in _parts(batches, memo):
            held.append(t)
            size += len(t)
            for level, h in enumerate(grams(t, depth + 1)[1:]):
                slots[level].append(_slot(h[at > level]))
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots in order with the sum of their counts."""
    slots, counts = np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64)
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
    return slots[start], np.add.reduceat(counts, start) if len(start) else counts


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    slots, counts = _added([_unpacked_slots(x) for x in pdf["counts"]])
    counts = np.minimum(counts, np.iinfo(np.int32).max)
    return pd.DataFrame({"level": pdf["level"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "fold": [0], "counts": [_packed(slots, counts)]})


PART = "level int, chunk int, bits binary, word long, c long, tokens long, words long"


def _gathered(chunks: int, least: int):
    """Of one range of counters, its part of the filter of those that are at least ``least``. Of one range of words (level -1), all with their
    counts as bytes, the number of tokens and of words in it, and a row for each word seen ``least`` times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        level, chunk = int(pdf["level"].iloc[0]), int(pdf["chunk"].iloc[0])
        if level < 0:
            held = [_unpack(x, "<u8", "<i4") for x in pdf["counts"]]
            w, n = _added([(np.cumsum(w, dtype=np.uint64), n) for w, n in held])
            often = n >= least
            k = int(often.sum())
            return pd.DataFrame(
                {
                    "level": -1, "chunk": chunk, "bits": [_pack(_steps(w), n.astype("<i8")), *[None] * k],
                    "word": exact([None, *w[often].view(np.int64).tolist()]), "c": exact([None, *n[often].tolist()]),
                    "tokens": exact([int(n.sum()), *[None] * k]), "words": exact([len(w), *[None] * k]),
                }
            )
        slots, counts = _added([_unpacked_slots(x) for x in pdf["counts"]])
        bits = np.zeros(FILTER // chunks, np.uint8)
        bits[(slots[counts >= least] >> np.uint32(_FILTER_SHIFT - 32)).astype(np.int64) - chunk * len(bits)] = 1
        packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        return pd.DataFrame({"level": [level], "chunk": [chunk], "bits": [packed]}).assign(word=None, c=None, tokens=None, words=None)

    return run


def _of_chunk(chunks: int):
    """The filter's part of one chunk of keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        bits = np.zeros(FILTER // chunks, np.uint8)
        bits[(_hashes(pdf["key"]) >> np.uint64(_FILTER_SHIFT)).astype(np.int64) - chunk * len(bits)] = 1
        return pd.DataFrame({"level": [0], "chunk": [chunk], "bits": [zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)]})

    return run


def _bits(parts: DataFrame, chunks: int, levels: int = 1) -> np.ndarray:
    """Bits of a filter a level, so many at any size, from their chunks."""
    bits, width = np.zeros((levels, FILTER // 8), np.uint8), FILTER // 8 // chunks
    for r in parts.toLocalIterator():
        bits[r["level"], r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits


def _filter_of(cold: DataFrame, chunks: int) -> Filter | None:
    """Which sequences may be among these; None if there are none."""
    if cold.isEmpty():
        return None
    keys = cold.select("key", F.shiftrightunsigned("key", 64 - (chunks.bit_length() - 1)).cast("int").alias("chunk"))
    return Filter(_bits(keys.groupBy("chunk").applyInPandas(_of_chunk(chunks), "level int, chunk int, bits binary"), chunks)[0])


class Filter:
    """A fixed number of bits, by the first bits of a hash: tells for certain what is not in a set."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, hashes: np.ndarray) -> Filter:
        bits = np.zeros(FILTER // 8, np.uint8)
        place = (hashes >> np.uint64(_FILTER_SHIFT)).astype(np.int64)
        np.bitwise_or.at(bits, place >> 3, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8)))
        return cls(bits)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(_FILTER_SHIFT)).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


class Places:
    """Places of hashes in a sorted array of distinct ones, -1 for others: from the first of those with the same first bits on."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.first = hashes, None
        self.shift = np.uint64(64 - max(1, (2 * len(hashes)).bit_length()))

    def index(self, t: np.ndarray) -> np.ndarray:
        out = np.full(len(t), -1, np.int64)
        if not len(self.hashes):
            return out
        if self.first is None:  # made where it is used, not sent
            self.first = np.searchsorted(self.hashes >> self.shift, np.arange(1 << int(64 - self.shift), dtype=np.uint64)).astype(np.int32)
        i, asked, open_ = self.first[(t >> self.shift).astype(np.int64)].astype(np.int64), t, np.arange(len(t))
        while len(open_):
            held = self.hashes[np.minimum(i, len(self.hashes) - 1)]
            same = held == asked
            out[open_[same]] = i[same]
            on = (held < asked) & (i + 1 < len(self.hashes))
            i, asked, open_ = i[on] + 1, asked[on], open_[on]
        return out


class Words(Places):
    """Frequent words in order of hash, with counts and the factors of those that are contexts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, factors: np.ndarray):
        order = np.argsort(hashes)
        super().__init__(hashes[order])
        self.counts, self.factors = counts[order], factors[order]


class Weights(Places):
    """What each occurrence of a sequence of two words and more adds to a text's score: of frequent sequences, and which others may add."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, others: Filter | None):
        order = np.argsort(keys)
        super().__init__(keys[order])
        self.weights, self.some, self.others = weights[order], None, others

    def of(self, t: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of each place's weights, then places and keys of sequences that are to be looked up elsewhere."""
        if self.some is None:
            self.some = Filter.of(self.hashes)
        out, places, keys = np.zeros(len(t)), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k, h in enumerate(grams(t, depth + 1)[1:]):
            inside = at > k
            place = np.flatnonzero(self.some.may_have(h) & inside)
            i = self.index(h[place])
            out[place[i >= 0]] += self.weights[i[i >= 0]]
            if self.others is not None:
                place = np.flatnonzero(self.others.may_have(h) & inside)
                place = place[self.index(h[place]) < 0]
                places.append(place)
                keys.append(h[place])
        return out, np.concatenate(places), np.concatenate(keys)


GRAM = "level int, chunk int, counts binary, symbols binary"


def _grams(shared, depth: int, chunks: int):
    """Counts of the sequences all of whose pairs and triples may be frequent, by ranges of their keys. A key is the hash of a context and its
    next symbol; since it can be undone, no more is needed to know both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = [Filter(bits) for bits in shared.value]
        memo = WordHashes()
        held, size = [[] for _ in range(depth)], 0

        def flush() -> Iterator[pd.DataFrame]:
            for level, parts in enumerate(held):
                if parts:
                    h, t = (np.concatenate(x) for x in zip(*parts))
                    key, one, n = np.unique(h, return_index=True, return_counts=True)
                    rows = []
                    for chunk, x in enumerate(_ranges(key, chunks)):
                        if x.stop > x.start:
                            symbols, i = np.unique(t[one[x]], return_inverse=True)
                            rows.append((level, chunk, _pack(_steps(key[x]), i.astype("<u4"), n[x].astype("<i4")), _pack(_steps(symbols))))
                    yield pd.DataFrame(rows, columns=["level", "chunk", "counts", "symbols"])
                parts.clear()

        for t, at in _parts(batches, memo):
            h = grams(t, depth + 1)
            for level in range(depth):
                # a sequence is frequent only if what it has without its last and without its first word is
                ok = ok & np.concatenate([[False], ok[:-1]]) & (at > level) if level else at > 0
                place = np.flatnonzero(ok)
                if level < len(filters):
                    place = place[filters[level].may_have(h[level + 1][place])]
                    ok = np.zeros(len(t), bool)
                    ok[place] = True
                held[level].append((h[level + 1][place], t[place]))
                size += len(place)
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _unmixed(h: np.ndarray) -> np.ndarray:
    """What ``_mixed`` made of it."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))


def context_of(key: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a sequence without its last token."""
    return (_unmixed(key) - last * _M2) * np.uint64(pow(int(_M1), -1, 1 << 64))


SEQUENCE = "key long, symbol long, level int, n long, context long"


def _sequences(least: int):
    """Of one range of keys, the sequences seen ``least`` times, with the hash of their context, that of a context of one word undone to its word's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, symbols, counts = [], [], []
        for raw, held in zip(pdf["counts"], pdf["symbols"]):
            step, i, n = _unpack(raw, "<u8", "<u4", "<i4")
            keys.append(np.cumsum(step, dtype=np.uint64))
            symbols.append(np.cumsum(*_unpack(held, "<u8"), dtype=np.uint64)[i])
            counts.append(n)
        key, symbol = np.concatenate(keys), np.concatenate(symbols)
        order = np.argsort(key, kind="stable")
        key, symbol, n = key[order], symbol[order], np.concatenate(counts)[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.add.reduceat(n, start)
        start, n = start[n >= least], n[n >= least]
        key, symbol, level = key[start], symbol[start], int(pdf["level"].iloc[0])
        context = context_of(key, symbol)
        context = context if level else _unmixed(context)
        return pd.DataFrame({"key": key.view(np.int64), "symbol": symbol.view(np.int64), "level": level, "n": n, "context": context.view(np.int64)})

    return run


def _with_tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequences with the hash of what they have without their first word, made of their context's."""
    for pdf in batches:
        symbol = _hashes(pdf["symbol"])
        tail = _mixed(symbol) if "tail" not in pdf else _mixed(_hashes(pdf["tail"]) * _M1 + symbol * _M2)
        yield pdf.assign(tail=tail.view(np.int64)).drop(columns="symbol")


def _tree(found: DataFrame, vocabulary: DataFrame, total: int, size: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Factors of the retained contexts of one word, and the weights of longer sequences: key, n and weight.

    By levels: a context's entries meet the counts of the context and what its parent gives their symbols, sums over a context decide
    if it is retained. A symbol's gain is log10 of its probability over its root probability; a context's factor is log10 of what its
    parent's probability is multiplied by for symbols without entry. A sequence's weight is its factor, as a context of
    whatever follows, and what its entry adds to its parent's gain and its context's factor, so that a text's score is its base
    score plus the weights of all sequences in it.
    """
    root = (F.col("c") + 0.1) / (total + 0.1 * (size + 1))
    of_context = W.partitionBy("context")  # a context has at most as many entries as there are frequent words
    p, q = (F.col("n") - DISCOUNT) / F.col("seen"), F.col("root") * F.pow(F.lit(10.0), F.col("under"))
    sums = {"m": F.count("*").over(of_context), "rest": 1 - F.sum("p").over(of_context), "left": 1 - F.sum("q").over(of_context)}
    sums["divergence"] = F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).over(of_context)
    able = (F.col("rest") > 0) & (F.col("left") > 0)
    safe = F.log(F.col("rest") / F.col("left"))
    diverges = F.col("seen") * (F.col("divergence") + F.col("rest") * safe) > 0.5 * F.col("m") * math.log(max(total, 2))
    factors, weights, below = None, [], None
    for level in range(depth):
        rows = found.where(F.col("level") == level).select("key", "symbol", "context", "n")
        if below is None:
            rows = rows.join(vocabulary.select(F.col("word").alias("context"), F.col("c").alias("seen")), "context")
            rows = rows.join(vocabulary.select(F.col("word").alias("symbol"), root.alias("root")), "symbol").withColumn("under", F.lit(0.0))
            rows = rows.mapInPandas(_with_tails, "key long, context long, n long, seen long, root double, under double, tail long")
        else:
            rows = rows.join(below.select(F.col("key").alias("context"), F.col("n").alias("seen"), "tail"), "context")
            rows = rows.mapInPandas(_with_tails, "key long, context long, n long, seen long, tail long")
            rows = rows.join(below.select(F.col("key").alias("tail"), "root", F.col("gain").alias("under")), "tail")
        rows = rows.withColumns({"p": p, "q": q}).withColumns(sums)
        rows = rows.withColumn("factor", F.when(able, F.when(diverges, safe / math.log(10))))
        rows = rows.withColumn("gain", F.coalesce(F.when(F.col("factor").isNotNull(), F.log10(F.col("p") / F.col("root"))), "under"))
        below = materialise(rows.select("key", "context", "n", "seen", "gain", "under", "root", "tail", "factor"), "entries", release=True)
        kept = below.where("factor is not null")
        weights.append(kept.select("key", "n", (F.col("gain") - F.col("under") - F.col("factor")).alias("weight")))
        kept = kept.groupBy("context").agg(F.first("seen").alias("n"), F.first("factor").alias("factor"))
        if level:
            weights.append(kept.select("context", "n", "factor"))
        else:
            factors = kept.select(F.col("context").alias("word"), "factor")
        if below.isEmpty():
            break
    every = weights[0]
    for w in weights[1:]:
        every = every.unionAll(w)
    return factors, materialise(every.groupBy("key").agg(F.first("n").alias("n"), F.sum("weight").alias("weight")), "weights", release=True)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, gain double, chunk int, gram boolean, lookups binary"


def _score(shared, total: int, vocabulary: int, depth: int, chunks: int):
    """A row for each text, without its rare tokens' part of the score, and its rare words and sequences by ranges of hashes: of about a
    million tokens together, the first text's ``row``, and a text, a hash and how often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, weights = shared.value
        memo, row = WordHashes(), TaskContext.get().partitionId() << 36
        log0 = math.log10(total + 0.1 * (vocabulary + 1))
        log_of = np.log10(words.counts + 0.1) - log0 if len(words.counts) else np.zeros(1)
        held, size, first = {False: [], True: []}, 0, row
        shift = np.uint64(64 - (chunks.bit_length() - 1))
        names = [c.split()[0] for c in SCORED.split(", ")]

        def apart(gram: bool) -> pd.DataFrame:
            doc, h = (np.concatenate(x) for x in zip(*held[gram]))
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
            doc, h, n = doc[new], h[new], np.diff(np.append(new, len(h)))
            chunk = (h >> shift).astype(np.uint16)
            order = np.argsort(chunk, kind="stable")  # texts stay in order within a range
            doc, h, n, chunk = doc[order], h[order], n[order], chunk[order]
            ends = np.searchsorted(chunk, np.arange(chunks + 1))
            rows = [(c, _pack(_steps(doc[a:b].astype("<u4")), h[a:b], n[a:b].astype("<i4"))) for c, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            out = pd.DataFrame(rows, columns=["chunk", "lookups"]).assign(row=first, gram=gram)
            return out.assign(doc_id=None, held_out=None, n_tokens=None, n_known=None, base_score=None, gain=None)[names]

        def flush() -> Iterator[pd.DataFrame]:
            for gram, parts in held.items():
                if parts:
                    yield apart(gram)
                parts.clear()

        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 500):
                t, at = _joined(texts[lo : lo + 500], memo)
                w = words.index(t)
                doc = np.cumsum(at == 0) - 1
                k = int(doc[-1]) + 1
                seen = w >= 0
                base = np.bincount(doc[seen], log_of[w[seen]], minlength=k)
                gain, place, key = weights.of(t, at, depth)
                gain[seen] += words.factors[w[seen]]
                yield pd.DataFrame(
                    {
                        "row": row + np.arange(k),
                        "doc_id": pdf["doc_id"].iloc[lo : lo + k].astype("Int64").array,
                        "held_out": pdf["held_out"].iloc[lo : lo + k].astype("boolean").array,
                        "n_tokens": np.bincount(doc, minlength=k),
                        "n_known": np.bincount(doc[seen], minlength=k),
                        "base_score": base,
                        "gain": np.bincount(doc, gain, minlength=k),
                    }
                ).assign(chunk=None, gram=None, lookups=None)
                if not seen.all():
                    held[False].append((doc[~seen] + (row - first), t[~seen]))
                if len(place):
                    held[True].append((doc[place] + (row - first), key))
                row += k
                size += len(t)
                if size > 1_000_000:
                    yield from flush()
                    size, first = 0, row
        yield from flush()

    return run


SUMS = "row long, sums binary"
PARTS = "row long, _base double, _known long, _gain double"


def _looked_up(total: int, vocabulary: int):
    """Of one range of hashes, what its words or sequences add to the texts: their lookups meet all words' counts and factors, or weights. As
    bytes, one row for each of the lookups: a text has few words in a range, so that sums by text would be as many rows as words."""

    def run(lookups: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        words = [(np.cumsum(step, dtype=np.uint64), c) for step, c in (_unpack(x, "<u8", "<i8") for x in known["packed"].dropna())]
        held = known[known["weight"].notna()]
        keys, weights = _hashes(held["key"].astype(np.int64)), held["weight"].to_numpy(np.float64)
        order = np.argsort(keys)
        keys, weights = keys[order], weights[order]
        log0 = math.log10(total + 0.1 * (vocabulary + 1))

        def found(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
            """The value of each hash, 0 for others; keys are sorted."""
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[i] == h, values[i], 0) if len(keys) else np.zeros(len(h), values.dtype)

        out = []
        for gram, raw in zip(lookups["gram"], lookups["lookups"]):
            step, h, n = _unpack(raw, "<u4", "<u8", "<i4")
            doc = np.cumsum(step, dtype=np.uint32)
            base, times, gain = np.zeros(len(h)), np.zeros(len(h), np.int64), n * found(keys, weights, h)
            if not gram:
                c = sum((found(*x, h) for x in words), np.zeros(len(h), np.int64))
                base, times = n * (np.log10(c + 0.1) - log0), np.where(c > 0, n, 0)
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            out.append(_pack(_steps(doc[start]), np.add.reduceat(base, start), np.add.reduceat(times, start).astype("<i8"), np.add.reduceat(gain, start)))
        return pd.DataFrame({"row": lookups["row"].to_numpy(np.int64), "sums": out})

    return run


def _added_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for each text that was handed on with others."""
    parts = [_unpack(x, "<u4", "<f8", "<i8", "<f8") for x in pdf["sums"]]
    doc = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts])
    doc, of = np.unique(doc, return_inverse=True)
    base, known, gain = (np.bincount(of, np.concatenate([x[k] for x in parts])) for k in (1, 2, 3))
    return pd.DataFrame({"row": int(pdf["row"].iloc[0]) + doc.astype(np.int64), "_base": base, "_known": known.astype(np.int64), "_gain": gain})


def _most(weights: DataFrame, most: int) -> int:
    """The smallest count from which on at most ``most`` sequences are, in steps of an eighth of an octave."""
    step = F.floor(8 * F.log2("n"))
    held = weights.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # some hundred rows
    over, least = 0, None
    for r in held:
        over += r["count"]
        if over > most:
            break
        least = r["step"]
    return math.inf if least is None else least


def score(docs: DataFrame, depth: int = DEPTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and the tree's score."""
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"contexts have 1 to {MOST_DEPTH} words")
    spark = docs.sparkSession
    rows = keyed_bytes(docs).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    training = rows.where("not held_out").select("text")
    counters = min(depth, COUNTED_LEVELS)
    chunks = min(1 << 14, max(64, 1 << (2 * training.rdd.getNumPartitions()).bit_length()))
    counted = training.mapInPandas(_count(counters, chunks), COUNTED).fillna(-1, "level")
    counted = materialise(counted.groupBy("level", "chunk").applyInPandas(_gathered(chunks, least_count), PART), "counted", release=True)
    vocabulary = counted.where("word is not null").select("word", "c")
    totals = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    total, size = int(totals["n"]), int(totals["v"])

    bits = _bits(counted.where("level >= 0").select("level", "chunk", "bits"), chunks, counters)
    filters = spark.sparkContext.broadcast(bits)
    found = training.mapInPandas(_grams(filters, depth, chunks), GRAM)
    found = materialise(found.groupBy("level", "chunk").applyInPandas(_sequences(least_count), SEQUENCE), "sequences", release=True)
    filters.destroy()  # a file on the driver and on each executor
    factors, weights = _tree(found, vocabulary, total, size, depth)

    common = max(least_count, math.ceil(WORD_SHARE * total))
    heavy = vocabulary.where(F.col("c") >= common).join(factors, "word", "left").fillna(0.0, "factor").toArrow()  # at most 1 / WORD_SHARE rows
    words = Words(heavy["word"].to_numpy().view(np.uint64), heavy["c"].to_numpy(), heavy["factor"].to_numpy())
    hot = F.floor(8 * F.log2("n")) >= _most(weights, HOT_SEQUENCES)
    top, cold = weights.where(hot).select("key", "weight").toArrow(), weights.where(~hot)
    others = _filter_of(cold, chunks)
    shared = spark.sparkContext.broadcast((words, Weights(top["key"].to_numpy().view(np.uint64), top["weight"].to_numpy(), others)))

    scored = materialise(rows.mapInPandas(_score(shared, total, size, depth, chunks), SCORED), "scored", release=True)
    shared.destroy()
    # all words as bytes, by the ranges that they were counted in; factors and the cold weights as rows; a null key would make hashes floats
    range_of = lambda key: F.shiftrightunsigned(key, 64 - (chunks.bit_length() - 1)).cast("int")
    known = counted.where("tokens is not null").select(F.lit(False).alias("gram"), "chunk", F.col("bits").alias("packed"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("double").alias("weight"))
    known = known.unionAll(factors.select(F.lit(False), range_of("word"), F.lit(None), "word", "factor"))
    if others is not None:
        known = known.unionAll(cold.select(F.lit(True), range_of("key"), F.lit(None), "key", "weight"))
    lookups = scored.where("lookups is not null").select("gram", "chunk", "row", "lookups")
    rare = lookups.groupBy("gram", "chunk").cogroup(known.groupBy("gram", "chunk")).applyInPandas(_looked_up(total, size), SUMS)
    rare = rare.groupBy("row").applyInPandas(_added_up, PARTS)
    out = scored.where("lookups is null").drop("chunk", "gram", "lookups").join(rare, "row", "left")
    base = F.col("base_score") + F.coalesce("_base", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain") + F.coalesce("_gain", F.lit(0.0))).alias("score")
    )
