"""N-gram Jaccard join: count-vector R-trees over tiles of texts that share a rare shingle.

A text's set has its distinct five-word shingles as 64-bit hashes. Two texts link if 100 * intersection is
at least ``percent`` * union. Equal sets are one *node*.

1. Every node has a count vector: its shingles are hashed into groups and counted by group. The sum over groups
   of the smaller count bounds the intersection of two sets from above. Of a second, finer grouping only the
   parities are kept: where they differ so do the counts, which bounds the sum of minima again and far closer.
2. Linked sets share at least one shingle among the ``n - ceil(percent/100 * n) + 1`` first of either in any
   common order (rarest first, by counters of a fixed number that are summed over all texts), so the nodes that have
   one shingle among their first are a *tile*, and linked nodes meet in a tile. Where two sets have their first common
   shingle, what either has from there on bounds their intersection; nodes that no other one of their tile can link with by
   that are dropped from it before vectors are sent. Every linked pair stays in the tile of its first common shingle.
3. In each tile the vectors are indexed by an R-tree (boxes are the largest counts and the range of sizes) that is
   joined with itself level by level; pairs of boxes, then of points, whose bound is too small are dropped.
4. What survives is verified on the sets, each pair where the node with more pairs is. First each node's best partner
   and its hub; links join nodes into components, and the second pass takes all surviving pairs of different components. So
   copies of one text cost one verification each, and no link between components is lost.

Cases: null and empty texts have empty sets and link with nothing; a text with fewer words than five is one
shingle; rows of one ``doc_id`` are one document in ``component_id``; rows with a null id link with nothing
and have a null component; an empty table gives no rows; other columns are ignored or, in
``one_of_each``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import exact, keyed_bytes, materialise, words_of
from panelforge.llm.components import components

WORDS = 5
PERCENT = 80
GROUPS, FINE_GROUPS = 32, 1024
#: Counters of shingles, by which the rarest come first; any order is right, a good one makes small tiles.
COUNTERS = 1 << 18
_CHUNKS, _FOLDS = 32, 32
LEAF, FAN = 32, 16
#: Pairs of one hub that a cell takes, about, and bits of the filter of documents.
CELL, FILTER_BITS = 128, 1 << 23
#: Hubs that are drawn from a tile, each among the nodes that the ones before leave.
HUBS = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, kept for as long as they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = words_of(text)
    t = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if not len(t):
        return t
    k = min(WORDS, len(t))
    h = np.full(len(t) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _MUL + t[i : len(t) - k + 1 + i]
    return np.unique(_mixed(h))


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def _vector(s: np.ndarray) -> bytes:
    """Counts by group (65535 and more as such), then the parities of the finer groups."""
    counts = np.minimum(np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 65_535).astype(np.uint16)
    fine = np.bincount(((s >> np.uint64(5)) & np.uint64(FINE_GROUPS - 1)).astype(np.int64), minlength=FINE_GROUPS) & 1
    return counts.tobytes() + np.packbits(fine.astype(np.uint8)).tobytes()


def _unpacked(vectors) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, 2 * GROUPS + FINE_GROUPS // 8)
    counts = np.ascontiguousarray(raw[:, : 2 * GROUPS]).view(np.uint16).astype(np.int32)
    counts[counts == 65_535] = 1 << 24  # no bound
    return counts, np.ascontiguousarray(raw[:, 2 * GROUPS :]).view(np.uint64)


PROFILE = "doc_id long, n int, node long, vector binary, chunk int, fold int, counts binary"


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a text, and at the end the task's counters."""
    memo, counters = WordHashes(), np.zeros(COUNTERS, np.int64)
    shift = np.uint64(64 - COUNTERS.bit_length() + 1)
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            s = shingles(text, memo)
            if len(s):
                counters += np.bincount((s >> shift).astype(np.int64), minlength=COUNTERS) if len(s) > 20_000 else 0
                if len(s) <= 20_000:
                    np.add.at(counters, (s >> shift).astype(np.int64), 1)
                # groups by other bits than the counters'
                out.append((len(s), _node(s), _vector(s)))
            else:
                out.append((0, None, None))
        res = pd.DataFrame({"n": [r[0] for r in out], "node": exact([r[1] for r in out]), "vector": [r[2] for r in out]})
        res.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
        yield res.assign(chunk=None, fold=None, counts=None)
    size = COUNTERS // _CHUNKS
    part = TaskContext.get().partitionId()
    rows = [(None, None, None, None, c, part % _FOLDS, counters[c * size : (c + 1) * size].tobytes()) for c in range(_CHUNKS)]
    res = pd.DataFrame(rows, columns=["doc_id", "n", "node", "vector", "chunk", "fold", "counts"])
    yield res.astype({"doc_id": "Int64", "n": "Int64", "node": "Int64"})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.int64) for b in pdf["counts"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "fold": [0], "counts": [total.tobytes()]})


#: Steps of a size's logarithm, and of a place's share of the size, in a ``place``.
_LOG, _SHARE = 256, 1 << 16


def _place(n: int, at: np.ndarray) -> np.ndarray:
    """A set's size and places in its order, rounded down, in 32 bits."""
    return (int(np.log(n) * _LOG) * _SHARE + at * _SHARE // n).astype(np.int32)


def _size_and_rest(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a ``place`` the least size that it may stand for, and the most shingles from there on."""
    log, share = place // _SHARE, place % _SHARE
    return np.exp(log / _LOG), np.exp((log + 1) / _LOG) * (1 - share / _SHARE)


def _prefixes(counters, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, counts = WordHashes(), counters.value
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        for pdf in batches:
            keys, nodes, places, seen = [], [], [], set()
            for text in pdf["text"]:
                s = shingles(text, memo)
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    n = len(s)
                    first = np.lexsort((s, counts[(s >> shift).astype(np.int64)]))[: n - (percent * n + 99) // 100 + 1]
                    keys.append(s[first].view(np.int64))
                    nodes.append(np.full(len(first), node, np.int64))
                    places.append(_place(n, np.arange(len(first))))
            if keys:
                yield pd.DataFrame({"tile": np.concatenate(keys), "node": np.concatenate(nodes), "place": np.concatenate(places)})

    return run


def whole_groups(batches: Iterator[pd.DataFrame], key: str, rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Sorted rows in larger frames that never cut a group."""
    held, size = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size >= rows:
            both = pd.concat(held, ignore_index=True)
            k = both[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield both.iloc[:cut]
            held, size = [both.iloc[cut:]], len(both) - cut
    if held:
        yield pd.concat(held, ignore_index=True)


def _with_partner(place: np.ndarray, start: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of the tiles can link with another one by their sizes and places; all rows of tiles over ``LEAF``."""
    least, rest = _size_and_rest(place)
    keep = np.repeat(size > LEAF, size)
    for k in np.unique(size[(size > 1) & (size <= LEAF)]).tolist():
        at = start[size == k]
        left, right = np.triu_indices(k, 1)
        step = max(1, 1_000_000 // len(left))
        for lo in range(0, len(at), step):
            i, j = at[lo : lo + step, None] + left, at[lo : lo + step, None] + right
            ok = (100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (least[i] + least[j])
            keep[i[ok]] = True
            keep[j[ok]] = True
    return keep


def _shared_tiles(percent: int):
    """Rows of tiles with two nodes or more that may link, each named by a digest of its nodes: tiles with the same nodes get the same rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in whole_groups(batches, "tile"):
            tile, node, place = pdf["tile"].to_numpy(), pdf["node"].to_numpy(), pdf["place"].to_numpy()
            for some in (np.concatenate([[True], (tile[1:] != tile[:-1]) | (node[1:] != node[:-1])]), None):
                if some is None:
                    some = _with_partner(place, start, size, percent)
                tile, node, place = tile[some], node[some], place[some]
                start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
                size = np.diff(np.append(start, len(tile)))
            if not len(tile):
                continue
            name = _mixed(np.add.reduceat(_mixed(node.view(np.uint64)), start) + size.astype(np.uint64) * _MUL).view(np.int64)
            if len(seen) > 1_000_000:
                seen.clear()
            keep = np.zeros(len(start), bool)
            for i, sign in enumerate(name.tolist()):
                if sign not in seen:
                    seen.add(sign)
                    keep[i] = True
            use = np.repeat(keep, size)
            if use.any():
                yield pd.DataFrame({"tile": np.repeat(name, size)[use], "node": node[use]})

    return run


def _enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether an intersection of that bound can reach the similarity: i / (sizes - i) >= percent / 100."""
    return (100 + percent) * overlap >= percent * sizes


class CountRTree:
    """Points are count vectors; a box has its largest count in each group, its range of sizes and its component."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        # sort-tile: by size into slabs, in each by the group that varies most
        slabs = max(1, int(np.sqrt(len(sizes) / LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        slab = np.arange(len(sizes)) * slabs // len(sizes)
        widest = vectors[:, int(np.argmax(vectors.var(0)))]
        order = by_size[np.lexsort((widest[by_size], slab))]
        self.order = order
        self.levels = [(vectors[order], sizes[order], sizes[order], labels[order])]
        while len(self.levels[-1][1]) > 1:
            top, low, high, label = self.levels[-1]
            at = np.arange(0, len(low), LEAF if len(self.levels) == 1 else FAN)
            first, last = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            one = np.where(first == last, first, -1)  # labels are 0 and up; -1 is several
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), one))

    def _can(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        top, low, high, label = self.levels[level]
        ok = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        ok &= (label[i] != label[j]) | (label[i] < 0)
        out = np.zeros(len(i), bool)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 100_000):
            a = at[k : k + 100_000]
            bound = np.minimum(top[i[a]], top[j[a]]).sum(1)
            out[a] = _enough(np.minimum(bound, np.minimum(high[i[a]], high[j[a]])), low[i[a]] + low[j[a]], percent)
        return out

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points, as they were given, that the bound allows: the tree joined with itself, level by level."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            if level == 0:
                ok = (i < j) & self._can(0, i, j, percent) if len(i) else np.zeros(0, bool)
                if ok.any():
                    yield self.order[i[ok]], self.order[j[ok]]
                continue
            ok = self._can(level, i, j, percent)
            i, j = i[ok], j[ok]
            fan, n = (LEAF if level == 1 else FAN), len(self.levels[level - 1][1])
            step = max(1, 200_000 // (fan * fan))
            for k in range(0, len(i), step):
                a, b = i[k : k + step, None, None] * fan + np.arange(fan)[None, :, None], j[k : k + step, None, None] * fan + np.arange(fan)[None, None, :]
                a, b = np.broadcast_arrays(a, b)
                ok = (a < n) & (b < n) & (a <= b)
                todo.append((level - 1, a[ok], b[ok]))


def _candidates(percent: int, best_only: bool):
    """Pairs of nodes from whole tiles: all that the bounds allow, or for each node its best of a few and its best hub."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "tile", 100_000):
            tile, node, sizes = pdf["tile"].to_numpy(), pdf["node"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
            labels = pd.factorize(pdf["label"].to_numpy() if "label" in pdf else node)[0].astype(np.int64)
            counts, parity = _unpacked(pdf["vector"])
            start = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
            number = np.diff(np.append(start, len(tile)))

            def apart(a, b) -> np.ndarray:
                return np.bitwise_count(parity[a] ^ parity[b]).sum(1, dtype=np.int64)

            def allowed(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
                out = []
                for k in range(0, len(a), 200_000):
                    i, j = a[k : k + 200_000], b[k : k + 200_000]
                    ok = labels[i] != labels[j]
                    i, j = i[ok], j[ok]
                    bound = np.minimum((sizes[i] + sizes[j] - apart(i, j)) // 2, np.minimum(counts[i], counts[j]).sum(1))
                    ok = _enough(bound, sizes[i] + sizes[j], percent)
                    i, j, bound = i[ok], j[ok], bound[ok]
                    out.append(pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "score": bound / (sizes[i] + sizes[j] - bound)}))
                return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "score": []})

            found, starred = [], []
            for k in np.unique(number[(number > 1) & (number <= LEAF)]).tolist():  # tiles of one leaf, all of a size at once
                at = start[number == k]
                left, right = np.triu_indices(k, 1)
                for lo in range(0, len(at), max(1, 100_000 // len(left))):
                    some = at[lo : lo + max(1, 100_000 // len(left)), None]
                    found.append(allowed((some + left).ravel(), (some + right).ravel()))
            for s, k in zip(start[number > LEAF].tolist(), number[number > LEAF].tolist()):
                span = np.arange(s, s + k)
                tree = CountRTree(counts[span], sizes[span], labels[span])
                if best_only:  # neighbours in the order of the leaves, and those nearest to what most have in common
                    order = span[tree.order]
                    found += [allowed(order[:-d], order[d:]) for d in (1, 2, 3)]
                    for _ in range(HUBS):
                        most = sum(np.unpackbits(parity[span[lo : lo + 20_000]].view(np.uint8), axis=1).sum(0, dtype=np.int64) for lo in range(0, len(span), 20_000))
                        centre = np.packbits(2 * most > len(span)).view(np.uint64)
                        hub = span[int(np.argmin(np.bitwise_count(parity[span] ^ centre).sum(1, dtype=np.int64)))]
                        near = allowed(span, np.full(len(span), hub))
                        starred.append(near.assign(score=k + near["score"]))  # the hub of the largest tile
                        reached = np.isin(node[span], np.union1d(near["a"], near["b"]))
                        reached |= span == hub
                        span = span[~reached]
                        if len(span) < 2:
                            break
                else:
                    found += [allowed(a + s, b + s) for a, b in tree.pairs(percent)]
            if not found and not starred:
                continue
            if not best_only:
                yield pd.concat(found, ignore_index=True).astype({"a": "int64", "b": "int64"}).drop_duplicates(["a", "b"]).assign(star=False)
                continue
            for star, some in ((False, found), (True, starred)):
                if some:
                    res = pd.concat(some, ignore_index=True).astype({"a": "int64", "b": "int64"})
                    both = pd.concat([res, res.rename(columns={"a": "b", "b": "a"})], ignore_index=True)
                    yield both.sort_values("score").drop_duplicates("a", keep="last")[["a", "b", "score"]].assign(star=star)

    return run


def _packed(wanted):
    """Texts of the documents that the filter lets pass, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        bits, zip_ = wanted.value, zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            at = pdf["bit"].to_numpy()
            pdf = pdf[(bits[at >> 3] >> (at & 7)) & 1 == 1]
            if len(pdf):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "packed": [zip_.compress(t or b"") for t in pdf["text"]]})

    return run


def _verified(percent: int):
    """Cells come sorted with their hub first; each other node is compared with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        memo, unzip, cell, hub, seen = WordHashes(), zstandard.ZstdDecompressor(), None, None, set()
        for pdf in batches:
            out = []
            for h, salt, node, other, packed in zip(*(pdf[c].tolist() for c in ("hub", "salt", "node", "other", "packed"))):
                if cell != (h, salt):
                    cell, hub, seen = (h, salt), None, set()
                if node in seen or other and hub is None:
                    continue
                s = shingles(unzip.decompress(packed), memo)
                if not len(s) or _node(s) != node:  # another text of the same doc_id
                    continue
                seen.add(node)
                if not other:
                    hub = s
                    continue
                both = len(np.intersect1d(hub, s, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(s) - both):
                    out.append((min(h, node), max(h, node)))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _links(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.

    A pair belongs to the one of its nodes that has more pairs, its hub; the pairs of a hub are dealt over cells of about
    ``CELL`` others. Texts go, compressed, to the cells that need them. Documents that none needs are kept back by
    a filter of ``FILTER_BITS`` bits, which lets a few others pass.
    """
    spark = pairs.sparkSession
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    of_a, of_b = degree.withColumnsRenamed({"node": "a", "k": "ka"}), degree.withColumnsRenamed({"node": "b", "k": "kb"})
    both = pairs.select("a", "b").join(of_a, "a").join(of_b, "b")
    first = F.col("ka") >= F.col("kb")
    both = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("ka", "kb").alias("k"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / CELL)).cast("int"))
    asked = both.select("node", "hub", "salt", F.lit(True).alias("other")).unionByName(both.select(F.col("hub").alias("node"), "hub", "salt", F.lit(False).alias("other")).distinct())
    asked = materialise(asked.join(nodes.select("node", "doc"), "node").select("doc", "node", "hub", "salt", "other"), "asked")

    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    places = asked.select(bit(F.col("doc")).alias("p")).groupBy((F.col("p") / 32_768).cast("int").alias("part")).agg(F.bitmap_construct_agg((F.col("p") % 32_768).cast("long")).alias("m"))
    for part, m in places.collect():  # FILTER_BITS bits at any size
        bits[part * 4096 : (part + 1) * 4096] = np.frombuffer(bytes(m), np.uint8)
    texts = rows.where("doc_id is not null").select("doc_id", "text", bit(F.col("doc_id")).alias("bit")).mapInPandas(_packed(spark.sparkContext.broadcast(bits)), "doc_id long, packed binary")
    sent = texts.join(asked, texts["doc_id"] == asked["doc"]).select("hub", "salt", "node", "other", "packed")
    sent = sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "other")
    return materialise(sent.mapInPandas(_verified(percent), "a long, b long"), "similar")


def similar_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, of every row."""
    spark, rows = docs.sparkSession, keyed_bytes(docs)
    profiles = materialise(rows.mapInPandas(_profiles, PROFILE), "profiles")
    texts = profiles.where("chunk is null").select("doc_id", "n", "node", "vector")
    sums = profiles.where("chunk is not null").select("chunk", "fold", "counts")
    for keys in (["chunk", "fold"], ["chunk"]):
        sums = sums.groupBy(*keys).applyInPandas(_summed, "chunk int, fold int, counts binary")
    counted = {r["chunk"]: r["counts"] for r in sums.collect()}  # COUNTERS numbers, however large the input
    counters = spark.sparkContext.broadcast(np.frombuffer(b"".join(counted[c] for c in sorted(counted)), np.int64) if counted else np.zeros(COUNTERS, np.int64))

    nodes = materialise(texts.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("vector").alias("vector")), "nodes")
    first = rows.where("doc_id is not null").mapInPandas(_prefixes(counters, percent), "tile long, node long, place int")
    tiles = first.repartition("tile").sortWithinPartitions("tile", "node").mapInPandas(_shared_tiles(percent), "tile long, node long").distinct()
    tiles = materialise(tiles.join(nodes.select("node", "n", "vector"), "node"), "tiles")

    def pairs(of: DataFrame, best_only: bool) -> DataFrame:
        return of.repartition("tile").sortWithinPartitions("tile", "node").mapInPandas(_candidates(percent, best_only), "a long, b long, score double, star boolean")

    best = pairs(tiles, True).groupBy("a", "star").agg(F.max(F.struct("score", "b")).alias("m"))
    best = materialise(best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct(), "best")
    links = _links(best, nodes, rows, percent)
    labels = components(links)

    open_ = tiles.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = open_.groupBy("tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("tile")
    rest = pairs(open_.join(several, "tile"), False).select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
    more = _links(materialise(rest, "rest"), nodes, rows, percent)

    of_a, of_b = labels.withColumnsRenamed({"node": "a", "label": "la"}), labels.withColumnsRenamed({"node": "b", "label": "lb"})
    joined = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    top = components(joined)
    labels = labels.unionByName(top.select("node", "label").join(labels, "node", "left_anti"))
    final = labels.join(top.select(F.col("node").alias("label"), F.col("label").alias("upper")), "label", "left").select("node", F.coalesce("upper", "label").alias("label"))

    # documents of one id are one document: what their rows' nodes reach
    member = texts.where("node is not null and doc_id is not null").select("doc_id", "node").join(final, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    repeated = member.groupBy("doc_id").agg(F.count_distinct("label").alias("k")).where("k > 1")
    if not repeated.isEmpty():
        ids = member.join(repeated, "doc_id").distinct()
        one = ids.groupBy("doc_id").agg(F.min("label").alias("m"))
        joins = components(ids.join(one, "doc_id").select(F.col("label").alias("a"), F.col("m").alias("b")))
        member = member.join(joins.select(F.col("node").alias("label"), F.col("label").alias("upper")), "label", "left").select("doc_id", F.coalesce("upper", "label").alias("label"))
    smallest = member.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    owner = member.groupBy("doc_id").agg(F.min("label").alias("label")).join(smallest, "label").select("doc_id", "component_id")
    out = texts.join(owner.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a document with a smaller id is linked with, directly or through others.

    One row of each group stays: of rows with one id and text one does, and a row without an id counts as a document after
    all others, one for all with its text. Rows with one id and different texts are kept or dropped together, and rows
    without words stay, one for each id.
    """
    # ids are far below 2**62
    own = F.coalesce(docs["doc_id"].cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(docs["text"].cast("string")), 2))
    rows = docs.select(*[docs[c].alias(f"_c{k}") for k, c in enumerate(docs.columns)], own.alias("_own"), docs["text"].cast("string").alias("_text"))
    groups = similar_groups(rows.select(F.col("_own").alias("doc_id"), F.col("_text").alias("text")), percent)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = rows.join(gone, rows["_own"] == F.col("_gone"), "left_anti")
    # equal rows are few as a rule: only they are brought together, by keys that were counted without the texts
    again = rows.groupBy("_own", F.xxhash64("_text").alias("_key")).count().where("count > 1").select(F.col("_own").alias("_o"), F.col("_key").alias("_k"))
    again = materialise(again, "repeated")
    if not again.isEmpty():
        left = left.withColumn("_key", F.xxhash64("_text"))
        same = (F.col("_own") == F.col("_o")) & (F.col("_key") == F.col("_k"))
        repeated = left.join(again, same, "left_semi").dropDuplicates(["_own", "_key"])
        left = left.join(again, same, "left_anti").unionByName(repeated)
    return left.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
