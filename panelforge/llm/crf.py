"""Language identification by a linear-chain conditional random field over words.

Each word of a text has a label, a language. Its features are affixes, character n-grams and entries of a lexicon, hashed
into a fixed number of weights for each language; transitions between the languages of neighbours are learned
with them. Training maximises the likelihood of labelled words by forward-backward on sequences joined from
runs of documents of several languages, which is code-switched text with known labels. A text's words get
their marginals by forward-backward, and the text the language with most of them.

Words are cut after ``RUN`` characters, so that a long run, or a text without white space, gives a label for each
part and is judged by all of it.

The model is fitted on a bounded sample: of each language the first documents by the hash of their ids, of up to
``SAMPLE_CHARS`` characters, or cut to that where it has too few: ``SAMPLE_DOCUMENTS`` shared out evenly, ``LEAST_DOCUMENTS`` at least.
Its size is fixed by ``WEIGHTS`` and the number of languages.

Cases: a null or empty text, or one without a letter, is ``und`` with score 0; a null ``doc_id`` has a null
``held_out`` and is not learned from; without labelled rows all are ``und``; rows that repeat are labelled each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS, SAMPLE_CHARS, LEAST_DOCUMENTS = 1200, 20_000, 50
RUN = 24
WEIGHTS = 1 << 16
LEXICON_LEAST = 5
STEPS, SEQUENCES, LENGTH = 250, 64, 48
UNKNOWN = "und"


#: Multipliers of the features' hashes, one a kind: n-grams of 2 and 3, prefixes of 2 to 4, suffixes of 2 to 5 characters.
_KINDS = {name: np.uint64(zlib.crc32(name.encode()) * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for name in ("g2", "g3", "p2", "p3", "p4", "s2", "s3", "s4", "s5", "word", "none")}
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _weight(h: np.ndarray, kind: str) -> np.ndarray:
    h = (h + _KINDS[kind]) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - WEIGHTS.bit_length() + 1)).astype(np.int64)


def letters_of(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-cased words one after another, and how many each has: all n-grams of 2 and 3 of its letters
    between marks, its affixes, and the word itself if the lexicon has it."""
    letters = [letters_of(w) for w in words]
    size = np.fromiter(map(len, letters), np.int64, len(letters)) + 2
    start = np.cumsum(size) - size
    text = np.frombuffer("".join(f"<{x}>" for x in letters).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    padded = np.concatenate([text, np.zeros(5, np.uint64)])
    grams = {1: text}
    for n in range(2, 6):  # the hash of the n characters from each place
        grams[n] = grams[n - 1] * _STEP + padded[n - 1 : n - 1 + len(text)]
    word = np.repeat(np.arange(len(size)), size)
    left = np.repeat(start + size, size) - np.arange(len(text))  # characters from here on
    some = size > 2
    owner, ids = [np.flatnonzero(~some)], [np.full(int((~some).sum()), _weight(np.zeros(1, np.uint64), "none")[0])]

    def add(of: np.ndarray, at: np.ndarray, n: int, kind: str) -> None:
        owner.append(of)
        ids.append(_weight(grams[n][at], kind))

    for n in (2, 3):
        at = np.flatnonzero((left >= n) & some[word])
        add(word[at], at, n, f"g{n}")
    for n in (2, 3, 4, 5):
        of = np.flatnonzero(some & (size >= n))
        if n < 5:
            add(of, start[of], n, f"p{n}")
        add(of, (start + size)[of] - n, n, f"s{n}")
    listed = np.flatnonzero(np.fromiter((x in lexicon for x in letters), bool, len(letters)))
    owner.append(listed)
    ids.append(_weight(np.fromiter((zlib.crc32(letters[i].encode("utf-8", "surrogatepass")) for i in listed.tolist()), np.uint64, len(listed)), "word"))
    owner = np.concatenate(owner)
    return np.concatenate(ids)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(letters))


def words(text: str | None) -> list[str]:
    """Lower-cased words, the long ones in parts of ``RUN`` characters."""
    if not isinstance(text, str):
        return []
    whole = text.lower().split()
    if max(map(len, whole), default=0) <= RUN:
        return whole
    return [w[i : i + RUN] for w in whole for i in range(0, len(w), RUN)]


class Crf:
    """Weights by feature and language, transitions and start scores; the languages are in order."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages, self.lexicon = languages, frozenset()
        self.weights, self.moves, self.start = np.zeros((WEIGHTS, k)), np.zeros((k, k)), np.zeros(k)

    def emissions(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores of words by language from their features' weights; every word has a feature."""
        return np.add.reduceat(self.weights[ids], np.cumsum(n) - n) / np.sqrt(n)[:, None]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over sequences that lie one after another, all at once: P(label) of each word."""
        e = np.exp(scores - scores.max(1, keepdims=True))
        move, start = np.exp(self.moves - self.moves.max()), np.exp(self.start - self.start.max())
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # sequences longer than t
        out = np.empty_like(e)
        a = None
        for t in range(longest):
            at = first[: active[t]] + t
            a = e[at] * (start if a is None else a[: active[t]] @ move)
            a /= a.sum(1, keepdims=True)
            out[at] = a
        b = np.ones((0, e.shape[1]))
        for t in range(longest - 1, -1, -1):
            n = int(active[t])
            at = first[:n] + t
            if len(b) < n:
                b = np.concatenate([b, np.ones((n - len(b), e.shape[1]))])
            m = out[at] * b
            out[at] = m / m.sum(1, keepdims=True)
            b = (b * e[at]) @ move.T
            b /= b.sum(1, keepdims=True)
        return out

    def _pair_expectations(self, e: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Marginals and expected transitions of sequences of one length, for the gradient."""
        n, k = len(e) // length, e.shape[1]
        e = np.exp(e - e.max(1, keepdims=True)).reshape(n, length, k)
        move, start = np.exp(self.moves), np.exp(self.start)
        a, b = np.empty_like(e), np.empty_like(e)
        for t in range(length):
            a[:, t] = e[:, t] * (start if t == 0 else a[:, t - 1] @ move)
            a[:, t] /= a[:, t].sum(1, keepdims=True)
        b[:, -1] = 1
        for t in range(length - 2, -1, -1):
            b[:, t] = (b[:, t + 1] * e[:, t + 1]) @ move.T
            b[:, t] /= b[:, t].sum(1, keepdims=True)
        m = a * b
        m /= m.sum(2, keepdims=True)
        pair = a[:, :-1, :, None] * move * (b * e)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        return m, pair.sum((0, 1))

    def fit(self, rows: list[tuple[str, str]], seed: int = 7) -> "Crf":
        """Adagrad on joined runs of labelled documents (text, language)."""
        docs = [(w, self.languages.index(lang)) for text, lang in rows if (w := words(text))]
        if not docs:
            return self
        count = Counter(letters_of(w) for ws, _ in docs for w in ws)
        self.lexicon = frozenset(w for w, n in count.items() if w and n >= LEXICON_LEAST)
        by = [[d for d, k in docs if k == lang] for lang in range(len(self.languages))]
        present = [k for k, d in enumerate(by) if d]
        rng = random.Random(seed)
        sums = [np.full_like(x, 1e-2) for x in (self.weights, self.moves, self.start)]
        for _ in range(STEPS):
            sequence, labels = [], []
            for _ in range(SEQUENCES):
                left = LENGTH
                lang = rng.choice(present)
                while left:
                    doc = rng.choice(by[lang])
                    n = min(left, rng.randint(8, LENGTH), len(doc))
                    at = rng.randrange(len(doc) - n + 1)
                    sequence += doc[at : at + n]
                    labels += [lang] * n
                    left -= n
                    if rng.random() < 0.5:
                        lang = rng.choice(present)
            ids, size = features(sequence, self.lexicon)
            m, pairs = self._pair_expectations(self.emissions(ids, size), LENGTH)
            y = np.eye(len(self.languages))[labels]
            wrong = (y - m.reshape(y.shape)) / SEQUENCES
            yy = y.reshape(SEQUENCES, LENGTH, -1)
            g = np.zeros_like(self.weights)
            np.add.at(g, ids, np.repeat(wrong / np.sqrt(size)[:, None], size, axis=0))
            gm = (np.einsum("btk,btl->kl", yy[:, :-1], yy[:, 1:]) - pairs) / SEQUENCES
            gs = (yy[:, 0] - m[:, 0]).mean(0)
            for x, s, d in zip((self.weights, self.moves, self.start), sums, (g, gm, gs)):
                s += d * d
                x += 0.3 * d / np.sqrt(s)
        return self


class Labeller:
    """Labels texts in a worker; words' scores are kept for as long as they are few."""

    def __init__(self, crf: Crf, memo: int = 400_000):
        self.crf, self.memo = crf, memo
        self.row: dict[str, int] = {}
        self.scores, self.lettered = np.zeros((1024, len(crf.languages))), np.zeros(1024, bool)

    def _learn(self, missing: list[str]) -> None:
        at = len(self.row)
        while at + len(missing) > len(self.scores):
            self.scores, self.lettered = np.concatenate([self.scores, np.zeros_like(self.scores)]), np.concatenate([self.lettered, np.zeros_like(self.lettered)])
        for lo in range(0, len(missing), 20_000):
            part = missing[lo : lo + 20_000]
            self.scores[at : at + len(part)] = self.crf.emissions(*features(part, self.crf.lexicon))
            self.lettered[at : at + len(part)] = [w.isalpha() or any(c.isalpha() for c in w) for w in part]
            self.row.update(zip(part, range(at, at + len(part))))
            at += len(part)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows = [words(t) for t in texts]
        missing = dict.fromkeys(w for r in rows for w in r if w not in self.row)
        if len(self.row) + len(missing) > self.memo:
            self.row.clear()
            missing = dict.fromkeys(w for r in rows for w in r)
        self._learn(list(missing))
        lengths = np.array([len(r) for r in rows])
        names, shares = [UNKNOWN] * len(rows), [0.0] * len(rows)
        full = np.flatnonzero(lengths)
        if len(full) and self.crf.languages:
            at = np.fromiter((self.row[w] for r in rows for w in r), np.int64, int(lengths.sum()))
            m = self.crf.marginals(self.scores[at], lengths[full]) * self.lettered[at][:, None]
            total = np.add.reduceat(m, (np.cumsum(lengths) - lengths)[full])
            for i, t in zip(full.tolist(), total):
                if t.sum() > 0:
                    best = int(t.argmax())
                    names[i], shares[i] = self.crf.languages[best], min(1.0, float(t[best] / t.sum()))
        return names, shares


def fitted(docs: DataFrame) -> Crf:
    """The model, from a bounded sample of labelled training documents."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = known.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # a row a language
    quota = max(LEAST_DOCUMENTS, SAMPLE_DOCUMENTS // max(1, len(languages)))
    keyed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long"), F.xxhash64("text").alias("t"))
    # the first of each language in each partition, so that a language of most rows is not brought to one task
    first = keyed.withColumn("part", F.spark_partition_id())
    for keys in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("long", "h", "doc_id", "t"))
        first = first.withColumn("place", place).where(F.col("place") <= quota)
    ids = F.broadcast(first.select("doc_id", "lang", "t").distinct())
    found = known.withColumn("t", F.xxhash64("text")).join(ids, ["doc_id", "lang", "t"]).dropDuplicates(["doc_id", "lang", "t"])
    sample = found.orderBy("lang", F.xxhash64("doc_id"), "t").select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    return Crf(languages).fit([(r["text"], r["lang"]) for r in sample])


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred and score, the share of its words' marginals."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(model.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            names, shares = [], []
            lo = 0
            while lo < len(texts):  # a few million characters at a time
                hi, size = lo, 0
                while hi < len(texts) and size < 8_000_000:
                    size += len(texts[hi] or "")
                    hi += 1
                n, s = labeller.label(texts[lo:hi])
                names, shares, lo = names + n, shares + s, hi
            out = pdf[["doc_id", "held_out"]].astype({"doc_id": "Int64", "held_out": "boolean"})
            out["lang_pred"], out["score"] = names, shares
            yield out

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
