"""Findings of round 3 on training-data operators."""

import cProfile
import math
import pstats
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import chain_texts, plain_tree, tokens
from tokenizers import Tokenizer

import corpus_pipeline
from panelforge.llm import bpe, queries, suffixdedup, suffixtree

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def test_a_task_hands_on_small_counters(spark):
    """Tasks with little text hand on little, so that many tasks cost no more memory than few."""
    texts = spark.createDataFrame([(f"one two three {k}".encode(),) for k in range(64)], "text binary").repartition(8)
    counted = texts.mapInPandas(suffixtree._count(4), suffixtree.COUNTED).where("level is not null")
    tasks, size = counted.agg(F.count("*") / (4 * suffixtree._CHUNKS), F.sum(F.length("counts"))).first()
    assert tasks == 8 and size < tasks * 200_000
    folded = counted.groupBy("level", "chunk").applyInPandas(suffixtree._summed, "level int, chunk int, fold int, counts binary")
    assert sum(int(suffixtree._unpacked(r["counts"]).sum()) for r in folded.where("level = 0").collect()) == 64 * 4


def plain_cut(texts, least, words):
    """What is left of texts in ASCII, by comparing all strings and all passages."""
    raws = [t.encode() for t in texts]
    inside = lambda s: len(re.findall(rb"(?<=[\x20\x09-\x0d])[^\x20\x09-\x0d]+(?=[\x20\x09-\x0d])", s))
    strings, passages, spans = {}, {}, [[m.span() for m in WORD.finditer(r)] for r in raws]
    for d, r in enumerate(raws):
        for p in range(len(r) - least + 1):
            if inside(r[p : p + least]) < words:
                strings.setdefault(r[p : p + least], []).append((d, p))
        w = r.lower().split()
        for p in range(len(w) - words + 1):
            passages.setdefault(tuple(w[p : p + words]), []).append((d, p))
    gone = [bytearray(len(r)) for r in raws]
    for d, p in (x for v in strings.values() if len(v) > 1 for x in v):
        gone[d][p : p + least] = b"\1" * least
    for d, p in (x for v in passages.values() if len(v) > 1 for x in v):
        for k in range(p, p + words):
            a, b = spans[d][k][0], spans[d][k + 1][0] if k + 1 < len(spans[d]) else spans[d][k][1]
            gone[d][a:b] = b"\1" * (b - a)
    return ["".join(c for c, g in zip(t, go) if not g) for t, go in zip(texts, gone)]


@pytest.mark.parametrize("seed", range(3))
def test_cuts_by_words_and_bytes_equal_brute_force(spark, seed):
    """Short and long words, any white space, passages just long enough and one word too short, strings without white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.choice([1, 2, 3, 9])))
    gap = lambda: rng.choice([" ", " ", "\n", "  ", "\t"])
    text = lambda ws: "".join(w + gap() for w in ws)
    shared = [[word() for _ in range(n)] for n in (11, 12, 13, 30)] + [["".join(rng.choice("abc") for _ in range(70))]]
    texts = []
    for _ in range(24):
        ws = [word() for _ in range(rng.randrange(5, 30))]
        for s in rng.sample(shared, rng.randrange(3)):
            ws += [w.upper() if rng.random() < 0.1 else w for w in s] + [word() for _ in range(3)]
        texts.append(text(ws))
    texts += ["", "a", " ", texts[0]]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(frame, 60, 12).collect()}
    expected = plain_cut(texts, 60, 12)
    assert [got[k] for k in range(len(texts))] == expected
    assert any(e != t for e, t in zip(expected, texts[1:20])) and any(e == t for e, t in zip(expected, texts))


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Also where they have under 400 bytes; one of 50 words stays."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    long, short = words(51), words(50)
    parts = [(words(80), p, words(80)) for p in (long, long, short, short)]
    frame = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(parts)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, frame, "").collect()}
    assert len(long) < 400
    assert [got[k] for k in range(4)] == [f"{a} {b}" for a, _, b in parts[:2]] + [" ".join(p) for p in parts[2:]]


@pytest.mark.parametrize("hot", [1 << 20, 20, 0])
def test_contexts_stay_however_large_the_corpus(spark, monkeypatch, hot):
    """A context seen eight times is kept where it is a small share of all tokens too; weights are broadcast or joined."""
    monkeypatch.setattr(suffixtree, "GRAM_SHARE", 2e-3, raising=False)  # the floor there was: 30 occurrences in this corpus
    monkeypatch.setattr(suffixtree, "WORD_SHARE", 2e-2)
    monkeypatch.setattr(suffixtree, "HOT_SEQUENCES", hot, raising=False)
    texts = chain_texts(3, 300)
    learned = [tokens(x) for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    tree, probability, _ = plain_tree(learned, 4, 8)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(frame).collect()}
    for i, x in enumerate(texts):
        t = tokens(x)
        want = sum(math.log10(probability(tuple(t[max(0, k - 4) : k]), t[k])) for k in range(len(t)))
        assert abs(got[i] - want) < 1e-6, i


def test_the_encoder_takes_words_by_batches():
    """Python's own work for a distinct word stays small, and odd characters get the library's ids."""
    rng = random.Random(5)
    odd = ["", "\0a b", "a\0b c\0 d", "é́ ñ日本 <|endoftext|> x's\tq", "a\nb c\n\nd  e", *("".join(rng.choices("ab é\0\n\t'12日.!<>|s", k=60)) for _ in range(200))]
    path = queries.bpe_path()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_stream(odd, path)] == [[*library.encode(x, add_special_tokens=False).ids, 0] for x in odd]
    text, profile = " ".join(f"wort{k}é" for k in range(20_000)), cProfile.Profile()
    encoder = bpe.ChunkedBpe(path, 100_000)
    profile.enable()
    encoder.encode([text])
    profile.disable()
    assert pstats.Stats(profile).total_calls < 5 * 20_000


def test_lookups_are_handed_on_by_ranges(spark, monkeypatch):
    """Where no weight is broadcast, neither what tasks have counted nor what texts look up is a row for each word or sequence."""
    made = {}

    def recorded(df, name, put=suffixtree.materialise):
        made[name] = put(df, name)
        return made[name]

    monkeypatch.setattr(suffixtree, "materialise", recorded)
    monkeypatch.setattr(suffixtree, "WORD_SHARE", 2e-2)
    monkeypatch.setattr(suffixtree, "HOT_SEQUENCES", 0)
    texts = chain_texts(4, 600)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert suffixtree.score(frame).count() == 600
    ranges = 64
    assert made["scored"].count() <= 600 + 3 * 2 * ranges, "36600 tokens, most of which look up a word and several sequences"
    words = {w for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in x.split()}
    assert made["counted"].count() <= (1 + suffixtree.COUNTED_LEVELS) * ranges + len(words) + 1


def test_factors_of_words_that_are_looked_up(spark, monkeypatch):
    """Where no word is broadcast, contexts of one word keep their factors, whatever their hashes."""
    monkeypatch.setattr(suffixtree, "WORD_SHARE", 1.0)
    texts = chain_texts(6, 200)
    tree, probability, _ = plain_tree([tokens(x) for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10], 2, 8)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["score"] for r in suffixtree.score(frame, 2).collect()}
    assert any(len(c) == 1 for c in tree)
    for i, x in enumerate(texts):
        t = tokens(x)
        assert abs(got[i] - sum(math.log10(probability(tuple(t[max(0, k - 2) : k]), t[k])) for k in range(len(t)))) < 1e-6, i
