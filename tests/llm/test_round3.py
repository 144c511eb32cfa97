"""Importance resampling, the piece table and the divergence audit against brute force and SQL, on odd rows and on none."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import both, connection
from pyspark.sql import functions as F
from test_operators import SCHEMA, all_of, as_rows, docs, lower, none, odd, pairs_of  # noqa: F401

from panelforge.llm import divergence, importance, piecetable, queries

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def target(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def plain_resample(rows, texts, longest=1):
    def grams(t):
        w = FEATURE.findall(lower(t))
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(bucket(g) for _, x in rows for g in grams(x)), Counter(bucket(g) for x in texts for g in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, x in rows:
        weight = sum(gain[bucket(g)] for g in grams(x))
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(grams(x)), weight, score, len(FEATURE.findall(lower(x)))])
    order = sorted((r for r in out if r[3] is not None and r[4] >= 20), key=lambda r: (-r[3], r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(order[: 10 * len(order) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in out)


@pytest.mark.parametrize("longest", [1, 2])
def test_importance_resampling(spark, odd, docs, target, longest):  # noqa: F811
    rows = all_of(odd, docs)
    raw = pairs_of(rows)
    got = importance.resample(rows, target.union(spark.createDataFrame([(None, None)], target.schema)), longest=longest)
    assert as_rows(got, "doc_id", "n_features", "weight", "score", "rank") == plain_resample(raw, [r["text"] for r in target.collect()], longest)


def test_importance_of_hot_texts_and_ties(spark, target, monkeypatch):
    """A third of all rows is one text and a third has no id; salted keys give each its weight, once."""
    text = " ".join(f"w{i}" for i in range(30))
    raw = [(i, text) for i in range(60)] + [(None, text + " x")] * 60 + [(7, "one of a kind " * 9)] * 3 + [(i, f"{text} y{i}") for i in range(100, 160)]
    rows = spark.createDataFrame(raw, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(importance, "HOT_SHARE", 4)
    got = importance.resample(rows, target)
    assert as_rows(got, "doc_id", "n_features", "weight", "score", "rank") == plain_resample(raw, [r["text"] for r in target.collect()])
    kept = importance.drawn(rows.withColumn("rank", F.lit("own")), target)
    assert kept.columns == ["doc_id", "text", "rank", "sample_rank"] and kept.select("sample_rank").distinct().count() == kept.select("doc_id").distinct().count() > 0


def plain_audit(rows, least=30, top=50):
    rows = [(lang or "", source or "", TERM.findall(lower(t))) for lang, source, t in rows]
    out = Counter()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for *_, terms in own for t in set(terms))
        kept = sorted(t for t in df if df[t] >= least)
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(t for t in terms if df[t] >= least)
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        all_p, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s, c in counts.items():
            found = {"pair": [(o, sum(abs(all_p[s][t] - all_p[o][t]) for t in kept)) for o in counts if o != s], "term": [(t, all_p[s][t] - q[t]) for t in kept if c[t] and all_p[s][t] > q[t]]}
            for part, items in found.items():
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out[lang, s, part, item, value, rank] += 1
    return out


@pytest.mark.parametrize("least, top", [(30, 50), (1, 5), (3, 1), (10**6, 50)])
def test_divergence_audit(spark, odd, docs, least, top):  # noqa: F811
    rows = all_of(odd, docs)
    got = divergence.audit(rows, least, top)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert as_rows(got, "lang", "source", "part", "item", "value", "rank") == plain_audit([(r["lang"], r["source"], r["text"]) for r in rows.collect()], least, top)


def test_divergence_search_stops_and_keeps_ties(spark, monkeypatch):
    """Ties at the last rank stay by their item; held counts are sent on in parts."""
    rng = random.Random(4)
    vocabulary = [a + b for a in "abcdefghijklm" for b in "nopqrstuvwé"]
    raw = [("xx", f"s{rng.randrange(4)}", " ".join(rng.choices(vocabulary, k=rng.randrange(25)))) for _ in range(300)] + [("xx", "none", None)] * 5
    rows = spark.createDataFrame(raw, "lang string, source string, text string").repartition(3)
    monkeypatch.setattr(divergence, "_HELD", 50)
    for top in (1, 3, 7):
        assert as_rows(divergence.audit(rows, 2, top), "lang", "source", "part", "item", "value", "rank") == plain_audit(raw, 2, top)


@pytest.fixture(scope="module")
def pieces():
    return piecetable.PieceTable(queries.piece_path())


def test_piece_table_equals_the_library(pieces):
    """Spaces of all lengths, marks, scripts, control characters, pieces side by side; alone and many at a time."""
    rng = random.Random(1)
    known, codes = list(pieces.ids), [(32, 127), (0x80, 0x800), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF), (0, 32)]
    texts = ["", " ", "▁", "a" * 5000, " " * 5000, "word" + " " * 17 + "x", "x" + "▁ " * 40, "<s></s><0x41><unk>", "﻿\xa0　é́", *known[:3000]]
    for _ in range(3000):
        texts.append("".join(rng.choice(" ▁ab\t\né漢😀") for _ in range(rng.randrange(60))))
        texts.append("".join(rng.choice(known) for _ in range(rng.randrange(30))).replace("▁", " "))
        texts.append(" " * rng.randrange(70) + rng.choice(known) + " " * rng.randrange(40))
        texts.append("".join(chr(rng.randrange(*rng.choice(codes))) for _ in range(rng.randrange(40))))
    theirs = pieces.lib.encode(texts)
    assert list(pieces.stream(texts)) == theirs
    assert [pieces.encode([t])[0] for t in texts[:200]] == theirs[:200]
    assert [pieces.decode(i) for i in theirs[:500]] == [pieces.lib.decode(i) for i in theirs[:500]]


def test_piece_table_forgets(monkeypatch):
    monkeypatch.setattr(piecetable, "_MEMO", 20)
    monkeypatch.setattr(piecetable, "_PAIRS", 30)
    monkeypatch.setattr(piecetable, "_TOGETHER", 200)
    table = piecetable.PieceTable(queries.piece_path())
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeioutnshrl ,.") for _ in range(rng.randrange(90))) for _ in range(200)]
    assert list(table.stream([*texts, None])) == [*table.lib.encode(texts), []]


def test_each_prefix_has_one_last_piece(pieces):
    """What the table rests on: exactly one piece that ends at a place may follow the last piece before it."""
    rng = random.Random(6)
    for text in ("".join(rng.choice("▁therinaso") for _ in range(14)) for _ in range(60)):
        for n in range(1, len(text) + 1):
            whole = pieces.merged(text[:n])
            ending = [p for p in {text[k:n] for k in range(n)} if p in pieces.ids and pieces.merged(p) == [p]]
            right = [p for p in ending if (before := pieces.merged(text[: n - len(p)])) == [] or pieces.merged(before[-1] + p) == [before[-1], p]]
            assert right == [whole[-1]]


def test_piece_table_query(odd, docs, pieces):  # noqa: F811
    rows = all_of(odd, docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t in pairs_of(rows):
        ids = pieces.lib.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(pieces.lib.decode(ids) if ids else "")] += 1
    assert as_rows(piecetable.digests(rows, queries.piece_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = piecetable.decode(piecetable.encode(odd, queries.piece_path()), queries.piece_path())
    assert as_rows(back, "doc_id", "text") == Counter((i, (t or "").replace("▁", " ")) for i, t in pairs_of(odd))


def test_none(none, target):  # noqa: F811
    assert importance.resample(none, target).collect() == divergence.audit(none).collect() == []
    assert piecetable.digests(none, queries.piece_path()).collect() == []
    assert importance.resample(none, target.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_source_divergence"])
def test_matches_sql(spark, sf_dir, name):
    ours, theirs = both(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connection(sf_dir))
    assert ours == theirs and ours
