"""The training-data operators against brute force, on the smallest tables and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import crf, decontaminate, packing, quality, queries, shinglejoin, suffixdedup, suffixtree, templates, tokenfiles, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, n string, runs string, part string, tile string, text_key string, `class` string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, symbols of all widths, a very long text."""
    rng = random.Random(3)
    base = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(150))
    near = base.split()
    near[70] = "other"
    texts = [None, "", " \t\n", "one", "One two", "a b c d e", base, base, base.upper(), " ".join(near), "é 漢字 😀 z y\x1cw", "x " * 3000, "😀" * 300, "long " + " ".join(str(rng.randrange(10**6)) for _ in range(20_000))]
    rows = [(i * 7 + 1, t, "en" if i % 2 else None, "s", None, *["clash"] * 8) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, base, None, None, None, *[None] * 8), (None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def as_rows(frame, *names):
    return Counter(tuple(r[c] for c in names) for r in frame.select(*names).collect())


def all_of(odd, docs):
    return odd.unionByName(docs, allowMissingColumns=True)


# 1


def tokens(text):
    return [w.encode() for w in words(lower(text))] + [None]


def test_suffix_tree_counts_and_base(odd, docs):
    rows = all_of(odd, docs)
    got = suffixtree.score(rows)
    raw = pairs_of(rows)
    held = [None if i is None else zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in raw]
    count = Counter(t for (_, x), h in zip(raw, held) if h is False for t in tokens(x))
    n, v = sum(count.values()), len(count)
    want = Counter((i, h, len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), 6)) for (i, x), h in zip(raw, held))
    assert as_rows(got.withColumn("b", F.round("base_score", 6)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b") == want
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1], "contexts help on texts that were not learned from"


def plain_tree(texts, depth, least):
    """Retained contexts by dictionaries: context -> (probabilities of its entries, factor of its parent for others)."""
    count = [Counter() for _ in range(depth + 2)]
    for x in texts:
        for n in range(1, depth + 2):
            count[n].update(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
    total, size = sum(count[1].values()), len(count[1])
    root = {w: (c + 0.1) / (total + 0.1 * (size + 1)) for (w,), c in count[1].items()}
    frequent = [None] + [{g for g, c in count[n].items() if c >= least} for n in range(1, depth + 2)]
    tree = {}

    def probability(context, symbol):
        context = next((context[k:] for k in range(len(context) + 1) if context[k:] in tree), ())
        if not context:
            return root.get(symbol, 0.1 / (total + 0.1 * (size + 1)))
        entries, factor = tree[context]
        return entries[symbol] if symbol in entries else factor * probability(context[1:], symbol)

    for k in range(1, depth + 1):
        by = defaultdict(dict)
        for g in frequent[k + 1]:
            by[g[:-1]][g[-1]] = count[k + 1][g]
        grown = {}
        for c, nexts in by.items():
            p = {s: (n - 0.5) / count[k][c] for s, n in nexts.items()}
            q = {s: probability(c[1:], s) for s in nexts}
            rest, left = 1 - sum(p.values()), 1 - sum(q.values())
            if rest > 0 and left > 0 and count[k][c] * (sum(v * math.log(v / q[s]) for s, v in p.items()) + rest * math.log(rest / left)) > 0.5 * len(p) * math.log(max(total, 2)):
                grown[c] = (p, rest / left)
        tree |= grown
    return tree, probability, root


def chain_texts(seed, n):
    """Texts in which the next word depends on up to three words before."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        x = ["a", "b"]
        while len(x) < 60:
            x.append("d" if x[-3:] == ["c", "a", "b"] else "c" if x[-2:] == ["a", "b"] and rng.random() < 0.7 else rng.choice("abcde") if rng.random() < 0.97 else f"w{rng.randrange(500)}")
        out.append(" ".join(x))
    return out


def test_suffix_tree_scores_equal_a_plain_tree(spark):
    texts = chain_texts(1, 300)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    learned = [tokens(x) for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    for depth in (1, 4):
        tree, probability, _ = plain_tree(learned, depth, 8)
        assert max(map(len, tree)) == (1 if depth == 1 else 3) or depth > 1 and max(map(len, tree)) > 2
        got = {r["doc_id"]: r["score"] for r in suffixtree.score(frame, depth).collect()}
        for i, x in enumerate(texts):
            t = tokens(x)
            want = sum(math.log10(probability(tuple(t[max(0, k - depth) : k]), t[k])) for k in range(len(t)))
            assert abs(got[i] - want) < 1e-6, (depth, i)


def test_sequence_hashes_are_undone():
    t = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = suffixtree.grams(t, 4)
    assert (suffixtree._unmixed(h[0]) == t).all()
    for n in (1, 2, 3):
        assert (suffixtree.context_of(h[n][n:], t[n:]) == h[n - 1][n - 1 : -1]).all()


def test_suffix_tree_probabilities_sum_to_one():
    tree, probability, root = plain_tree([tokens(x) for x in chain_texts(2, 200)], 4, 8)
    unseen = 1 - sum(root.values())
    for context in list(tree)[:50]:
        others = 1.0
        for k in range(len(context)):  # the factor of a word that has no entry anywhere
            if context[k:] in tree:
                others *= tree[context[k:]][1]
        assert abs(sum(probability(context, s) for s in root) + unseen * others - 1) < 1e-9


# 2 and 8


def ids_of(text):
    from tokenizers import Tokenizer

    tok = ids_of.__dict__.setdefault("tok", Tokenizer.from_file(queries.bpe_path()))
    tok.encode_special_tokens = True
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_packing(odd, docs):
    rows = all_of(odd, docs)
    got = packing.pack(rows, queries.bpe_path(), with_ids=True).toPandas()
    assert all(zlib.crc32(x) == c for x, c in zip(got["ids"], got["ids_crc32"])) and all(len(x) == 4 * n for x, n in zip(got["ids"], got["length"]))
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 1024
    n = got["sequence_id"].nunique()
    assert got["length"].sum() > 0.97 * 1024 * (n - 1) and (got["sequence_id"] >= 0).all()
    want, have = Counter(), Counter()
    for i, x in pairs_of(rows):
        ids = ids_of(x)
        want.update((i, k, int(t)) for k, t in enumerate(ids))
    for r in got.itertuples():
        i = None if pd.isna(r.doc_id) else int(r.doc_id)
        have.update((i, r.start + k, int(t)) for k, t in enumerate(np.frombuffer(r.ids, "<u4")))
    assert want == have


def test_token_files(spark, odd, docs, tmp_path):
    rows = all_of(odd, docs)
    folder = f"file://{tmp_path}/tokens"
    tokenfiles.write(rows, folder, queries.bpe_path(), docs_a_file=50)
    got = tokenfiles.read(spark, folder, with_ids=True).toPandas().sort_values("start", ignore_index=True)
    assert got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]
    known = got["doc_id"].dropna().tolist()
    assert known == sorted(known) and got["doc_id"].isna().head(2).all()
    want = Counter((i, ids_of(x).tobytes()) for i, x in pairs_of(rows))
    assert Counter((None if pd.isna(i) else int(i), b) for i, b in zip(got["doc_id"], got["ids"])) == want
    files = {r["shard"]: r["file"] for r in spark.read.parquet(f"{folder}/manifest").collect()}
    for r in got[got["doc_id"].notna()].sample(5, random_state=1).itertuples():
        once = (got["doc_id"] == r.doc_id).sum() == 1
        if once:
            assert tokenfiles.read_document(folder, files[r.shard], int(r.doc_id)).tobytes() == r.ids


def test_token_files_find_damage(tmp_path):
    import io

    raw = tokenfiles.file_bytes([(k, np.arange(k * 100 + 1, dtype="<u4").tobytes()) for k in range(20)], ids_a_frame=256)
    reader = tokenfiles.FrameReader(io.BytesIO(raw), len(raw))
    assert len(reader.frames) > 10 and reader.ids(7) == np.arange(701, dtype="<u4").tobytes()
    broken = bytearray(raw)
    broken[5] ^= 0xFF
    with pytest.raises(Exception):
        tokenfiles.FrameReader(io.BytesIO(bytes(broken)), len(raw)).frame(0)


def test_token_files_of_an_empty_table(spark, none, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert tokenfiles.write(none, folder, queries.bpe_path()).collect() == []
    assert tokenfiles.read(spark, folder).collect() == []


def test_a_document_is_read_from_its_frames_alone():
    """Bytes that are fetched after the seek table are those of the frames which hold the document."""
    import io

    raw = tokenfiles.file_bytes([(k, np.arange(k * 100 + 1, dtype="<u4").tobytes()) for k in range(20)], ids_a_frame=256)
    reader = tokenfiles.FrameReader(io.BytesIO(raw), len(raw))
    fetched, at = [], reader._at
    reader._at = lambda place, n: fetched.append((place, n)) or at(place, n)
    for i in (0, 3, 19):
        fetched.clear()
        reader.kept = (-1, b"")
        ids = reader.ids(i)
        low, high = 4 * int(reader.starts[i]), 4 * int(reader.ends[i])
        held = [k for k in range(len(reader.frames)) if reader.first[k] < high and reader.first[k + 1] > low]
        assert ids == np.arange(i * 100 + 1, dtype="<u4").tobytes() and fetched == [(int(reader.place[k]), reader.frames[k][0]) for k in held] and len(held) < len(reader.frames)


# 3


def page(title, body, site="s"):
    return (
        f"<html><head><title>{title}</title><script>var x = '<p>no</p>';</script></head><body><header class='site-header'><h1>{site} daily</h1></header>"
        f"<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='cookie-banner'>We use cookies</div>"
        f"<article><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}<div class='ad'>Buy now</div></article>"
        f"<aside>Popular: a, b</aside><div id='comments'><p>Nice post</p></div><footer>© {site} all rights reserved</footer></body></html>"
    )


def test_template_extraction(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        body = [" ".join(rng.choice("river stone cloud amber forest winter lantern harbor".split()) for _ in range(12)) + " &amp; <b>so</b>\n on" for _ in range(3)]
        want = " ".join([f"Story {k}", *(b.replace("&amp;", "&").replace("<b>so</b>\n", "so") for b in body)])
        rows.append((k, f"https://h{k % 2}.example/{k}", page(f"Story {k}", body), want))
    rows += [(100, None, None, ""), (101, "x", "", ""), (102, "https://h0.example/t", "<p>unclosed <!-- c", "unclosed"), (103, "https://solo.example/", page("Alone", ["one two three four five six"]), "Alone one two three four five six")]
    rows += [(104, "https://q.example/", "<article><p title=\"abc>Hello world</p>", "Hello world"), (105, None, page("Else", ["seven six five four three two one"]), "Else seven six five four three two one")]
    rows += [(106, "https://long.example/", "<article>" + "<p>word &lt;</p>\n" * 60_000 + "</article>", " ".join(["word <"] * 60_000)), (107, "https://h0.example/u", "<div " * 2000, "")]
    rows = [(*r, "clash", 7) for r in rows]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, _h string, _salt string, _part int")
    got = {r["page_id"]: r for r in templates.main_text(frame).collect()}
    assert len(got) == len(rows)
    for k, url, _, want, *_ in rows:
        assert (got[k]["url"], got[k]["text"], got[k]["n_chars"]) == (url, want, len(want))
    assert templates.main_text(frame.limit(0)).count() == 0
    again = templates.main_text(frame.where("page_id in (1, 100)").unionByName(frame.where("page_id in (1, 100)")))
    assert as_rows(again, "page_id", "n_chars") == Counter({(1, got[1]["n_chars"]): 2, (100, 0): 2})


def test_template_extraction_of_pages_without_anything(spark):
    kind = "page_id long, url string, html string, text string, _h string"
    rows = [(None, None, None, "clash", "clash")] * 3 + [(k, "https://a.example/x", None if k % 2 else "", None, None) for k in range(20)] + [(50, None, "<p>", None, None), (51, "", "no markup", None, None), (51, "", "no markup", None, None)]
    got = templates.main_text(spark.createDataFrame(rows, kind).repartition(4)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(r["text"] == "" for r in got if r["page_id"] not in (51,)) and Counter(r["page_id"] for r in got)[None] == 3


def test_template_of_a_host_of_most_pages(spark):
    """A host with over a share of all pages is salted; its boilerplate, of no listed name, still goes from every page."""
    frame = spark.range(1200).selectExpr("id as page_id", "if(id % 12 = 0, concat('https://small', id % 24, '.example/'), 'https://big.example/') as url", "concat('<article><p>', id, ' tells of number ', id * 7919 % 1200, '</p><p>Ask at our desk</p></article>') as html")
    out = templates.main_text(frame)
    assert {(r["page_id"], r["text"]) for r in out.collect()} == {(k, f"{k} tells of number {k * 7919 % 1200}") for k in range(1200)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_h#" in plan and ", _salt#" in plan


def test_template_decides_inside_articles(spark):
    """Boilerplate of no listed name goes; text that varies stays though its element's names are listed; repeats are no evidence."""
    rng = random.Random(11)
    rows = []
    for k in range(40):
        a, b, c = (" ".join(rng.choice("river stone cloud amber forest winter lantern harbor".split()) + str(rng.randrange(50)) for _ in range(14)) for _ in range(3))
        html = (
            f"<body><nav><a href='/'>Home</a></nav><article id='post-{k}'><header class='article-header'><h1>Story {k}</h1></header><p>{a}</p>"
            f"<p>Members read every story without waiting</p><div class='legal'><p>{b}</p></div><div class='ad'>Buy {rng.randrange(10**6)}</div><p>{c}</p>"
            f"<section>Call our desk on weekdays</section></article><footer>{rng.randrange(10**6)} visits</footer></body>"
        )
        rows.append((k, f"https://inside.example/{k}", html, f"Story {k} {a} {b} {c}"))
    alike = "<article><p>one page that is kept many times</p></article>"
    rows += [(1000 + k, "https://same.example/", alike, "one page that is kept many times") for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert got == {k: want for k, _, _, want in rows}


def sentences(rng, n, words=14):
    return [" ".join(rng.choice("river stone cloud amber forest winter lantern harbor".split()) + str(rng.randrange(50)) for _ in range(words)) for _ in range(n)]


def test_template_keeps_what_repeats_in_running_text(spark):
    """Headings that lead to text stay on a small host too, and so does a paragraph that half the pages share; what every page has goes."""
    rng = random.Random(12)
    rows = []
    for k in range(12):
        a, b, c, d = sentences(rng, 4)
        shared = "<p>This passage stands in half of the articles of the host</p>" if k % 2 else ""
        html = (
            f"<body><header><h1>The daily harbor</h1></header><article class='w-1/2'><h1>Story {k}</h1><h2>Introduction</h2><p>{a}</p><p>{b}</p>{shared}<h2>Conclusion</h2><p>{c}</p>"
            f"<p>Follow us for daily updates of this and of all other stories</p><h3>Leave a word</h3><form><p>Name</p></form>"
            f"<section class='comments'><h3>Comments</h3><p>{d}</p></section></article><footer>{k} visits</footer></body>"
        )
        mid = f" {shared[3:-4]}" if shared else ""
        rows.append((k, "https://twelve.example/x", html, f"Story {k} Introduction {a} {b}{mid} Conclusion {c}"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert got == {k: want for k, _, _, want in rows}


def test_template_decides_without_names(spark):
    """Pages of two layouts without article elements, classes, ids or telling elements: only what varies, and how, is left to go by."""
    rng = random.Random(13)
    rows = []
    for k in range(60):
        a, b, c = sentences(rng, 3)
        tip = " ".join(rng.sample("buy now at our shop for less today".split(), 6))
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample("home news sport arts food maps help jobs".split(), 5))
        text = f"<div><h2>Story {k}</h2><p>{a}</p><p>{b}</p><ul><li>{c}</li></ul></div>" if k % 3 else f"<table><tr><td><p>{a}</p><p>{b}</p><p>{c}</p></td></tr></table>"
        html = f"<body><div><ul>{menu}</ul></div><div>{tip}</div>{text}<div>Made by us &middot; {rng.randrange(10**6)} visits</div></body>"
        rows.append((k, "https://plain.example/x", html, f"Story {k} {a} {b} {c}" if k % 3 else f"{a} {b} {c}"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r["page_id"]: r["text"] for r in templates.main_text(frame).collect()}
    assert got == {k: want for k, _, _, want in rows}


def test_template_gives_the_tables_text_without_names(spark):
    """On the table, erasing every class and id and turning article, nav and the like into plain elements leaves each text as it is."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", r"(</?)(nav|article|footer|aside|header|main|section)\b", "$1div"), r'\s(class|id|role)="[^"]*"', "")
    big = pages.groupBy(F.regexp_extract("url", "://([^/]*)", 1).alias("host")).agg(F.collect_list("page_id").alias("ids")).where(F.size("ids") >= 2 * templates.LEAST_PAGES)
    ids = {i for r in big.collect() for i in r["ids"]}
    with_names, without = ({r["page_id"]: r["text"] for r in templates.main_text(x).collect()} for x in (pages, pages.withColumn("html", plain)))
    assert len(ids) > 2000 and all(without[i] == with_names[i] for i in ids)


# 4


def shingle_set(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components_of(raw):
    sets = defaultdict(set)
    for i, x in raw:
        if i is not None:
            sets[i].add(shingle_set(x))
    distinct = {s for v in sets.values() for s in v if s}
    boss = {i: i for i in sets}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    owner = defaultdict(list)
    for i, v in sets.items():
        for s in v:
            owner[s].append(i)
    by = defaultdict(set)
    for s in distinct:
        for g in s:
            by[g].add(s)
    near = {(p, q) for g in by.values() if len(g) < 400 for p in g for q in g if p is not q}
    links = [(p, q) for p, q in near if 100 * len(p & q) >= 80 * len(p | q)]
    for i, j in [(o[0], x) for s, o in owner.items() if s for x in o] + [(owner[p][0], owner[q][0]) for p, q in links]:
        a, b = sorted((top(i), top(j)))
        boss[b] = a
    return {i: top(i) for i in sets}


def test_shingle_join(odd, docs):
    rows = all_of(odd, docs)
    raw = pairs_of(rows)
    component = components_of(raw)
    want = Counter((i, len(shingle_set(x)), component.get(i)) for i, x in raw)
    assert as_rows(shinglejoin.similar_groups(rows), "doc_id", "n_shingles", "component_id") == want
    texts = sorted({x or "" for i, x in raw if i is None})
    own = [(10**15 + texts.index(x or "") if i is None else i, i, x) for i, x in raw]  # rows without id come last, one for all of a text
    component = components_of([(o, x) for o, _, x in own])
    left = shinglejoin.one_of_each(rows)
    assert as_rows(left, "doc_id", "text") == Counter((i, x) for o, i, x in set(own) if component[o] == o)
    assert left.columns == rows.columns


def test_places_bound_intersections():
    """Of random pairs of sets, no linked pair is dropped from the tile of its first common shingle."""
    rng, kept = np.random.default_rng(5), 0
    for _ in range(3000):
        n = int(rng.integers(1, 400))
        a = rng.permutation(1000)[:n]
        b = np.union1d(a[: int(n * rng.uniform(0.7, 1))], rng.permutation(1000)[: int(n * rng.uniform(0, 0.2))])
        a, b = np.sort(a), np.sort(b)
        both = np.intersect1d(a, b)
        linked = len(both) and 100 * len(both) >= 80 * len(np.union1d(a, b))
        if len(both):
            place = np.concatenate([shinglejoin._place(len(x), np.searchsorted(x, both[:1])) for x in (a, b)])
            keep = shinglejoin._with_partner(place, np.zeros(1, np.int64), np.array([2]), 80)
            assert keep.all() or not linked
            kept += bool(linked)
    assert kept > 300


def test_shingle_join_on_large_near_groups(spark):
    """Groups of near copies around the limit, larger than a leaf of the tree."""
    rng = random.Random(11)
    rows, k = [], 0
    for _ in range(3):
        base = [str(rng.randrange(10**6)) for _ in range(120)]
        for _ in range(130):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = str(rng.randrange(10**6))
            rows.append((k, " ".join(w)))
            k += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    component = components_of(rows)
    assert as_rows(shinglejoin.similar_groups(frame), "doc_id", "component_id") == Counter((i, c) for i, c in component.items())


# 5


def plain_words(text):
    return words(re.sub(r"[!-/:-@\[-`{-~]+", "", lower(text)))


def best_stretch(doc, item):
    w, best = min(decontaminate.WINDOW, len(item)), 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= shift + j < len(doc) and doc[shift + j] == x for j, x in enumerate(item)]
        best = max([best, *(sum(same[k : k + w]) for k in range(len(item) - w + 1))])
    return best, w


def test_decontamination(spark, odd):
    rng = random.Random(2)
    pick = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [pick(n) for n in (8, 9, 13, 14, 30, 60, 3)]
    rows, planted = [], set()
    for k in range(80):
        doc = pick(rng.choice([5, 40, 200]))
        item = rng.randrange(len(items) - 1)
        if k % 2 == 0:
            x = list(items[item])
            for _ in range(k % 3):
                x[rng.randrange(len(x))] = "changed"
            at = rng.randrange(len(doc))
            doc[at:at] = x
            planted.add((k, item)) if k % 6 == 0 else None
        rows.append((k, " ".join(doc).capitalize() + "."))
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(90, None), (91, ""), (None, " ".join(items[2]))], "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.overlaps(frame, bench).where("item_id is not null")
    found = {(r["doc_id"], r["item_id"]): (r["n_same"], r["n_window"]) for r in got.collect()}
    for (d, i), (same, w) in found.items():
        assert best_stretch(plain_words(rows[d][1]), plain_words(" ".join(items[i])))[0] >= same >= math.ceil(0.75 * w)
    assert planted <= set(found)
    clean = {r["doc_id"] for r in decontaminate.clean_documents(frame, bench).collect()}
    assert clean == set(range(80)) - {d for d, _ in found}
    assert decontaminate.overlaps(odd, bench).count() == 0 and decontaminate.clean_documents(odd, bench).count() == odd.count()
    assert decontaminate.overlaps(frame.limit(0), bench).count() == 0 and decontaminate.overlaps(frame, bench.limit(0)).count() == 0


def test_masks_hit_all_substitutions():
    for n in range(1, decontaminate.WINDOW + 1):
        for differ in itertools.combinations(range(n), n - math.ceil(decontaminate.IDENTITY * n)):
            hits = [m for m in decontaminate.MASKS[n] for k in range(n - len(m) + 1) if all(c == "0" or k + j not in differ for j, c in enumerate(m))]
            assert hits, (n, differ)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SEEDS, 0])
def test_decontamination_finds_what_brute_force_finds(spark, monkeypatch, broadcast):
    """Stretches of items of all lengths, with substitutions up to and beyond the rule, in documents of other words."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    rng = random.Random(4)
    pick = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [pick(n) for n in [*range(1, 20), 40]]
    texts = []
    for k in range(400):
        item = items[k % len(items)]
        n = min(len(item), decontaminate.WINDOW)
        at = rng.randrange(len(item) - n + 1)
        part = item[at : at + n]
        for j in rng.sample(range(n), min(n, rng.choice([0, n // 4, n // 4, n // 4 + 1]))):
            part[j] = "other"
        texts.append(pick(rng.randrange(4)) + part + pick(rng.randrange(4)))
    frame = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(99, ""), (98, None)], "item_id long, text string")
    want = {}
    for (k, doc), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        same, n = best_stretch(doc, item)
        if same >= math.ceil(decontaminate.IDENTITY * n):
            want[k, i] = same
    got = {(r["doc_id"], r["item_id"]): r["n_same"] for r in decontaminate.overlaps(frame, bench).collect()}
    assert got == want and len(want) > 200


# 6


def base_measures(text):
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, sf_dir, odd, docs):
    rows, labels = all_of(odd, docs), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.quality(rows, labels).cache()
    want = Counter()
    for i, x in pairs_of(rows):
        m = base_measures(x)
        want[(i, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert as_rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("kept and (base_failed or score < -0.07) or not kept and not base_failed and score >= -0.07").count() == 0

    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    hash1 = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)

    def grams(text):
        w = words(text)
        for a, b in zip(w, [*w[1:], ""]):
            yield signed(hash1(a)) % quality.BUCKETS
            yield signed(xxhash.xxh64_intdigest(b.encode(), hash1(a))) % quality.BUCKETS

    every, target = Counter(), Counter()
    for i, x in pairs_of(rows):
        every.update(g := list(grams(x)))
        target.update(g if i in good else [])
    n, t = sum(every.values()), sum(target.values())
    ratio = {b: math.log((target[b] + quality.BUCKETS * c / n) / (t + quality.BUCKETS) / (c / n)) for b, c in every.items()}
    mean = lambda x: round(sum(ratio[b] for b in grams(x)) / (2 * len(words(x))), 6) + 0.0 if words(x) else 0.0
    got_scores = as_rows(got.withColumn("s", F.round("score", 6) + 0.0), "doc_id", "s")
    assert got_scores == Counter((i, mean(x)) for i, x in pairs_of(rows))
    kept = as_rows(got.where("kept"), "doc_id")
    assert as_rows(quality.kept_documents(rows, labels), "doc_id") == kept
    assert quality.kept_documents(rows, labels).columns == rows.columns
    assert quality.quality(rows.limit(0), labels).count() == 0 and quality.quality(rows, labels.limit(0)).where("abs(score) > 1e-9").count() == 0


# 7


def removals(texts, least):
    seen = Counter()
    raws = [(x or "").encode() for x in texts]
    for r in raws:
        seen.update(hashlib.blake2b(r[i : i + least], digest_size=8).digest() for i in range(len(r) - least + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - least + 1):
            if seen[hashlib.blake2b(r[i : i + least], digest_size=8).digest()] > 1:
                gone[i : i + least] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_array_dedup(odd, docs):
    rows = all_of(odd, docs)
    raw = pairs_of(rows)
    want = Counter((i, *m) for (i, _), m in zip(raw, removals([x for _, x in raw], 400)))
    got = suffixdedup.removed(rows)
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_dedup_of_shared_passages(spark, seed):
    """Passages at many places, over many blocks of one anchor, and periodic text."""
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.choice([60, 90, 140]))) for _ in range(4)]
    texts = []
    for k in range(300):
        parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(30))) + (rng.choice(passages) if rng.random() < 0.8 else "") for _ in range(3)]
        texts.append("".join(parts) if k % 50 else "ab" * rng.randrange(200))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = Counter((i, *m) for i, m in enumerate(removals(texts, 50)))
    assert as_rows(suffixdedup.removed(frame, 50), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    cut = {r["doc_id"]: r["text"] for r in suffixdedup.without_repeats(frame, 50).collect()}
    assert len(cut) == len(texts) and all(len(cut[i]) <= len(x) for i, x in enumerate(texts))


def test_suffix_array_dedup_over_several_shards(spark):
    """More surroundings of one passage than a shard and a span take, so that shards are merged; a passage of 410 bytes, one of 399."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    long, short = text(410), text(399)
    texts = [text(rng.randrange(300)) + (long if k > 1 else f"{k}{short}{k}") + text(rng.randrange(300)) for k in range(suffixdedup.SHARD_BLOCKS * (suffixdedup.SPAN_SHARDS + 3))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = suffixdedup.removed(frame)
    want = Counter((i, *m) for i, m in enumerate(removals(texts, 400)))
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert {r["n_removed"] > 0 for r in got.where("doc_id > 1").collect()} == {True}
    kept = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert all(long not in t for t in kept.values()) and kept[0] == texts[0] and kept[1] == texts[1]
    assert suffixdedup._spans(suffixdedup.SPAN_SHARDS) == 1 and suffixdedup._spans(suffixdedup.SPAN_SHARDS + 1) == 2


def test_suffix_array_dedup_without_repeats(spark):
    """Passages of under ``least`` bytes share anchors, and nothing repeats."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = [text(300) for _ in range(3)]
    frame = spark.createDataFrame([(k, text(400) + shared[k % 3] + text(400)) for k in range(9)], "doc_id long, text string")
    got = suffixdedup.removed(frame)
    assert got.where("n_removed = 0 and n_spans = 0 and n_bytes = 1100").count() == 9


def test_suffix_array_dedup_of_rows_that_repeat(spark):
    """A third of the rows is one row without id, a third has one text, and the others share parts of it."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    row, hot = text(900), text(1200)
    rows = [(None, row)] * 100 + [(k, hot) for k in range(100)] + [(k, text(100) + (row if k % 2 else hot)[k : k + 380 + k % 60] + text(100)) for k in range(100, 200)]
    got = suffixdedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    want = Counter((i, *m) for (i, _), m in zip(rows, removals([x for _, x in rows], 400)))
    assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_merge_compares_both_numbers():
    kind = [("a", np.uint64), ("b", np.uint64)]
    lists = [[(1, 1), (1, 2), (5, 5)], [(1, 2), (1, 3), (5, 6)], [(1, 3), (9, 9)]]
    rows = [{"anchor": 7, "digests": np.array(d, kind).tobytes(), "owners": np.full(len(d), k, np.int64).tobytes(), "starts": np.arange(len(d), dtype=np.int32).tobytes()} for k, d in enumerate(lists)]
    got = suffixdedup._merge(pd.DataFrame(rows))
    assert got.to_dict("records") == [{"anchor": 7, "block": 0, "run_first": [1], "run_last": [1]}, {"anchor": 7, "block": 1, "run_first": [0], "run_last": [1]}, {"anchor": 7, "block": 2, "run_first": [0], "run_last": [0]}]


def test_suffix_array_is_sorted():
    rng = random.Random(9)
    for n in (1, 2, 50, 700):
        raw = bytes(rng.choice(b"ab") for _ in range(n))
        x = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
        order = suffixdedup.suffix_array(x, n)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffixdedup.common_prefixes(x, order)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            assert lcp[k] == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


# 9


def test_url_filter(spark):
    day = lambda d: pd.Timestamp(f"2024-0{d // 30 + 1}-{d % 30 + 1:02d}").date() if d < 59 else None
    entries = [("a", "h:x.org", "add", day(3)), ("a", "h:x.org", "remove", day(9)), ("a", "h:x.org", "add", day(9)), ("b", "h:sub.x.org", "add", day(5)), ("c", "p:x.org/p/q", "add", day(1)), ("c", None, "add", day(1)), (None, "h:x.org", "add", day(1)), ("d", "h:x.org", "add", None)]
    deep = "/".join(str(k) for k in range(30))
    entries.append(("deep", f"p:x.org/{deep}", "add", day(1)))
    captures = [(k, u, day(d)) for k, (u, d) in enumerate([(u, d) for u in ("http://x.org/", "https://user@sub.x.org:80/p/q/r?z", "http://x.org/p/q", f"http://x.org/{deep}/more", "http://other.org", "nonsense", None, "") for d in (2, 3, 6, 9, 20)])]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at date")
    listed = spark.createDataFrame(entries, "list string, key string, action string, effective_at date")
    got = {r["page_id"]: (r["lists"], r["n_active"], r["blocked"]) for r in urlfilter.evaluate(frame, listed).collect()}
    for k, u, d in captures:
        want = set()
        host = re.match(r"\w+://(?:[^/@]*@)?([^/:]+)", u or "")
        host, path = (host[1], re.sub(r"\?.*", "", re.sub(r"^\w+://[^/]*", "", u))) if host else ("", "")
        if (host == "x.org" or host.endswith(".x.org")) and day(3) <= d < day(9):
            want.add("a")
        if host == "sub.x.org" and d >= day(5):
            want.add("b")
        if host == "x.org" and path.startswith("/p/q"):
            want.add("c")
        if host == "x.org" and path.startswith(f"/{deep}"):
            want.add("deep")
        assert got[k] == (",".join(sorted(want)), len(want), bool(want)), (u, d)
    assert urlfilter.evaluate(frame, listed.limit(0)).where("blocked").count() == 0 and urlfilter.evaluate(frame.limit(0), listed).count() == 0


def test_url_filter_on_hot_hosts_nulls_and_clashing_names(spark):
    """One host with most captures, many without URL or time, a long path and columns named as the operator's own."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        url = "if(id % 3 = 0, null, concat(if(id % 5 = 0, 'http://a.b.c.hot.org/', 'http://hot.org/'), if(id % 7 = 0, 'p/q', repeat('x/', 2000))))"
        frame = spark.range(600).selectExpr("id as page_id", f"{url} as url", "if(id % 4 = 0, null, date'2024-01-05') as fetched_at", "'u' as _u", "id as _spread", "'h' as host", "id as _c0", "'k' as key", "map(1, 2) as m")
        listed = spark.createDataFrame([("a", "h:b.c.hot.org", "add", pd.Timestamp("2024-01-01").date()), ("p", "p:hot.org/p", "add", pd.Timestamp("2024-01-01").date())], "list string, key string, action string, effective_at date")
        got = urlfilter.evaluate(frame, listed)
        assert got.columns == ["page_id", "url", "fetched_at", "_u", "_spread", "_c0", "key", "m", "host", "n_active", "lists", "blocked"]
        rows = {r["page_id"]: r for r in got.collect()}
        assert len(rows) == 600
        for k, r in rows.items():
            seen = k % 3 and k % 4
            want = [n for n, c in (("a", k % 5 == 0), ("p", k % 5 and k % 7 == 0)) if seen and c]
            assert (r["lists"], r["n_active"], r["_spread"], r["_c0"]) == (",".join(want), len(want), k, k)
            assert r["host"] == (None if k % 3 == 0 else "a.b.c.hot.org" if k % 5 == 0 else "hot.org")
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_url_filter_matches_sql(spark, sf_dir):
    from oracle import both, connection

    ours, theirs = both(queries.op9_temporal_url_filter(spark, sf_dir), queries.OP9_SQL, connection(sf_dir))
    assert ours == theirs


# 10


def test_language_of_held_out_documents(odd, docs):
    got = crf.identify(all_of(odd, docs)).toPandas()
    known = docs.select("doc_id", "lang", "text").toPandas()
    both = got[got["held_out"] == True].merge(known.dropna(subset=["lang"]), on="doc_id")  # noqa: E712
    both = both[both["lang_pred"] != "und"]
    assert len(both) > 40 and (both["lang"] == both["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all() and len(got) == len(odd_rows()) + len(known)
    odd_pred = {r[0]: r[1] for r in odd_rows()}
    for r in got[got["doc_id"].isin(list(odd_pred))].itertuples():
        if r.doc_id in odd_pred and not any(c.isalpha() for c in odd_pred[r.doc_id] or ""):
            assert r.doc_id in set(known["doc_id"]) or (r.lang_pred, r.score) == ("und", 0.0)


def test_language_of_rare_ones_and_long_runs(spark):
    """A language of 4 in 4000 rows is learned, and a text without white space is judged by all of it."""
    rng = random.Random(6)
    text = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(30))
    common, rare = "ba be bi bo bu da de di".split(), "kx qz xk zq wx kw".split()
    rows = [(k, text(common), "common") for k in range(4000)]
    rare_ids = [k for k in range(5000, 5100) if zlib.crc32(str(k).encode()) % 3 != 1][:4]
    rows += [(k, text(rare), "rare") for k in rare_ids]
    run = text(common)[:30].replace(" ", "") + text(rare).replace(" ", "")
    rows += [(9001, text(rare), None), (9002, text(common), None), (9003, run, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in crf.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id > 9000").collect()}
    assert got == {9001: "rare", 9002: "common", 9003: "rare"}


def test_crf_marginals_sum_over_all_labellings():
    import itertools

    rng = np.random.default_rng(0)
    model = crf.Crf(["a", "b", "c"])
    model.moves, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([3, 1, 4])
    scores = rng.normal(size=(8, 3))
    got = model.marginals(scores, lengths)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = math.exp(model.start[y[0]] + sum(scores[at + k, y[k]] for k in range(n)) + sum(model.moves[y[k], y[k + 1]] for k in range(n - 1)))
            for k in range(n):
                want[k, y[k]] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_empty_tables(none):
    for out in (suffixtree.score(none), packing.pack(none, queries.bpe_path()), shinglejoin.similar_groups(none), suffixdedup.removed(none), crf.identify(none)):
        assert out.count() == 0
