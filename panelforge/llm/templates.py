"""Main text of web pages by equivalence classes of tokens over pages of one host.

Pages of a host come in groups of about ``GROUP_PAGES`` (a host with more is dealt over several, by hash). A host that
holds more than a share of all pages is salted before pages are shuffled, so no task gets it whole. A page is a row of
tokens: structural tags under their path of open elements, and words under the path of their block. Tokens whose
occurrence vectors over the group's pages are equal form a class. A class is valid if its tokens come in one
order in every page; the class that occurs once a page is the template's root, and the space between two of its
tokens is a slot. A class that repeats is valid if each page has all its occurrences in one slot, and is nested
there: rows of a list. Words are tokens outside running text; inside, where common words agree by chance, whole
blocks are. Blocks of the template's words, or that half the pages with their path share, are the template's and
are dropped. Running text has its own rule, as sentences and headings repeat there without being the template's: a
block on a path whose blocks vary is dropped only if every page with that path has it, and a heading that leads to
such text under the same parent stays.

What is left varies over pages. The main container of a layout is the deepest element that holds over half of the
varying running text of its pages (pages with no text in it are a layout of their own, and so on). Slots are judged once
for the group by a sum of features: in the main container or not, running text, headings, links; article elements and
names add less, and decide where these leave a tie, but for the names of comments, forms and the like.

Pages of equal blocks count once as evidence. In groups under ``LEAST_PAGES`` such pages, and for paths on fewer,
nothing can be seen to vary: there elements and names decide, and without an article element running text that
is no list of links.

Cases: a null or empty html has an empty text; a null url, or one without a host, stands for a host of its own; rows that
repeat are extracted each; a quote that no other closes ends with its tag; an unclosed tag, comment or script runs to the
end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages of one host in a group, about.
GROUP_PAGES = 48
LEAST_PAGES = 6
#: Hosts with more than this part of all pages, under ``1 / HOT_SHARE`` of them, are salted; never under two groups.
HOT_SHARE = 1e-5

# HTML's own classes of elements, and words that name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|textarea|select|iframe|object|head|title"
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NO_ARTICLE_TAGS = frozenset("nav footer aside form button dialog menu".split())
NO_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer "
    "discussion disqus foot footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe teaser toolbar widget widgets".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Of these, what varies over pages without being the article; the others are weaker features of a slot.
STRONG_WORDS = NO_ARTICLE_WORDS - frozenset("alert banner copyright disclaimer foot form header legal login masthead notice notices notification promo promotion share sharing social".split())
STRONG_TAGS = NO_ARTICLE_TAGS - {"form"}
#: Mean words of a block from which a slot is running text.
RUNNING_WORDS = 10
_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?$")
_DIGITS = re.compile(r"\d+")
_MARKS = str.maketrans("/\0\1", "|||")  # what paths and tokens are told apart by, as part of a name
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")


class Block:
    """Text between structural tags: its path, what the path says (``other``: 0, 1 or, by a strong name, 2), its words and how many are in links."""

    __slots__ = ("path", "article", "other", "words", "linked", "at")

    def __init__(self, path: str, article: bool, other: int, words: list[str], linked: int, at: int):
        self.path, self.article, self.other, self.words, self.linked, self.at = path, article, other, words, linked, at

    @property
    def token(self) -> str:
        return f"{self.path}\1{' '.join(self.words)}"


def parsed(html: str | None) -> tuple[list[str], list[Block]]:
    """Structural tokens of a page in order, and its blocks; a block's ``at`` is the number of tokens before it."""
    tokens: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = [("", "", False, 0)]  # tag, path, in an article, in something else
    held: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            words = unescape("".join(held)).split()
            held.clear()
            if words:
                _, path, article, other = stack[-1]
                blocks.append(Block(path, article, other, words, linked, len(tokens)))
        linked = 0

    def close(tag: str) -> None:
        k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
        if k:
            del stack[k:]
            tokens.append(f"{stack[-1][1]}/{tag}>")

    for m in _TOKEN.finditer(html or ""):
        text = m["text"]
        if text is not None:
            held.append(text)
            if links:
                linked += len(text.split())
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m["end"] else 1
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if m["end"]:
            close(tag)
            continue
        top = stack[-1][0]
        if (top == "p" and tag in CLOSES_P) or (top == tag and tag in ("li", "option", "tr", "td", "th", "dd", "dt")):
            close(top)
        names = " ".join(filter(None, (x for g in _NAMES.findall(m["rest"]) for x in g))).lower() if m["rest"] else ""
        parts = set(_PARTS.findall(names))
        _, path, article, other = stack[-1]
        path = f"{path}/{tag}" + (f".{_DIGITS.sub('0', names.translate(_MARKS))}" if names else "")
        starts = tag in ("article", "main") or "articlebody" in names.replace("-", "").replace("_", "") or "main" in parts and "role" in m["rest"]
        if tag in STRONG_TAGS or parts & STRONG_WORDS:
            other = 2
        elif tag in NO_ARTICLE_TAGS or (tag == "header" and not article) or parts & NO_ARTICLE_WORDS:
            other = max(other, 1)
        tokens.append(path + "<")
        if tag not in VOID:
            stack.append((tag, path, article or starts, other))
    flush()
    return tokens, blocks


def classes(pages: list[list[str]]) -> dict[bytes, list[str]]:
    """Tokens by their occurrence vector over the pages, in order of first occurrence; those of half the pages at least."""
    vectors: dict[str, Counter] = defaultdict(Counter)
    for i, tokens in enumerate(pages):
        for t in tokens:
            vectors[t][i] += 1
    by: dict[bytes, list[str]] = defaultdict(list)
    for t, c in vectors.items():
        if 2 * len(c) >= len(pages):
            v = np.zeros(len(pages), np.int32)
            v[list(c)] = list(c.values())
            by[v.tobytes()].append(t)
    return by


def root_class(pages: list[list[str]], by: dict[bytes, list[str]]) -> list[str]:
    """Tokens that occur once in every page and in one order; what breaks the order is no part of the template."""
    once = by.get(np.ones(len(pages), np.int32).tobytes(), [])
    if not once:
        return []
    place = {t: k for k, t in enumerate(once)}
    order = np.array([[0] * len(once)] * len(pages))
    for i, tokens in enumerate(pages):
        for at, t in enumerate(tokens):
            if t in place:
                order[i, place[t]] = at
    kept, last = [], np.full(len(pages), -1)
    for k in np.argsort(order[0], kind="stable"):
        if (order[:, k] > last).all():
            kept.append(once[k])
            last = order[:, k]
    return kept


class Template:
    """The root's tokens and, for each slot after one, the repeated classes nested there."""

    def __init__(self, pages: list[tuple[list[str], list[Block]]]):
        self.with_words = len(pages) >= LEAST_PAGES
        self.having = Counter(path for _, blocks in pages for path in {b.path for b in blocks})
        self.shared = Counter(t for _, blocks in pages for t in {b.token for b in blocks})
        self.known = {path for path, n in self.having.items() if self.with_words and n >= LEAST_PAGES}
        self.fixed = {t for t, n in self.shared.items() if (path := t.partition("\1")[0]) in self.known and 2 * n >= self.having[path]}
        self.running = self.running_paths(pages)
        self.mains = self.main_containers(pages)
        rows = [self.tokens(p) for p in pages]
        by = classes(rows)
        self.root = root_class(rows, by)
        self.rank = {t: k + 1 for k, t in enumerate(self.root)}
        self.nested: dict[int, list[list[str]]] = defaultdict(list)
        slot_of: dict[str, set[int]] = defaultdict(set)
        for row in rows:
            slot = 0
            for t in row:
                slot = self.rank.get(t, slot)
                slot_of[t].add(slot)
        for v, tokens in by.items():
            if len(tokens) > 1 and tokens[0] not in self.rank:
                slots = set().union(*(slot_of[t] for t in tokens))
                if len(slots) == 1:
                    self.nested[slots.pop()].append(tokens)
        self.template_words = {t for t in self.rank if "\0" in t} | {t for c in self.nested.values() for g in c for t in g if "\0" in t}
    def running_paths(self, pages: list[tuple[list[str], list[Block]]]) -> set[str]:
        """Paths of which some blocks vary over the pages, and all are running text on the whole, not links nor, by a strong name, something else."""
        words: Counter = Counter()
        linked: Counter = Counter()
        blocks: Counter = Counter()
        varies = set()
        for b in (b for _, page in pages for b in page):
            if b.path in self.known and b.other < 2:
                words[b.path] += len(b.words)
                linked[b.path] += b.linked
                blocks[b.path] += 1
                if b.token not in self.fixed:
                    varies.add(b.path)
        return {path for path in varies if words[path] >= RUNNING_WORDS * blocks[path] and 2 * linked[path] <= words[path] and not _HEADING.search(path)}

    def main_containers(self, pages: list[tuple[list[str], list[Block]]]) -> list[str]:
        """Main containers of the layouts, those of more text first."""
        left = []
        for _, page in pages:
            words: Counter = Counter()
            for b in page:
                if b.path in self.running and b.token not in self.fixed:
                    words[b.path] += len(b.words)
            left.append(words)
        mains: list[str] = []
        while left := [words for words in left if words]:
            total = sum(left, Counter())
            under: Counter = Counter()
            for path, n in total.items():
                for k, c in enumerate(path):
                    if c == "/":
                        under[path[:k]] += n
            half = sum(total.values()) / 2
            mains.append(max((c for c, n in under.items() if n > half), key=len))
            left = [words for words in left if not any(path.startswith(mains[-1] + "/") for path in words)]
        return mains

    def main_of(self, page: list[Block]) -> str | None:
        """The main container of a page's layout."""
        paths = {b.path for b in page if b.path in self.running}
        return next((m for m in self.mains if any(p.startswith(m + "/") for p in paths)), None)

    def block_tokens(self, b: Block) -> list[str]:
        return [b.token] if b.article or b.path in self.running else [f"{b.path}\0{w}" for w in b.words]

    def tokens(self, page: tuple[list[str], list[Block]]) -> list[str]:
        """A page's tags, its words outside running text and its blocks inside, in order."""
        tags, blocks = page
        if not self.with_words:
            return tags
        out, at = [], 0
        for b in blocks:
            out += tags[at : b.at]
            at = b.at
            out += self.block_tokens(b)
        return out + tags[at:]

    def slots(self, page: tuple[list[str], list[Block]]) -> list[int]:
        """The slot of each block: the one it begins in."""
        tags, blocks = page
        out, at, slot = [], 0, 0
        for b in blocks:
            for t in tags[at : b.at]:
                slot = self.rank.get(t, slot)
            at = b.at
            out.append(slot)
            if self.with_words:
                for t in self.block_tokens(b):
                    slot = self.rank.get(t, slot)
        return out

    def key(self, slot: int, b: Block) -> tuple[int, str, bool]:
        """What is judged as one: a slot's blocks of one path, links apart where the path is no running text."""
        return slot, b.path, b.path not in self.running and 2 * b.linked > len(b.words)

    def owns(self, page: list[Block]) -> list[bool]:
        """Of each block of a page, whether it is the template's."""
        out, leads = [False] * len(page), ""  # leads: the parent of the running text that comes next
        for i in range(len(page) - 1, -1, -1):
            b = page[i]
            if b.path in self.running:
                out[i] = b.token in self.fixed and self.shared[b.token] == self.having[b.path]
            elif not (_HEADING.search(b.path) and b.other < 2 and leads and parent(b.path) == leads):
                out[i] = b.token in self.fixed or bool(self.template_words) and all(f"{b.path}\0{w}" in self.template_words for w in b.words)
                leads = ""
                continue
            if not out[i]:
                leads = parent(b.path)
        return out


def parent(path: str) -> str:
    return path[: path.rfind("/")]


def is_text(b: Block, inside: bool, marked: bool, words: int, linked: int, blocks: int) -> bool:
    """Whether a slot that varies over pages is the article's: a sum of features. ``inside``: it lies in the main
    container; ``marked``: its page has an article element."""
    links = 2 * linked > words
    score = 2 if inside else -1
    score += 1 if b.article else -1 if marked else 0
    score -= (0, 2, 4)[b.other]
    score += words >= RUNNING_WORDS * blocks
    score += (inside or b.article) and _HEADING.search(b.path) is not None
    score -= links * (1 if b.article else 2)
    return score > 0


def extracted(pages: list[tuple[list[str], list[Block]]]) -> list[str]:
    """The main text of each page of a group."""
    unlike = {tuple(b.token for b in blocks): (tags, blocks) for tags, blocks in pages}
    template = Template(list(unlike.values()))
    words: Counter = Counter()
    links: Counter = Counter()
    blocks_in: Counter = Counter()
    for page in unlike.values():
        for b, s, owned in zip(page[1], template.slots(page), template.owns(page[1])):
            if not owned:
                key = template.key(s, b)
                words[key] += len(b.words)
                links[key] += b.linked
                blocks_in[key] += 1
    out = []
    for page in pages:
        blocks = page[1]
        marked = any(b.article and not b.other for b in blocks)
        main = template.main_of(blocks)
        keep = []
        for b, s, owned in zip(blocks, template.slots(page), template.owns(blocks)):
            if owned:
                continue
            key = template.key(s, b)
            if b.path in template.known:
                inside = b.article or not marked if main is None else b.path.startswith(main + "/")
                if not is_text(b, inside, marked, words[key], links[key], blocks_in[key]):
                    continue
            elif b.other or (not b.article if marked else 2 * links[key] > words[key]):
                continue
            keep.append(" ".join(b.words))
        out.append(" ".join(keep))
    return out


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    texts = extracted([parsed(h) for h in pdf["html"]])
    out = pdf[["page_id", "url"]].copy()
    out["text"] = texts
    out["n_chars"] = [len(t) for t in texts]
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    named = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    alone = F.concat(F.lit("?"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("?"), F.coalesce("url", F.lit("")))
    rows = rows.withColumn("_h", F.when(named != "", named).otherwise(alone))
    most = max(2 * GROUP_PAGES, int(rows.count() * HOT_SHARE))
    hot = rows.groupBy(F.col("_h").alias("_host")).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where("_salts > 1")
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("_salts")))
    dealt = rows.join(F.broadcast(hot), F.col("_h") == F.col("_host"), "left").withColumn("_salt", salt)  # under 1 / HOT_SHARE hosts
    held = F.count("*").over(Window.partitionBy("_h", "_salt"))
    part = F.pmod(F.hash("page_id", "url"), F.ceil(held / GROUP_PAGES))
    dealt = dealt.repartition("_h", "_salt").select("page_id", "url", "html", "_h", "_salt", part.alias("_part"))
    return dealt.groupBy("_h", "_salt", "_part").applyInPandas(_group, "page_id long, url string, text string, n_chars long")
