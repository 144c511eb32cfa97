"""SentencePiece BPE by a table of prefixes, and back.

Merging pairs of pieces best score first gives every prefix of a text an encoding of its own, and the last piece of
that encoding is unique: it is the one piece that ends there and that may follow the last piece of the prefix before
it. So one pass stores, for each prefix, only its last piece. Pieces that end at a place come from an Aho-Corasick
automaton over the vocabulary. Whether one may follow another is a test of the two alone: merging their joined text
gives just these two. The ids are read from the table backwards. Time and memory are linear in the text.

Where no piece runs from other characters into a space mark, a text is cut before each run of marks, and between
characters of kinds that no piece joins: nothing merges over such a cut, so each chunk is encoded by itself, and chunks
that recur come from a bounded memo. A vocabulary with pieces over cuts takes whole texts. A character without a piece becomes its bytes, or the unknown piece in a model
without byte pieces, where a run of them is one.

Cases: a null or empty text has no ids and decodes to an empty text; null ids and rows that repeat are encoded each;
an empty table gives no rows; other columns are ignored. Models of another type, or with pieces of the user or unused ones, are refused.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelforge.llm.common import keyed_text

MARK = "▁"
_MEMO, _PAIRS, _TOGETHER = 1_200_000, 1_000_000, 2_000_000
_LOADED: dict[str, "PieceTable"] = {}


class PieceTable:
    """``encode(text)`` gives the ids that the sentencepiece library gives; ``decode`` is the library's."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        if any(sp.is_unused(i) for i in ids) or _model_type(path) != 2:
            raise ValueError("only BPE models whose pieces are all in use are supported")
        self.ids = {sp.id_to_piece(i): i for i in ids if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in special if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.text = dict(zip(self.ids.values(), self.ids))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1 and self.merged(p) == [p]:  # others never result from merges
                self.automaton.add_word(p, i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.cut = _cutter([p for p in self.ids if len(p) > 1])
        self.pairs, self.allowed = np.zeros(0, np.int64), np.zeros(0, bool)  # tests made, in order
        self.size = np.ones(max(ids) + 1, np.int64)
        self.size[list(self.text)] = [len(p) for p in self.ids]
        self.single = ~np.arange(0x110000, dtype=np.int64)
        self.single[[ord(p) for p in self.ids if len(p) == 1]] = [i for p, i in self.ids.items() if len(p) == 1]
        taken = set("".join(p for p in self.ids if len(p) > 1))
        self.apart = next(c for c in map(chr, range(0x110000)) if c not in taken)
        self.memo: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging its best pairs, the leftmost among equals."""
        part: list[str | None] = list(text)
        after = [*range(1, len(part)), -1]
        before = [*range(-1, len(part) - 1)]
        queue = [(-self.scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.scores]
        heapify(queue)
        while queue:
            _, i, whole = heappop(queue)
            j = after[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != whole:
                continue
            part[i], part[j], after[i] = whole, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and part[a] + part[b] in self.scores:
                    heappush(queue, (-self.scores[part[a] + part[b]], a, part[a] + part[b]))
        return [p for p in part if p is not None]

    def _string(self, number: int) -> str:
        return self.text[number] if number >= 0 else chr(~number)

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of two pieces gives the two, for many pairs."""
        keys, back = np.unique((left + 0x110000) << 20 | right, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        new = keys[np.append(self.pairs, -1)[at] != keys]
        if len(new):
            if len(self.pairs) > _PAIRS:
                self.pairs, self.allowed, new = self.pairs[:0], self.allowed[:0], keys
            pairs = [[self._string(k >> 20, 0x110000), self._string(k & 0xFFFFF, 0)] for k in new.tolist()]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.allowed = np.insert(self.pairs, at, new), np.insert(self.allowed, at, [self.merged(a + b) == [a, b] for a, b in pairs])
        return self.allowed[np.searchsorted(self.pairs, keys)][back]

    def _string(self, number: int, less: int) -> str:
        number -= less
        return self.text[number] if number >= 0 else chr(~number)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' pieces one after another, and where each text's end; a character without one is the complement of its code.

        The texts are laid side by side, and their tables filled together: the k-th characters of all at once.
        """
        width = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(width + 1) - 1  # where the character between texts stands
        starts = ends - width
        whole = "".join([t + self.apart for t in texts])
        last = self.single[np.frombuffer(whole.encode("utf-32-le"), "<u4")]  # where no longer piece may end, the character itself
        length = np.ones(len(whole), np.int64)
        depth = np.arange(len(whole)) - np.repeat(starts, width + 1)
        found = self.automaton.iter(whole) if len(self.automaton) else ()
        at, piece = np.fromiter(itertools.chain.from_iterable(found), np.int64).reshape(-1, 2).T
        order = np.argsort(depth[at], kind="stable")
        at, piece = at[order], piece[order]
        before = at - self.size[piece]
        first = self.size[piece] == depth[at] + 1
        bounds = np.searchsorted(depth[at], np.arange(depth[at[-1]] + 2)) if len(at) else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            a, p = at[low:high], piece[low:high]
            ok = first[low:high].copy()  # a piece that is the whole prefix
            ok[~ok] = self.may_follow(last[before[low:high][~ok]], p[~ok])
            last[a[ok]], length[a[ok]] = p[ok], self.size[p[ok]]
        ending, here = np.zeros(len(whole), bool), (ends - 1)[width > 0]
        floor = starts[width > 0]
        while len(here):  # back from each end, piece by piece
            ending[here] = True
            here = here - length[here]
            here, floor = here[here >= floor], floor[here >= floor]
        return last[ending], np.searchsorted(np.flatnonzero(ending), ends)

    def _ids(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids, as little-endian 32-bit bytes."""
        pieces, ends = self.pieces(texts)
        lacking = np.flatnonzero(pieces < 0)
        if len(lacking):
            spelt = [[self.bytes[b] for b in chr(~p).encode()] if self.bytes else [self.unknown] for p in pieces[lacking].tolist()]
            width = np.ones(len(pieces), np.int64)
            width[lacking] = [len(x) for x in spelt]
            ends = np.append(0, np.cumsum(width))[ends]
            pieces = np.repeat(pieces, width)
            pieces[pieces < 0] = [i for x in spelt for i in x]
        raw, last = pieces.astype("<i4").tobytes(), (4 * ends).tolist()
        return (raw[a:b] for a, b in zip([0, *last], last))

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks, those of like length together."""
        chunks = sorted(chunks, key=len)
        at = 0
        while at < len(chunks):
            upto, size = at, 0
            while upto < len(chunks) and size < _TOGETHER and len(chunks[upto]) <= max(32, 2 * len(chunks[at])):
                size += len(chunks[upto])
                upto += 1
            part = chunks[at:upto]
            self.memo.update(zip(part, self._ids(part)))
            at = upto

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [self.cut(self.lib.normalize(t)) if t else [] for t in texts]
        memo, new = self.memo, {c for chunks in cut for c in chunks}
        new.difference_update(memo)
        if len(memo) + len(new) > _MEMO:
            memo.clear()
            new = {c for chunks in cut for c in chunks}
        self._learn(list(new))
        out = [np.frombuffer(b"".join(map(memo.__getitem__, chunks)), "<i4").tolist() for chunks in cut]
        if not self.bytes:  # a run of unknown characters is one piece
            out = [[x for i, x in enumerate(ids) if x != self.unknown or i == 0 or ids[i - 1] != x] for ids in out]
        return out

    def stream(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of one text after another; about ``_TOGETHER`` characters are encoded at a time."""
        held, size = [], 0
        for t in texts:
            held.append(t if isinstance(t, str) else "")
            size += len(held[-1])
            if size >= _TOGETHER:
                yield from self.encode(held)
                held, size = [], 0
        yield from self.encode(held)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids) if ids else ""


def _cutter(longer: list[str]):
    """Cuts a text where nothing merges over the cut: before space marks, and between characters that no piece joins.

    Characters side by side in a piece are of one kind, and so is what they are joined with in turn.
    """
    if any(MARK in p.lstrip(MARK) for p in longer):
        return lambda t: [t] if t else []
    kind: dict[str, str] = {}

    def root(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = c = kind[kind[c]]
        return c

    for p in (p.lstrip(MARK) for p in longer):
        for c in p:
            kind[root(c)] = root(p[0])
    kinds: dict[str, list[str]] = {}
    for c in sorted(kind):
        kinds.setdefault(root(c), []).append(c)
    # the largest kind is tried first; a character of no kind stands alone, after its marks
    runs = [f"[{re.escape(''.join(cs))}]+" for cs in sorted(kinds.values(), key=len, reverse=True)]
    return re.compile(f"{MARK}*(?:{'|'.join([*runs, f'[^{MARK}]'])})|{MARK}+", re.S).findall


def _model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if any(p.type == 4 for p in model.pieces):
        raise ValueError("pieces of the user are not supported")
    return model.trainer_spec.model_type


def piece_table(path: str) -> PieceTable:
    """One table a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_table(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": list(table.stream(pdf["text"]))})

    return keyed_text(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_table(model)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [table.decode([] if x is None else [int(i) for i in x]) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text, without sending ids between tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = piece_table(model)
        numbers = [str(i) for i in range(table.lib.get_piece_size())]
        for pdf in batches:
            rows = []
            for ids in table.stream(pdf["text"]):
                listed = hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest()
                rows.append((len(ids), listed, hashlib.sha256(table.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            yield out

    return keyed_text(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
