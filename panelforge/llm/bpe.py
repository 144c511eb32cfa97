"""Byte-level BPE through the tokenizers library, with a bounded memo of space-led chunks.

A byte-level BPE pre-tokenizer never lets a piece run across the place before a single space that
follows a non-space character, so a text may be cut there and each chunk encoded on its own. Chunks
recur, so each distinct one is given to the library once per worker and memo. Texts with a run of
white space in which such a cut could fall inside a piece are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

# Fixed value: the public pattern that cuts texts into pieces for this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSAFE = re.compile(r"\s (?:\s|$)")
_END = b"\x00\x00\x00\x00"
_LOADED: dict[tuple[str, int], "ChunkedBpe"] = {}


def _pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    return a.tobytes()


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkedBpe:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids as bytes, one entry a text."""

    def __init__(self, path: str, memo: int):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.bare = Tokenizer(self.tok.model)  # takes pieces that are cut and mapped already
        self.cut = regex.compile(PIECES).findall
        self.map = _alphabet()
        self.between = self.map | {0: "\0"}
        self.space_led = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        self.space_led[[i for w, i in self.tok.get_vocab().items() if w[0] == "\u0120"]] = True
        self.memo = memo
        self.rest: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return _pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text in the alphabet of bytes; all are mapped at once, with zero bytes between them."""
        if "\0" in text:
            return [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for p in self.cut(text)]
        return "\0".join(self.cut(text)).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.between).split("\0")

    def _learn(self, words: list[str]) -> None:
        """Memorise the ids of words that follow a space."""
        plain = [w for w in words if w and not w[0].isspace()]
        for at in range(0, len(plain), 50_000):
            part = plain[at : at + 50_000]
            pieces = self._pieces(" " + " ".join(part))
            found = self.bare.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            starts = np.flatnonzero(self.space_led[ids])
            if len(starts) != len(part):  # a word with a space of its own
                self.rest.update((w, self._whole(" " + w)) for w in part)
                continue
            raw, at_byte = ids.tobytes(), (4 * starts).tolist()
            self.rest.update(zip(part, map(raw.__getitem__, map(slice, at_byte, [*at_byte[1:], len(raw)]))))
        self.rest.update((w, self._whole(" " + w)) for w in words if not w or w[0].isspace())

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts, known = list(texts), self.rest
        cut = [None if _UNSAFE.search(t) else t.split(" ") for t in texts]
        heads = [c.pop(0) if c else "" for c in cut]
        asked = set().union(*filter(None, cut))
        missing = asked.difference(known)
        if len(known) + len(missing) > self.memo:  # common words come back at once
            known.clear()
            missing = asked
        self._learn(list(missing))
        joined = (t if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut))
        return [self._whole(j) if isinstance(j, str) else (self._whole(h) if h else b"") + j for h, j in zip(heads, joined)]


def encoder(path: str, memo: int = 1_200_000) -> ChunkedBpe:
    """One encoder a Python worker."""
    if (path, memo) not in _LOADED:
        _LOADED[path, memo] = ChunkedBpe(path, memo)
    return _LOADED[path, memo]


def encode_stream(texts: Iterable[str | None], path: str, chars: int = 4_000_000) -> Iterator[bytes]:
    """Ids of each text (null: empty) with the end id 0 added; texts go to the encoder about ``chars`` at a time."""
    enc, held, size = encoder(path), [], 0
    for t in texts:
        held.append(t if isinstance(t, str) else "")
        size += len(held[-1])
        if size >= chars:
            yield from (b + _END for b in enc.encode(held))
            held, size = [], 0
    if held:
        yield from (b + _END for b in enc.encode(held))
