"""Cached whole-text encoding with a public ``tokenizers`` vocabulary.

What the vocabulary file says of its normaliser and pre-tokeniser decides how a text is cut.  For the two
forms known here a text of Latin-1 characters is cut into the library's own pre-tokens by a compiled pattern, and each
distinct pre-token is encoded once in a task by the library's model.  Other texts are cut where no
pre-token of these forms can span, before every run of white space that follows a visible
character, and their pieces go through the whole library.  Vocabularies of any other form encode whole texts by the library.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import numpy as np

#: Unicode White_Space, which is ``\s`` of the library's patterns.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: The Latin-1 characters of ``\s``, ``\p{L}`` and ``\p{N}``.
_S, _L, _N = "\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
_WIDE = re.compile("[^\x00-\xff]")

#: The vocabularies' own patterns, and what they are over Latin-1.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHORT = "'(?:[stmd]|re|ve|ll)"
_WORD_FORM = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_FORM = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: Most entries of a task's cache of rare pieces, of which the older half goes when it is full, and most characters of a piece in it.
CACHE, CACHED_CHARS = 240_000, 48


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(spare)
        spare += b not in shown
    return out


class _Cache(dict):
    """Values of pieces: the table of frequent ones, and rare ones in two generations of which the older goes when the younger is full."""

    def __init__(self, value, known: dict):
        super().__init__(known)
        self.value, self.known, self.old = value, known, {}

    def __missing__(self, piece: str):
        v = self.old.get(piece)
        if v is None:
            v = self.value(piece)
        if len(piece) > CACHED_CHARS:
            return v
        if len(self) >= len(self.known) + CACHE // 2:
            self.old = dict(self)
            self.clear()
            self.update(self.known)
        self[piece] = v
        return v


_LOADED: dict[tuple, Pieces] = {}


def worker_pieces(path: str, known: dict | None = None, ids: bool = False) -> Pieces:
    """This worker's coder with an empty cache; what stays from one task to the next is the vocabulary."""
    key = (path, ids)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(path, ids=ids)
    return _LOADED[key].reset(known)


def _form(tok) -> str:
    """``word``, ``byte`` or ``other``, by what the vocabulary file holds."""
    d = json.loads(tok.to_str())
    norm, pre = d.get("normalizer"), d.get("pre_tokenizer") or {}
    if d.get("truncation") or d.get("padding") or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in d.get("added_tokens", [])):
        return "other"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    steps, parts = (norm or {}).get("normalizers", []), pre.get("pretokenizers", [])
    if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " \
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORD_PATTERN} and parts[0]["behavior"] == "Removed" \
            and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]:
        return "word"
    return "other"


class Pieces:
    """Encodes texts; ``known`` is a table of frequent pieces' values, which are bytes of ids with ``ids``, else numbers of ids."""

    def __init__(self, path: str, known: dict | None = None, ids: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.ids, self.form = self.tok.model, ids, _form(self.tok)
        self.special = {str(t): i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.reset(known)

    def reset(self, known: dict | None = None) -> Pieces:
        """Empty caches: one of pre-tokens, one of pieces that go through the whole library."""
        self.cache, self.wide = _Cache(self.token, known or {}), _Cache(self.slow, {})
        return self

    def pack(self, ids: list[int]):
        return array(self.code, ids).tobytes() if self.ids else len(ids)

    def slow(self, piece: str):
        return self.pack(self.tok.encode(piece, add_special_tokens=False).ids)

    def token(self, pre: str):
        """The value of one pre-token."""
        if not (pre.isascii() and pre.isalpha()):
            pre = "".join([self.letters[b] for b in pre.encode()])
        return self.pack([t.id for t in self.model.tokenize(pre)])

    def value(self, pre: str):
        return self.cache[pre]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a Latin-1 text of a known form without special strings."""
        return _BYTE_FORM.findall(text) if self.form == "byte" else _WORD_FORM.findall(text.lower())

    def each(self, text: str) -> Iterable:
        """The values of the text's parts, special strings among them."""
        if self.form == "other":
            return [self.slow(text)]
        if self.cut is not None and self.cut.search(text) is not None:
            return [v for i, p in enumerate(self.cut.split(text)) for v in ([self.pack([self.special[p]])] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> Iterable:
        if _WIDE.search(text) is None:
            return map(self.cache.__getitem__, self.pieces(text))
        return map(self.wide.__getitem__, _PIECES.findall(text))

    def count(self, text: str) -> int:
        return sum(self.each(text))

    def encode(self, text: str) -> bytes:
        return b"".join(self.each(text))
