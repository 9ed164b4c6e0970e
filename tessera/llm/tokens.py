"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

A byte-level BPE encodes each piece of its pre-tokenizer's split on its own, so
ids of a piece are looked up once and joined as little-endian 32-bit values.
The split is done here only for texts whose characters all lie below U+0250,
where the character classes of both regular expression engines agree, and that
hold no added token's string; any other text, and any tokenizer of another kind,
goes to the library whole. So ids are always those of the library's
``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: The byte-level pre-tokenizer's fixed pattern, its classes written out for U+0000 to U+024F.
LETTER, NUMBER, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
PIECES = f" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: ASCII characters that the split isn't done for.
ODD = "\0\x1c\x1d\x1e\x1f"
#: Words and pieces kept by each of the two generations of their cache (about 200 bytes each).
CACHED = 300_000


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Two generations of a bounded dictionary: what is still in use moves to the younger one."""

    def __init__(self, make, size: int) -> None:
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = ids
        return ids


class Encoder:
    """Ids of texts. Words between single blanks are cached whole, their pieces below that.

    A blank before anything but white space always starts a new piece, so a text
    whose blanks are all of that kind can be split at them first. Words and
    pieces share a cache: a key stands for itself behind a blank, or, after a
    NUL, for itself alone. A word of one piece is so kept once.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, kind = _loaded(path)
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not kind.get("normalizer") and kind["model"].get("type") == "BPE" and not kind["model"].get("dropout")
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        self.find, self.beyond = re.compile(PIECES).findall, re.compile("[^\x01-\x1b\x20-ɏ]").search
        self.letters, self.tokenize, self.bytes = dict(enumerate(byte_letters())), self.tokenizer.model.tokenize, kind["bytes"]
        self.known = _Cache(self._ids, CACHED)
        self.gaps = [(c, " " + c) for c in "\t\n\x0b\x0c\r\x85\xa0"]

    def strange(self, text: str) -> bool:
        """Whether ``text`` goes to the library whole; ASCII is searched for single characters only, which is much faster than a pattern."""
        if any([c in text for c in ODD]) if text.isascii() else self.beyond(text):
            return True
        return any([t in text for t in self.added])

    def _ids(self, key: str) -> bytes:
        if key.isalpha() and key.isascii():  # one piece, whose bytes but the blank stand for themselves
            letters = self.letters[32] + key
        else:
            pieces = [key[1:]] if key[0] == "\0" else self.find(" " + key)
            if len(pieces) > 1:
                return self._joined(pieces)
            letters = pieces[0].encode().decode("latin-1").translate(self.letters)
        table = self.bytes
        return b"".join([table[t.id] for t in self.tokenize(letters)])

    def _joined(self, pieces: list[str]) -> bytes:
        known = self.known
        return b"".join([known[p[1:]] if p[0] == " " and len(p) > 1 else known["\0" + p] for p in pieces])

    def __call__(self, text: str | None) -> bytes:
        """The ids of ``text`` (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_piece or self.strange(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text[-1] == " " or "  " in text or any([c in text and g in text for c, g in self.gaps]):
            return self._joined(self.find(text))
        first, *words = text.split(" ")
        return self._joined(self.find(first)) + b"".join(map(self.known.__getitem__, words))


@cache
def _loaded(path: str) -> tuple[Tokenizer, dict]:
    """The tokenizer, once a worker process and path, and what its file says of its kind."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    model = kind["model"]
    tokenizer = Tokenizer.from_file(path)
    ids = [*(model["vocab"].values() if isinstance(model.get("vocab"), dict) else ()), *(t["id"] for t in kind.get("added_tokens") or [])]
    kind |= {"model": {k: model.get(k) for k in ("type", "dropout")}, "bytes": [i.to_bytes(4, "little") for i in range(max(ids, default=-1) + 1)]}
    return tokenizer, kind


def encoder(path: str) -> Encoder:
    """A task's encoder: its cache goes with it, only the tokenizer stays."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
