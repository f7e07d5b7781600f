"""Whole-text token ids from a ``tokenizers`` file, with a bounded memo of words.

Both public BPE files cut a text before every run of white space that follows
a non-space character, so the ids of a text are the ids of its space-delimited
pieces, in order.  A worker encodes a piece once and then reuses the packed
bytes; texts with other spacing than single blanks and line feeds are encoded whole,
and so are those whose line feeds the byte-level file keeps together (two or more in a row), and those that
hold an added token of the file, which the tokenizer gives its own id.
"""

from __future__ import annotations

import re
import sys
from array import array

from tokenizers import Tokenizer, models

from .common import kept, limit_threads

#: ASCII white space and separators other than blank and line feed
_RARE_ASCII = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
#: further characters that some library takes for white space
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


#: ASCII and composed Latin letters that the file's normalizer lower-cases as Python does
_COMPOSED = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]*")


#: ASCII marks that the byte-level file keeps together after a word; an apostrophe may begin a contraction
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _rare_space(text: str) -> bool:
    return any(c in text for c in _RARE_ASCII) if text.isascii() else bool(_RARE.search(text))


def _byte_symbols() -> dict[int, str]:
    """Latin-1 character of a byte -> printable symbol of byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


assert sys.byteorder == "little" and array("I").itemsize == 4


class _Memo(dict):
    """piece -> ids as little-endian uint32 bytes; two generations bound its size."""

    def __init__(self, encode, size: int):
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``memo`` bounds the number of remembered pieces (two generations of it).
    """

    def __init__(self, path: str, memo: int = 400_000):
        limit_threads()
        self.tok = Tokenizer.from_file(path)
        #: added tokens, as they are and as the file's normalizer leaves them
        self.added = {x for t in self.tok.get_added_tokens_decoder().values() for x in (t.content, t.content.lower()) if x}
        self.normalized = any(t.normalized for t in self.tok.get_added_tokens_decoder().values())
        self.model = self.tok.model
        self.symbols = _byte_symbols()
        #: a file that lower-cases and drops white space, or one that keeps a leading blank with the word
        self.spaceless = self.tok.normalizer is not None
        self.simple = isinstance(self.model, models.BPE)
        if self.simple:
            self.model._resize_cache(0)  # the memo has the frequent words; looking up the others twice takes longer than merging them
        self.memo = _Memo(self._spaceless_piece if self.spaceless else self._piece, memo)
        self.newline = b"" if self.spaceless else self._whole("\n")
        self.after = _Memo(self._whole, 1 << 12)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of letters only, through the model alone: no other pre-token can arise."""
        symbols = lead + (word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols))
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece stands after one blank, or begins with the line feed that is before it."""
        lead, body, head = "Ġ", piece, b""
        if piece[:1] == "\n":
            lead, body, head = "", piece[1:], self.newline
        if self.simple and (word := body.rstrip(_MARKS)).isalpha():
            return head + self._word(word, lead) + (self.after[body[len(word) :]] if len(word) < len(body) else b"")
        return self._whole(piece if head else " " + piece)

    def _first(self, piece: str) -> bytes:
        """A piece with which a text begins, without a blank before it."""
        return self._word(piece, "") if self.simple and piece.isalpha() else self._whole(piece)

    def _spaceless_piece(self, piece: str) -> bytes:
        if self.simple and (piece.isascii() or _COMPOSED.fullmatch(piece)):
            low = piece.lower()
            if low.isalpha():
                return self._word(low, "")
            if low and low[-1] in ".," and low[:-1].isalpha():
                return self._word(low[:-1], "") + self.after[low[-1]]
        return self._whole(piece)

    def _has_added(self, text: str) -> bool:
        if self.normalized:
            text = text.lower()
        return any(x in text for x in self.added)

    def encode(self, text: str) -> bytes:
        """Packed little-endian uint32 ids of the whole text."""
        if not text:
            return b""
        if _rare_space(text) or self._has_added(text):
            return self._whole(text)
        if self.spaceless:
            return b"".join(map(self.memo.__getitem__, text.split()))
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or "\n\n" in text:
            return self._whole(text)
        pieces = text.replace("\n", " \n").split(" ")
        return self._first(pieces[0]) + b"".join(map(self.memo.__getitem__, pieces[1:]))


def encoder(path: str, memo: int = 400_000) -> TextEncoder:
    """One encoder for each Python worker and file."""
    return kept((path, memo), lambda: TextEncoder(path, memo))
