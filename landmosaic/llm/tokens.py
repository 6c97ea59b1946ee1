"""Token ids of a word-level BPE tokenizer file, with bounded caches of its pieces."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: Letters and digits of lower-cased Latin-1, and with them the split pattern of the word_bpe_49k tokenizer file (fixed by that file).
_LETTERS, _DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_LATIN = re.compile(r"[\t-\r -~\x85\xa0-\xff]*\Z")
_CONTROL = re.compile(r"[\x1c-\x1f]")


def byte_signs() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: a printable Latin-1 character for itself, the others are numbered from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_characters() -> dict[int, str]:
    """For str.translate: each Latin-1 character beyond ASCII as the characters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    sign = byte_signs()
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}


class Recent(dict):
    """A cache of find(key) that keeps the last `most` to 2 * `most` keys: what is full becomes the elder half."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most, self.elder = find, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.elder.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """ids(texts) as Tokenizer.encode(text, add_special_tokens=False).ids gives them, little-endian 32-bit.

    The tokenizer drops white space and never merges across pieces, so a text's ids are its pieces' ids in a row. Pieces
    repeat, so they are cached. A text of Latin-1 characters is lower-cased and split here, and its pieces are merged by the
    tokenizer's model. Of other texts the chunks between white space are looked at in the same way; chunks with other
    characters, and those with the special tokens' strings, go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        merge, signs = self.whole.model.tokenize, byte_characters()

        def piece(text: str) -> bytes:
            return array("I", [t.id for t in merge(text if text.isascii() else text.translate(signs))]).tobytes()

        self.pieces, self.chunks = Recent(piece, most), Recent(self._chunk, most // 8)

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))

    def _chunk(self, chunk: str) -> bytes:
        return self._plain(chunk) if _LATIN.match(chunk) and "<|" not in chunk else self._whole(chunk)

    def _ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text and _LATIN.match(text):
            return self._plain(text)
        return self._whole(text) if _CONTROL.search(text) else b"".join(map(self.chunks.__getitem__, text.split()))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        return [self._ids(t) for t in texts]


#: The split pattern of byte-level files, for Latin-1 texts (fixed by those files).
_UPPER = "A-Z\xc0-\xd6\xd8-\xde"
_SPACE = "\t-\r \x85\xa0"
_BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_UPPER}{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACE}{_UPPER}{_LETTERS}{_DIGITS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class ByteBpe:
    """ids(text): what Tokenizer.encode(space + text) of a byte-level BPE file gives, special tokens' strings being plain text.

    Merges never cross pieces of the split pattern, and pieces repeat, so those of Latin-1 texts are cached; other texts go through the
    whole tokenizer.
    """

    def __init__(self, path: str, most: int = 150_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        merge, signs, self.longest = self.whole.model.tokenize, {c: s for c, s in byte_signs().items() if c < 128} | byte_characters(), longest
        self.find = lambda piece: array("I", [t.id for t in merge(piece.translate(signs))]).tobytes()
        self.pieces = Recent(self.find, most)

    def ids(self, text: str) -> np.ndarray:
        if not _LATIN.match(text):
            return np.array(self.whole.encode(f" {text}", add_special_tokens=False).ids, np.int64)
        found = (self.pieces[p] if len(p) <= self.longest else self.find(p) for p in _BYTE_PIECES.findall(f" {text}"))
        return np.frombuffer(b"".join(found), np.uint32).astype(np.int64)


@cache
def word_bpe(path: str) -> WordBpe:
    """One per worker process, so that its cache lives on between tasks."""
    return WordBpe(path)
