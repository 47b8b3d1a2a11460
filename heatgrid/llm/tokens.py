"""Token ids by the tokenizers library, with a memory of what it returned for each word.

Encoding is cut only where the tokenizer itself always cuts: before white space that follows a visible character
(byte-level vocabularies, whose tokens keep the blank), or at all white space (vocabularies that drop it). A text with
characters outside the plain Latin range, or with one of the tokenizer's special strings, goes to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from codecs import charmap_decode

import numpy as np
from tokenizers import Tokenizer

_ODD = re.compile("[^\n -~¡-ȳ]")
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_CUT = re.compile(r"(?<=\S)(?=\s)")
_MARKED = re.compile(r"(\w+?)([!-&(-/:-@\[-`{-~]+)")  # no apostrophe, as 's and the like are tokens of their own
MARKS = 4096  # runs of marks that are remembered


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Memory(dict):
    """Of at most two generations: words met again move to the young one, the rest go with the old one. `encode` stores what
    it finds out."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is None:
            return self.encode(piece)
        self[piece] = found
        return found


class Encoder:
    """`ids(text)` is the library's answer (add_special_tokens=False) as little-endian bytes of `self.kind`."""

    def __init__(self, path: str, most_words: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = before.get("pretokenizers") or []
        glued = normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        apart = (
            [s.get("type") for s in steps] == ["Split", "ByteLevel"] and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
            and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "[^\\s\\p{L}\\p{N}]+" in json.dumps(steps[0]).replace("\\\\", "\\")
            and [s.get("type") for s in (normal or {}).get("normalizers") or []] == ["NFC", "Replace", "Lowercase"]
        )
        self.cut = self._cut_glued if glued else self._cut_apart if apart else None
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.charmap = "".join(self.letters.values())
        self.marks = {m: self._library(m) for m in ".,\n"}
        self.memory = _Memory(self._glued if glued else self._apart, most_words)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes() if len(ids) > 64 or sys.byteorder != "little" else array(self.code, ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merge(self, piece: str) -> list[int]:
        if not piece.isalnum() or not piece.isascii():  # other characters have stand-ins in the vocabulary
            piece = charmap_decode(piece.encode(), "strict", self.charmap)[0]
        return [t.id for t in self.model.tokenize(piece)]

    def _word(self, word: re.Match, piece: str) -> bytes:
        """A word and the mark behind it, which every tokenizer of these kinds takes apart."""
        if not word[2]:
            return self._pack(self._merge(piece))
        known = self.memory.get(word[1])
        if known is None:
            known = self._pack(self._merge(piece))
        return known + self.marks[word[2]]

    def _glued(self, key: str) -> bytes:
        if key.isalpha():
            found = self.memory[key] = self._pack(self._merge(" " + key))
            return found
        bare, mark = key[:-1], key[-1]
        if not ((mark == "." or mark == ",") and bare.isalpha()):
            marked = _MARKED.fullmatch(key)
            if not marked or not marked[1].isalpha():
                found = self.memory[key] = self._rest(key)
                return found
            bare, mark = marked[1], marked[2]
        known = self.memory.get(bare) or self.memory.old.get(bare)
        if known is None:  # the word alone is kept, so that it is known with and without any marks
            known = self.memory[bare] = self._pack(self._merge(" " + bare))
            return known + self._mark(mark)
        found = self.memory[key] = known + self._mark(mark)
        return found

    def _mark(self, mark: str) -> bytes:
        """Marks behind a word, which are one piece."""
        found = self.marks.get(mark)
        if found is None:
            found = self._library(mark)
            if len(self.marks) < MARKS:
                self.marks[mark] = found
        return found

    def _rest(self, key: str) -> bytes:
        """Keys that are no word, number or word with marks behind a blank."""
        if key.isdigit() and key.isascii():
            return self._pack(self._merge(" " + key))
        word = _WORD.fullmatch(key, 1)
        if word and key[0] in "\n\x00":  # no blank is glued to it; a line end stands alone
            return (self.marks["\n"] if key[0] == "\n" else b"") + self._pack(self._merge(word[1])) + (self.marks[word[2]] if word[2] else b"")
        return self._library(key[1:] if key[:1] == "\x00" else key if key[:1] == "\n" else " " + key)

    def _apart(self, key: str) -> bytes:
        word = _WORD.fullmatch(key)
        found = self.memory[key] = self._word(word, word[1].lower()) if word else self._library(key)
        return found

    def _cut_glued(self, text: str) -> list[str]:
        """Keys of the memory: a leading blank is left out; pieces that begin otherwise are marked by NUL."""
        if text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return [p[1:] if p[0] == " " and p[1:2] not in ("", "\n", " ") else p if p[0] == "\n" else "\x00" + p for p in _CUT.split(text)]
        keys = text.replace("\n", " \n").split(" ")
        if text[0] in " \n":
            return keys[1:]
        keys[0] = "\x00" + keys[0]
        return keys

    @staticmethod
    def _cut_apart(text: str) -> list[str]:
        return text.split()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cut is None or _ODD.search(text) or any(s in text for s in self.special):
            return self._library(text)
        return b"".join(map(self.memory.__getitem__, self.cut(text)))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker process: it is loaded once, and words met by one task are known to the next."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
