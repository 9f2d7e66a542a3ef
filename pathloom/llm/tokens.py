"""Token ids of whole texts by a public vocabulary file, with a bounded cache of white-space words."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import regex

#: Characters of the longest word that is kept.
LONGEST = 64
#: Characters that str.split() takes for white space and the vocabulary's own rule does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The vocabulary's own split, as its file states it.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_TAIL = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@[-`{-~]+)")
_LATIN = re.compile("[\x21-\x7e\xa1-ɏ]+")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


_LETTER = _byte_letters()


class WordIds(dict):
    """Word -> its ids as little-endian 32-bit bytes. Memory is bounded: at ``most`` words they become the old ones, from
    which words in use return, and the old ones before them go; words of more than LONGEST characters are not kept."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.model, self.most, self.old = tokenizer, tokenizer.model, most, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self._ids(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out

    def _ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            lower = word.lower()
            return self._letters(word) if lower == word else self[lower]
        tail = _TAIL.fullmatch(word)
        if tail:  # letters, then a mark or a run of marks: two parts of the vocabulary's split
            return self[tail[1]] + self[tail[2]]
        if _LATIN.fullmatch(word):
            return b"".join([self._letters(part) for part in _PARTS.findall(unicodedata.normalize("NFC", word).lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, part: str) -> bytes:
        shown = part if part.isascii() else "".join([_LETTER[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str, most: int = 200_000) -> WordIds:
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), most)


def text_ids(text: str | None, words: WordIds) -> bytes:
    """The ids of a whole text. Its vocabulary drops white space and never joins over it, so words are encoded
    one by one; a text with control strings or separators that split() treats otherwise is encoded as a whole."""
    if not text:
        return b""
    if "<|" in text or _ODD_SPACE.search(text):
        return array("I", words.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    return b"".join(map(words.__getitem__, text.split()))
