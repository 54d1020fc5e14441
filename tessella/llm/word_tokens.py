"""Whole texts to ids of a word-level BPE (a tokenizers file), by way of a cache of words.

The vocabulary's pre-tokenizer parts words at white space and its normaliser never reaches across it, so a text's ids are
those of what ASCII white space separates, one after another. A worker keeps what it has encoded, up to `cap` words.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Lower-case letters that the normaliser leaves and the pre-tokenizer keeps together, and ASCII signs that it parts from them.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
SIGNS = ".,;:!?*#$%&|()-"
#: Bytes of a word that is held, at most, so that what is held is bounded in bytes.
LONG = 64
PLAIN = re.compile(rf"(?:[a-zß-öø-ÿ]+|[{re.escape(SIGNS)}]+)")
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _SELF} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SELF))}


class WordTokens(dict):
    """From a word's bytes to its packed ids, found when first asked for. When `cap` words are held they become
    the old half, of which what is met again is kept."""

    def __init__(self, path: str, cap: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        self.kind = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.size = array(self.kind).itemsize
        self.cap, self.old = cap, {}
        self.plain = self._keeps_words(json.loads(self.library.to_str()))

    @staticmethod
    def _keeps_words(kind: dict) -> bool:
        """Whether lower-case letters pass normaliser and pre-tokenizer whole, so that the model alone encodes them."""
        steps = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        split = [x["type"] for x in (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            ids = self._ids(word)
            if len(word) > LONG:
                return ids
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain:
            if PLAIN.fullmatch(text):
                return array(self.kind, [t.id for t in self.model(word.decode("latin-1").translate(BYTE_CHARS))]).tobytes()
            core = text.rstrip(SIGNS)
            if len(core) < len(text) and LETTERS.fullmatch(core):
                return self[core.encode()] + self[text[len(core) :].encode()]
        return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, raw: bytes) -> bytes:
        """The packed ids of a UTF-8 text."""
        # a special string counts only as it is spelt; all else is lower-cased anyway
        words = raw.split() if b"<|" in raw or not self.plain else raw.lower().split()
        return b"".join(map(self.__getitem__, words))


_OPEN: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's own encoder of a file."""
    if path not in _OPEN:
        _OPEN[path] = WordTokens(path)
    return _OPEN[path]
