"""Ids of byte-level BPE tokenizers, word by word.

The tokenizers library gives every id, but it spends nearly all its time on cutting a text into words and
on tracing characters, measured as 1 MB a second a core. Here texts are cut by the same pattern and each distinct
word goes through the model of that library, two to five times as fast. Cutting and encoding a word by itself gives
what it gives within its text, as the pattern never looks past a word's end but for a blank run's last character,
which a run by itself keeps. The pattern is used only on texts of characters whose classes no version
of Unicode has changed; texts with others, or with the string of a special token, go through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

_LAST = 0x24F  # the end of Latin Extended-B
_KEPT, _LONGEST = 1 << 18, 64  # words kept by a worker, twice at most, and the characters that one of them may have
_OTHER = re.compile(rf"[^\t-\r -~\xa0-{chr(_LAST)}]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST + 1) if unicodedata.category(chr(c)).startswith(kind))


_L, _N, _S = _class("L"), _class("N"), r"\t-\r \xa0"
#: The public pattern of this family of tokenizers, with its classes spelt out for the characters that _OTHER lets through.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class ByteTokens:
    """plain: strings of special tokens in texts are ordinary text."""

    def __init__(self, path: str, plain: bool) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        special = [] if plain else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kept: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}  # those of before, when kept was full
        self.model, self.spelt = self.whole.model, _spelling()
        self.raw = _raw(self.whole)

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        # Of printable ASCII only the blank is spelt otherwise.
        spelt = word.replace(" ", self.spelt[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.spelt)
        return array("i", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for text in texts:
            if _OTHER.search(text) or (self.special and self.special.search(text)):
                out.append(np.array(self._all([text])[0], dtype=np.int32))
                continue
            words = _WORDS.findall(text)
            if len(self.kept) > _KEPT:
                self.older, self.kept = self.kept, {}  # words that come again are taken over from there
            new = set(words).difference(self.kept)
            for w in new:
                self.kept[w] = self.older.get(w) or self._word(w)
            out.append(np.frombuffer(b"".join(map(self.kept.__getitem__, words)), dtype=np.int32))
            for w in new:
                if len(w) > _LONGEST:
                    del self.kept[w]
        return out


def _spelling() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 up."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(own))}


def _raw(tokenizer) -> list[bytes]:
    """The bytes of each id."""
    byte = {c: b for b, c in _spelling().items()}
    special = {t.content: t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()}
    names = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        out[i] = special[name] if name in special else bytes(byte[c] for c in name)
    return out


@lru_cache(maxsize=4)
def load(path: str, plain: bool) -> ByteTokens:
    return ByteTokens(path, plain)


def vocabulary_path() -> str:
    """The public 50k vocabulary, where the box has it; the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
