"""Ids of the word-end BPE vocabulary, equal to the tokenizers library's.

The vocabulary normalises (NFC, lower case), drops white space and marks the
last symbol of a word.  Texts whose characters all lie below U+0250 are split
here, and each distinct word is merged once by the rank arrays of `bpe`; any
other text, and one that holds a special string, goes to the library itself,
so no rule of Unicode is restated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

from lodestream.llm.bpe import CACHE_WORDS, NOT_LATIN, Codec, Vocabulary

#: How the vocabulary's pre-tokeniser splits lower-cased text below U+0250 (public pattern, letters and numbers spelt out).
WORDS = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+").findall
END = b"</w>"
LONG = 100  # characters of a word that is not kept


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordVocabulary(Vocabulary):
    def __init__(self, path: str):
        super().__init__(path)
        self.last = np.array([self.ids[bytes([b]) + END] for b in range(256)], np.int64)

    def parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = self.single[words]
        part[:, -1] = self.last[words[:, -1]]
        rank = self.first[words[:, :-1], words[:, 1:]]
        if words.shape[1] > 1:
            rank[:, -1] = self.ranks(part[:, -2], part[:, -1])
        return part, rank


class WordCodec(Codec):
    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.vocabulary, self.limit, self.path = WordVocabulary(path), limit, path
        self.words: dict[str, bytes] = {}
        self.library = None

    def _ask(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit."""
        split: list[list[str] | None] = []
        for text in texts:
            low = text.lower()
            split.append(None if NOT_LATIN.search(low) or any(x in text for x in self.vocabulary.special) else WORDS(low))
        if len(self.words) > self.limit:
            self.words.clear()
        new = set(chain.from_iterable(x for x in split if x)).difference(self.words)
        self._learn(new)
        of = self.words.__getitem__
        out = [b"".join(map(of, words)) if words is not None else self._ask(text) for text, words in zip(texts, split)]
        for word in new:
            if len(word) > LONG:
                del self.words[word]
        return out


@lru_cache(maxsize=1)
def codec_of(path: str) -> WordCodec:
    """The codec of a Python worker: the vocabulary is read once and its words are kept between tasks."""
    return WordCodec(path)


def halves(ids: bytes) -> bytes:
    """Ids of 32 bits as 16 bits."""
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def pieces(ids: bytes, cut: Iterator[tuple[int, int]]) -> list[bytes]:
    """Stretches (start, length) of ids of 16 bits, as 32 bits."""
    whole = np.frombuffer(ids, "<u2").astype("<u4")
    return [whole[a : a + n].tobytes() for a, n in cut]
