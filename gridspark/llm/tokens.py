"""Encoders over the public tokenizer files, with a bounded cache of words.

Both vocabularies treat the stretches between single blanks independently, so a stretch is handed to
the tokenizers library once per worker while it stays in the cache, and its ids are reused. The
cache is a speed-up only: any stretch it lacks is encoded by the library.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Entries after which a worker's cache is emptied, and the longest stretch that is kept.
CACHE_ENTRIES = 700_000
CACHE_CHARS = 48
# Characters encoded at a time.
SLICE_CHARS = 2_000_000


class Encoder:
    """Ids of whole texts as little-endian 16-bit (or 32-bit, for larger vocabularies) integers."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.cache: dict[str, bytes] = {}
        self.entries = entries

    def library_ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(parts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def stretches(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        batch: list[list[str]] = []
        size = 0
        for text in texts:
            batch.append(self.stretches(text))
            size += len(text)
            if size > SLICE_CHARS:
                out += self._encode(batch)
                batch, size = [], 0
        return out + self._encode(batch)

    def _encode(self, batch: list[list[str]]) -> list[bytes]:
        cache = self.cache
        missing = list(set().union(*batch).difference(cache))
        if missing:
            cache.update(zip(missing, self.library_ids(missing)))
        out = [b"".join(map(cache.__getitem__, words)) for words in batch]
        for word in missing:
            if len(word) > CACHE_CHARS:
                del cache[word]
        if len(cache) > self.entries:
            cache.clear()
        return out


# Stands between stretches that go to the library together; stretches that hold it go alone.
MARK = "\x02"
TOGETHER = 64


class WordEncoder(Encoder):
    """For a vocabulary that drops white space: stretches between blanks and line ends."""

    def stretches(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def library_ids(self, parts: list[str]) -> list[bytes]:
        """The call's cost is mostly per text, so many short stretches go as one, a marked word between each two."""
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1 or any(MARK in p for p in parts):
            return super().library_ids(parts)
        groups = [parts[at:at + TOGETHER] for at in range(0, len(parts), TOGETHER)]
        found = self.tokenizer.encode_batch([f" {MARK} ".join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for e in found:
            ids = np.array(e.ids, self.dtype)
            data, size = ids.tobytes(), self.dtype.itemsize
            ends = (np.flatnonzero(ids == mark[0]) * size).tolist()
            out += [data[a:b] for a, b in zip([0, *[e + size for e in ends]], [*ends, len(data)])]
        return out


BESIDE_SPACE = re.compile(r"\s | \s")
WORD_GAP = re.compile(r"(?<=\S)(?= \S)")


class ByteEncoder(Encoder):
    """For a byte-level vocabulary whose words carry the blank before them.

    A blank between two characters that are no white space always starts a new word, so a text may be
    cut before it.
    """

    def stretches(self, text: str) -> list[str]:
        if BESIDE_SPACE.search(text):
            return WORD_GAP.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]]


@functools.cache
def word_encoder(path: str, entries: int = CACHE_ENTRIES) -> WordEncoder:
    return WordEncoder(path, entries)


@functools.cache
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
