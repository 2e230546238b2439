"""Words of many texts at once, and 64-bit hashes of words and of runs of words.

A word's hash is the BLAKE2b digest of its bytes, computed once per distinct word
and chunk (digests of ``KEPT_WORDS`` words are remembered), in two independent
lanes of 64 bits. Hashes of runs are put together by doubling, with a mix that is
not linear in the words, so no arrangement of words makes runs collide by
construction. Everything works on chunks of whole texts of about ``CHUNK_BYTES``;
a longer text is a chunk of its own (about 40 bytes of memory per byte of it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Letters A-Z to a-z; every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and ASCII bytes that are neither letters nor digits become spaces.
LOWER_ALNUM = bytes(
    32 if b < 48 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else LOWER[b] for b in range(256)
)

#: Distinct words whose digests a process remembers.
KEPT_WORDS = 100_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class _Digests(dict):
    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return found


_digests = _Digests()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a run followed by a run."""
    return mix(a * _ODD[0] + mix(b ^ _ODD[1]))


class Words:
    """Words (runs of bytes other than ASCII white space) of a few whole texts.

    ``bounds[i]:bounds[i + 1]`` are the words of text i; ``lanes`` has two
    64-bit hashes per word.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.bounds = np.cumsum([0, *map(len, split)])
        if len(_digests) > KEPT_WORDS:
            _digests.clear()
        data = b"".join(map(_digests.__getitem__, chain.from_iterable(split)))
        self.lanes = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").astype(np.uint64).reshape(-1, 2).T)
        self.hashes = self.lanes[0]

    def runs(self, k: int, lane: int = 0) -> np.ndarray:
        """Hash of the ``k`` words from each word on (texts are not told apart here; see ``starts``)."""
        block, size = self.lanes[lane], 1
        n = len(block) - k + 1
        if n < 1:
            return np.zeros(0, dtype=np.uint64)
        found, done = None, 0
        while True:  # blocks of 1, 2, 4, ... words; those that k is the sum of follow each other
            if k & size:
                part = block[done : done + n]
                found = mix(part) if found is None else _follow(found, part)
                done += size
            if done == k:
                return found
            block = _follow(block[:-size], block[size:])
            size *= 2

    def starts(self, i: int, k: int) -> tuple[int, int]:
        """Range of words of text i from which ``k`` words of the same text follow."""
        a, b = int(self.bounds[i]), int(self.bounds[i + 1])
        return a, max(a, b - k + 1)
