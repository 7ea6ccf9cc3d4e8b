"""Words and word shingles of whole texts as 64-bit hashes, in numpy inside tasks.

A word is a maximal run of word bytes in the UTF-8 text. Its hash is a polynomial over the bytes
(uint64, wrapping) taken from running sums, so a whole block of texts is hashed without a loop over
words. Equal words have equal hashes everywhere; two different shingles of a pair of documents meet
with a chance of about n squared in 2**64.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

#: Texts are hashed in blocks of about so many bytes; a longer text is cut between words.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5
STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the 256 bytes, powers of the base and of its inverse modulo 2**64."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        table = np.full(size, base & ((1 << 64) - 1), dtype=np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return values, out[0], out[1]


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words end at white space only.
SPACED = _table(b" \t\n\v\f\r")
#: Words are letters, digits and every byte beyond ASCII.
ALPHANUMERIC = _table(bytes(b for b in range(128) if not chr(b).isalnum()))


def _hash_block(raw: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one block."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = table[data]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    size = 1 << max(20, int(len(data)).bit_length())
    values, powers, inverses = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(raw: bytes, table: np.ndarray) -> np.ndarray:
    """Hashes of all words of a text of any length."""
    if len(raw) <= 2 * BLOCK:
        return _hash_block(raw, table)[0]
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and table[raw[end]]:
            end += 1
        out.append(_hash_block(raw[at:end], table)[0])
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; a shorter text is one run, no words none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = out * STEP + words[k : len(words) - width + 1 + k]
    return mixed(out + np.uint64(width))


def each_words(texts: Sequence[bytes | None], table: np.ndarray) -> Iterator[np.ndarray]:
    """Word hashes of each text, in order; short texts are hashed together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= BLOCK):
            size += len(texts[end] or b"") + 1
            end += 1
        if end == at + 1:
            yield word_hashes(texts[at] or b"", table)
        else:
            block = [x or b"" for x in texts[at:end]]
            hashes, starts = _hash_block(b" ".join(block), table)
            bounds = np.cumsum([len(x) + 1 for x in block])
            yield from np.split(hashes, np.searchsorted(starts, bounds[:-1]))
        at = end


def each_set(texts: Sequence[bytes | None], width: int, table: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order; null and wordless texts give none."""
    for words in each_words(texts, table):
        yield np.unique(shingles(words, width))
