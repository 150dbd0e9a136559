"""Words of many texts at once: 64-bit hashes of lower-cased runs of non-blank bytes, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; only A-Z are lower-cased. Its hash is the polynomial
sum of its bytes modulo 2**64, finished by an avalanche step, so it depends on the word alone: the same on every worker,
in every batch and for every split of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
STEP = 1 << 20  # bytes handled at once


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, STEP + 1)
        one = np.ones(1, np.uint64)
        inverse = pow(BASE, -1, 1 << 64)
        for k, base in enumerate((BASE, inverse)):
            _POWERS[k] = np.concatenate([one, np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
    return _POWERS[0], _POWERS[1]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche step on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


@dataclass
class Words:
    """Words of a run of texts. ``at[i]:at[i + 1]`` are the words of text i; starts and ends are byte positions in data."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def _segment(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; ``cuts`` are positions where a word ends at the latest."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    inside = ~BLANK[data]
    joined = np.zeros(n + 1, bool)
    joined[1:n] = inside[1:] & inside[:-1]
    joined[cuts] = False
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def hash_word(word: str) -> int:
    """The hash that a single word gets (0 for a text without words)."""
    got = words_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
    return int(got.hashes[0]) if len(got.hashes) else 0


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``. Work arrays hold one step of bytes, however long a text is."""
    parts, begin, n = [], 0, len(data)
    while begin < n:
        end = min(begin + STEP, n)
        while end < n:  # go on to the next blank or to the next text
            more = data[end : end + STEP]
            blank = np.flatnonzero(BLANK[more])
            text = offsets[np.searchsorted(offsets, end)]
            stop = min(end + (int(blank[0]) if len(blank) else len(more)), int(text))
            found = len(blank) > 0 or text <= end + len(more)
            end = stop
            if found:
                break
        cuts = offsets[(offsets >= begin) & (offsets <= end)] - begin
        h, s, e = _segment(data[begin:end], cuts)
        parts.append((h, s + begin, e + begin))
        begin = end
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; NULL counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each; a longer text is a run of its own."""
    _, offsets = buffers(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def batch_words(batch: pa.RecordBatch, text: str = "text") -> Words:
    return words_of(*buffers(batch.column(text)))
