"""Words and shingles of whole batches of texts as 64-bit hashes, by array operations over their bytes.

Words are runs of anything but ASCII white space, with A-Z in lower case. Equal words have equal hashes; different ones
collide with chance 2^-64.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4_000_000  # text handled at once; one longer text makes a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2 ** 64)
SHINGLE = 5


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits; other salts give other orders."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + salt) % 2 ** 64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, count: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    out = np.full(count, base % 2 ** 64, np.uint64)
    if count:
        out[0] = 1
    return np.multiply.accumulate(out)


def chunks(batches: Iterator[pa.RecordBatch], column: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their texts and the place where each begins (and the last ends)."""
    for batch in batches:
        texts = batch.column(column)
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1, first + 1)
            yield batch.slice(first, last - first), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            first = last


class Words:
    """Word hashes of one chunk after another; keeps the tables that all chunks need."""

    def __init__(self):
        lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
        self.numbers = mix(lower + np.uint64(1), 7)  # the same for both cases of a letter
        self.inside = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
        self.powers = self.inverses = np.empty(0, np.uint64)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and how many each text has."""
        inside = self.inside[data]
        edge = np.empty(len(data) + 1, bool)  # white space or another text before this byte
        edge[0] = edge[-1] = True
        np.logical_not(inside[:-1], out=edge[1:-1])
        edge[offsets] = True
        starts = np.flatnonzero(inside & edge[:-1])
        edge[:-1] |= ~inside
        ends = np.flatnonzero(inside & edge[1:]) + 1
        if len(self.powers) < len(data):
            self.powers, self.inverses = _powers(_BASE, len(data)), _powers(_BASE_INVERSE, len(data))
        terms = self.numbers[data]
        terms *= self.powers[:len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        places = np.searchsorted(starts, offsets)
        return hashes, np.diff(places)


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and how many each text has. A text with fewer words is one run of all of them."""
    ends = np.cumsum(counts)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.repeat(ends - counts, runs) + _ramp(runs)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    length = np.repeat(np.minimum(counts, width), runs)
    for k in range(width):
        term = mix(padded[first + k], k + 1)
        total += np.where(k < length, term, np.uint64(0))
    return mix(total + length.astype(np.uint64)), runs


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in rising order, and how many each has. `values` is sorted in place."""
    ends = np.cumsum(counts)
    keep = np.ones(len(values), bool)
    for first, last in zip((ends - counts).tolist(), ends.tolist()):
        values[first:last].sort()
    keep[1:] = values[1:] != values[:-1]
    keep[(ends - counts)[counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[ends] - kept[ends - counts]
