"""Whole texts of an Arrow batch as one byte array, with words, lines and hashes of ranges.

All functions work on a chunk of a batch (a few MB of text, or a single longer text), so
the memory of a task does not depend on the size of its partition. The hash of a byte range
is a difference of running sums ``code[b] * p**i`` modulo 2**64, shifted back to ``p**0``
and mixed; ranges of any length cost the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1 << 16

_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:  # the table for one huge text is not kept
            _powers[base] = have
    return have[:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * p**i``; one longer than the input."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(_STEP, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every range [start, end) over the values behind ``prefix``."""
    return mix((prefix[end] - prefix[start]) * _power_table(_STEP_INVERSE, len(prefix))[start])


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n values in a row."""
    prefix = running(values)
    out = prefix[n:] - prefix[:-n]
    out *= _power_table(_STEP_INVERSE, len(out))
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_lower = np.arange(256)
_lower[65:91] += 32
#: Upper-case A-Z count as lower-case.
FOLDED_CODES = BYTE_CODES[_lower]

_b = np.arange(256)
#: Bytes of a word ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_b == 0x20) | ((_b >= 0x09) & (_b <= 0x0D)))
#: Bytes of a word ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text with A-Z lower-cased.
ALNUM = (_b >= 0x80) | ((_b >= 0x30) & (_b <= 0x39)) | ((_b >= 0x61) & (_b <= 0x7A)) | ((_b >= 0x41) & (_b <= 0x5A))
#: Bytes that begin a code point.
LEADS = (_b & 0xC0) != 0x80


@dataclass
class Texts:
    """Texts of a chunk; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many of its bytes are flagged."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def texts_of(array: pa.Array) -> Texts:
    """Texts of a string array; null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    if n == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(array.buffers()[1], width)[array.offset : array.offset + n + 1].astype(np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with at most ``limit`` bytes of text (a longer text alone) and ``CHUNK_ROWS`` rows."""
    whole = texts_of(batch.column(batch.schema.get_field_index(text)))
    begin = 0
    while begin < len(whole):
        end = int(np.searchsorted(whole.offsets, whole.offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), begin + CHUNK_ROWS, len(whole))
        low, high = whole.offsets[begin], whole.offsets[end]
        yield batch.slice(begin, end - begin), Texts(whole.data[low:high], whole.offsets[begin : end + 1] - low)
        begin = end


@dataclass
class Words:
    """Words of a chunk in text order; text i has words ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every window of n words inside a text, and the window's hash."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self))
        at = np.flatnonzero(left >= n)
        return at, range_hash(running(self.hash), at, at + n)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of True that do not cross an offset."""
    n = len(inside)
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | breaks[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    return start, end


def words_of(texts: Texts, members: np.ndarray, codes: np.ndarray) -> Words:
    """Maximal runs of member bytes, hashed over ``codes``."""
    start, end = _runs(members[texts.data], texts.offsets)
    first = np.searchsorted(start, texts.offsets)
    prefix = running(codes[texts.data])
    return Words(start, end, first, range_hash(prefix, start, end))


def lines_of(texts: Texts) -> Words:
    """Lines split at \\n, the last one included; an empty text has one empty line."""
    n = len(texts.data)
    cut = np.flatnonzero(texts.data == 10)
    start = np.sort(np.concatenate([texts.offsets[:-1], cut + 1]))
    end = np.sort(np.concatenate([texts.offsets[1:], cut]))
    in_text = np.zeros(n + 1, np.int64)
    in_text[1:] = np.cumsum(texts.data == 10)
    counts = in_text[texts.offsets[1:]] - in_text[texts.offsets[:-1]] + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    return Words(start, end, first, range_hash(running(BYTE_CODES[texts.data]), start, end))


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: occurs more than once; occurs earlier."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    anywhere, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    anywhere[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return anywhere, earlier


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Flags of 0..n-1: inside one of the ranges [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0


def totals(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over every range ``first[i]`` to ``first[i + 1]``."""
    total = np.zeros(len(flags) + 1, np.asarray(flags).dtype if np.asarray(flags).dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
