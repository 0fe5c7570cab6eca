"""Word and shingle hashes of Arrow text columns, vectorised over the bytes.

Texts are UTF-8 in both Arrow and here, and every separator used is ASCII,
so words are found on bytes.  A word's hash is a polynomial over a random
byte table modulo 2**64, finished by a 64-bit mixer; a shingle's hash mixes
the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: bytes that are part of a word, by rule: everything but white space / ASCII
#: letters, digits and all non-ASCII characters
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_SEGMENT = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * _SEGMENT:  # an enormous word's table isn't kept
            _powers[str(base)] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """Starts and ends of all words (runs of bytes in ``kind`` that don't
    cross a text's end), and each text's range of words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts_here[cuts] |= inside[1:-1][cuts]
    ends_here[cuts - 1] |= inside[1:-1][cuts - 1]
    starts = np.flatnonzero(starts_here)
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *shorter: np.ndarray):
    """64-bit hash of each span, letters A-Z as a-z; with ``shorter`` ends, a
    list that also holds the hashes of the spans cut there.  Works through
    segments of whole spans, so its memory doesn't grow with a text's length
    (but for a single word's)."""
    outs = [np.empty(len(starts), np.uint64) for _ in range(1 + len(shorter))]
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _SEGMENT)))
        high = int(ends[at:to].max())
        code = _CODE[data[low:high]] * _power(_BASE, high - low)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(code, out=sums[1:])
        first = starts[at:to] - low
        undo = _power(_INVERSE, high - low)[first]
        for out, stop in zip(outs, (ends, *shorter)):
            last = stop[at:to] - low
            out[at:to] = mix((sums[last] - sums[first]) * undo + (last - first).astype(np.uint64))
        at = to
    return outs if shorter else outs[0]


def shingle_sets(texts: pa.Array, width: int, kind: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``width`` words each; a
    text with fewer words has its whole sequence as one; none without words."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets, kind)
    words = span_hashes(data, starts, ends)
    n = max(0, len(words) - width + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined = mix(joined * U(0x2545F4914F6CDD1D) + words[k:k + n])
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            got = joined[a:b - width + 1].copy()
            got.sort()
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            yield got[keep]
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix(whole * U(0x2545F4914F6CDD1D) + words[k:k + 1])
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def batches_by_bytes(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each (at least a
    row), so that working memory is bounded by the longest text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at = 0
    total = np.cumsum(lengths)
    while at < len(lengths):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
