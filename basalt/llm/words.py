"""Vectorised words, shingles and their 64-bit hashes over Arrow string columns, and exact numbers for both.

A word is a maximal run of 0-9, a-z (A-Z count as a-z) and characters beyond ASCII. In UTF-8 every byte of
such a character is at least 0x80, so runs of bytes are runs of characters and whole Arrow buffers can be
cut at once, without a Python string for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  #: bytes of whole rows that are cut and hashed at once
LONG = 64  #: bytes from which on a span is hashed and compared on its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x], dtype=np.uint64))[0])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; none crosses an offset."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    at = offsets[:-1][some]
    first[at] = inside[at]
    at = offsets[1:][some] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def eights(buf: np.ndarray) -> np.ndarray:
    """For every byte the number that it and the seven after it make; zeros follow the last."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded.data, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: every eight bytes go through a full mix; spans beyond LONG through BLAKE2."""
    eight, size = eights(buf), ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) ^ np.uint64(mix_int(seed)))
    live, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        out[live] = mix(out[live] * _ODD ^ (eight[starts[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    out = mix(out ^ size.astype(np.uint64) * _ODD)
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw, key = buf.tobytes(), seed.to_bytes(8, "little")
        out[far] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, starts2: np.ndarray, ends2: np.ndarray, left: np.ndarray | None = None, right: np.ndarray | None = None) -> np.ndarray:
    """Whether the bytes of each span of buf are those of the span of other beside it. left, right: eights() of both, if there already."""
    size, k = ends - starts, 0
    out = size == ends2 - starts2
    left = eights(buf) if left is None else left
    right = right if right is not None else left if other is buf else eights(other)
    live = np.flatnonzero(out & (size > 0))
    while len(live) and k < LONG:
        same = ((left[starts[live] + k] ^ right[starts2[live] + k]) & _MASK[np.minimum(size[live] - k, 8)]) == 0
        out[live[~same]] = False
        k += 8
        live = live[same & (size[live] > k)]
    for i in live.tolist():
        out[i] = buf[starts[i] : ends[i]].tobytes() == other[starts2[i] : ends2[i]].tobytes()
    return out


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span, a span of each number). Hashes bring spans together, but equal numbers mean equal bytes."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    of = first[which]
    if not same_spans(buf, starts, ends, buf, starts[of], ends[of]).all():
        raw, seen = buf.tobytes(), {}
        which = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64)
        first = np.unique(which, return_index=True)[1]
    return which, first


@dataclass
class Block:
    """Rows lo to hi of a column: their bytes, these with A-Z lower-cased, and all their words. at: where each row's words begin.

    A block may be a part of one row: skip bytes of it stand before, and rest after.
    """

    lo: int
    hi: int
    buf: np.ndarray
    low: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    skip: int = 0
    rest: int = 0


LINE_FEED = np.arange(256) == 10
NO_WORD = ~_IS_WORD


def cuts(buf: np.ndarray, after: np.ndarray, chunk: int) -> Iterator[tuple[int, int]]:
    """From and to of parts of about chunk bytes, or longer where none of the bytes in after (a 256-entry set) comes: each ends behind one."""
    lo = 0
    while lo < len(buf):
        hi = lo + chunk
        if hi < len(buf):
            found = np.flatnonzero(after[buf[lo:hi]])
            while not len(found) and hi < len(buf):
                lo_, hi = hi, hi + chunk
                found = np.flatnonzero(after[buf[lo_:hi]])[:1] + lo_ - lo
            hi = lo + int(found[-1]) + 1 if len(found) else len(buf)
        yield lo, min(hi, len(buf))
        lo = hi


def blocks(column: pa.Array, chunk: int = CHUNK, seed: int = 0, cut: np.ndarray | None = None) -> Iterator[Block]:
    """The column in blocks of about chunk bytes, of whole rows. seed is that of the words' hashes.

    With cut, a 256-entry set of bytes that are in no word, a longer row comes in parts that end behind such a byte.
    """
    buf, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        whole, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        parts = [(0, len(whole))] if cut is None or len(whole) <= chunk else cuts(whole, cut, chunk)
        for a, b in parts:
            part = whole[a:b]
            if b - a < len(whole):
                off = np.array([0, b - a])
            starts, ends = runs(_IS_WORD[part], off)
            low = LOWER[part]
            yield Block(lo, hi, part, low, off, starts, ends, span_hashes(low, starts, ends, seed), np.searchsorted(starts, off), a, len(whole) - b)
        lo = hi


def shingles(hashes: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each row, and where each row's begin. A row of 1 to n - 1 words has one: all of them."""
    words = np.diff(at)
    each = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.concatenate([[0], np.cumsum(each)])
    pos = np.arange(begin[-1]) + np.repeat(at[:-1] - begin[:-1], each)
    end = np.repeat(at[1:], each)
    out = np.zeros(len(pos), dtype=np.uint64)
    short = words.size and int(words[words > 0].min(initial=n)) < n
    for k in range(n):
        out *= _STEP
        if short:
            there = pos + k < end
            out[there] += hashes[pos[there] + k]
        elif len(pos):
            out += hashes[pos + k]
    return mix(out), begin


def count_runs(column: pa.Array, inside: np.ndarray) -> np.ndarray:
    """How many runs of bytes in the 256-entry set each row has."""
    buf, offsets = text_buffer(column)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (CHUNK << 2), "right")) - 1)
        off = offsets[lo : hi + 1] - offsets[lo]
        starts, _ = runs(inside[buf[offsets[lo] : offsets[hi]]], off)
        out[lo:hi] = np.diff(np.searchsorted(starts, off))
        lo = hi
    return out


def numbered_shingles(numbers: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers of each row's runs of n words, and where each row's begin. Equal numbers mean equal words.

    numbers are the words' own; a row of 1 to n - 1 words has one run: all of them.
    """
    if n == 1:
        which, begin = numbers, at
    else:
        hashes, begin = shingles(mix(numbers.astype(np.uint64)), at, n)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        each = np.diff(begin)
        pos = np.arange(len(hashes)) + np.repeat(at[:-1] - begin[:-1], each)
        size = np.minimum(np.repeat(np.diff(at), each), n)
        of, same = first[which], size == size[first[which]]
        for k in range(n):
            here = np.flatnonzero(same & (size > k))
            same[here] = numbers[pos[here] + k] == numbers[pos[of[here]] + k]
        if not same.all():  # two runs share a hash
            wide = np.full((len(pos), n), -1, dtype=np.int64)
            for k in range(n):
                here = size > k
                wide[here, k] = numbers[pos[here] + k]
            which = np.unique(wide, axis=0, return_inverse=True)[1].ravel()
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((which, row))
    row, which = row[order], which[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1])
    return which[new], np.searchsorted(row[new], np.arange(len(begin)))
