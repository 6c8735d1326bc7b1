"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Word hashes are
Rabin-Karp polynomials over the bytes, window hashes are Rabin-Karp polynomials
over the word hashes, both modulo 2**64 and finished by a 64-bit mixer.  All of it
runs as whole-array numpy operations on pieces of bounded size, so neither a long
text nor a large batch needs more than some 20 MB of scratch space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes (or words) hashed at a time
_U = np.uint64
_BASE_BYTE = _U(0x9E3779B97F4A7C15)
_BASE_WORD = _U(0xD1342543DE82EF95)
_BASE_CHECK, _KEY_CHECK = _U(0xA0761D6478BD642F), _U(0x8EBC6AF09C88C6E3)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(1, 257, dtype=np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += _U(32)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijective mixer (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= PIECE + 1:
            _powers[base] = have
    return have[:n]


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[s:e] for each pair, independent of where it lies."""
    n = len(values)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(values * _power(int(base), n), dtype=np.uint64, out=prefix[1:])
    back = _power(pow(int(base), -1, 1 << 64), n + 1)
    return (prefix[ends] - prefix[starts]) * back[starts]


def text_buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n+1 offsets; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each text, where its words begin (n+1 offsets into the hashes)."""
    table = _LOWER if lower else _SAME
    hashes, places, at, end = [], [], 0, len(data)
    while at < end:
        stop = min(end, at + PIECE)
        if stop < end:  # cut at white space, so that no word is split
            gaps = np.flatnonzero(_SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            while stop < end and not len(gaps):
                more = min(end, stop + PIECE)
                gaps = np.flatnonzero(_SPACE[data[stop:more]])
                stop = stop + int(gaps[0]) if len(gaps) else more
        piece = data[at:stop]
        word = np.zeros(len(piece) + 1, dtype=bool)
        np.logical_not(_SPACE[piece], out=word[:-1])
        first = word[:-1].copy()
        first[1:] &= ~word[:-2]
        last = word[:-1] & ~word[1:]
        lo, hi = np.searchsorted(offsets, [at, stop])
        cuts = offsets[lo:hi] - at  # texts that begin in this piece
        first[cuts] |= word[cuts]
        inner = cuts[cuts > 0]
        last[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(starts):
            hashes.append(mix(_span_hash(table[piece], starts, ends, _BASE_BYTE)))
            places.append(starts + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def hash_windows(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE_WORD) -> np.ndarray:
    """Rabin-Karp hash of words[s:e] for each pair; the pairs must be in ascending order of s."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        upto = max(at + 1, int(np.searchsorted(starts, first + PIECE)))
        top = int(ends[at:upto].max())
        out[at:upto] = mix(_span_hash(words[first:top], starts[at:upto] - first, ends[at:upto] - first, base))
        at = upto
    return out


def check_windows(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32 bits more of each window, by another polynomial over words that are mixed anew."""
    return (hash_windows(mix(words ^ _KEY_CHECK), starts, ends, _BASE_CHECK) >> _U(32)).astype(np.uint32)


def distinct_pairs(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (hash, check) pairs in order, which of them each row is, and how many rows each has."""
    order = np.argsort(hashes, kind="stable")
    a, b = hashes[order], checks[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # two windows of one hash, or copies between them: order them by both
        order = np.lexsort((checks, hashes))
        a, b = hashes[order], checks[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return a[new], b[new], which, np.diff(np.append(begin, len(a)))


def fixed_windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """The first word of every full window of each text, ascending."""
    n = int(bounds[-1])
    if n < width:
        return np.zeros(0, np.int64)
    room = np.repeat(bounds[1:], np.diff(bounds))  # where the text of each word ends
    at = np.arange(n, dtype=np.int64)
    return at[at + width <= room]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by hash range, so that sorted hashes have sorted buckets."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences of 6 bytes each where they all fit, else 8; the first byte says which."""
    if not len(hashes):
        return b""
    step = np.empty_like(hashes)
    step[0] = hashes[0]
    np.subtract(hashes[1:], hashes[:-1], out=step[1:])
    width = 6 if len(step) > 1 and int(step[1:].max()) < 1 << 48 else 8
    body = step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(step[0]).to_bytes(8, "little") + body.tobytes()


def value_ranges(hashes: list[np.ndarray], most: int) -> list[list[slice]]:
    """Cuts of ascending arrays of hashes, none of them empty, into ranges of values that hold about ``most`` in all:
    for each range a slice per array.  Equal hashes stay together."""
    low, high = min(int(x[0]) for x in hashes), max(int(x[-1]) for x in hashes)
    pieces = sum(map(len, hashes)) // most + 1
    edges = np.array([low + (high - low) * k // pieces for k in range(pieces)], np.uint64)
    cuts = [np.append(np.searchsorted(x, edges), len(x)).tolist() for x in hashes]
    return [[slice(c[k], c[k + 1]) for c in cuts] for k in range(pieces)]


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body) + 1, 8), np.uint8)
    step[1:, :width] = body
    step = step.view("<u8").reshape(-1)
    step[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(step, dtype=np.uint64)
