"""Word, line and n-gram arithmetic over whole Arrow string columns, without a loop per word.

A word is a run of bytes other than space, tab and the line breaks 0x0A-0x0D. Hashes have 64 bits: a polynomial over a
random table of the bytes, then mixed; equal runs have equal hashes at any place of any batch and on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_BYTES = mix(np.arange(1, 257, dtype=_U))
GRAM = mix(np.arange(257, 257 + 32, dtype=_U)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0], _powers[1]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text: memory follows the longest text, not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the texts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column) or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `solid` bytes, cut where a text begins; the run that each text begins with."""
    n = len(solid)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:n]
    last[:-1] &= ~solid[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0x2545F4914F6CDD1D))


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = AS_IS):
    """Hash of each word, and the n + 1 word indices at which the texts begin."""
    starts, ends, bounds = runs(~SPACE[data], offsets)
    return run_hashes(fold[data], starts, ends), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """Index of the text that each item belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def grams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n consecutive words at each place, and which places lie in one text."""
    if len(h) < n:
        return np.zeros(0, _U), np.zeros(0, bool)
    room = len(h) - n + 1
    g = np.zeros(room, _U)
    for k in range(n):
        g += h[k:k + room] * GRAM[k]
    last = np.repeat(bounds[1:], np.diff(bounds))[:room]
    return mix(g), np.arange(room) + n <= last


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once; all but one of each in `later`."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def code_points(data: np.ndarray) -> np.ndarray:
    """1 at the first byte of each character."""
    return (data & 0xC0) != 0x80
