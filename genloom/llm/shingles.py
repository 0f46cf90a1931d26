"""Sets of hashed word shingles, for whole batches of texts at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ship_by_value

ship_by_value(__name__)

PIECE = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its lower-cased value if it belongs to a word (0-9, A-Z, a-z, or any above 127), and whether it does."""
    byte = np.arange(256)
    upper = (byte >= 65) & (byte <= 90)
    word = ((byte >= 48) & (byte <= 57)) | upper | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    return np.where(upper, byte + 32, byte).astype(np.uint64), word


_held: dict[str, tuple] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; those for a whole piece are kept."""
    if n > PIECE:
        return _power_tables(n)
    if "powers" not in _held:
        _held["powers"] = _power_tables(PIECE)
    return _held["powers"]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = pow(int(BASE), -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (BASE, np.uint64(inverse)))
    return up, down


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of the texts data[offsets[i]:offsets[i + 1]], in order."""
    lower, is_word = _tables()
    base = offsets[0]
    part = data[base : offsets[-1]]
    if not len(part):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.zeros(len(part) + 1, bool)
    first[offsets - base] = True
    inside = is_word[part]
    starts = np.flatnonzero(inside & (first[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _powers(len(part))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(lower[part] * up[: len(part)], dtype=np.uint64)))
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets - base, starts, side="right") - 1


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: runs of `width` words, or all words if there are fewer."""
    data, offsets = text_buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        hashes, text = word_hashes(data, offsets[at : end + 1])
        bounds = np.searchsorted(text, np.arange(end - at + 1))
        if len(hashes) >= width:
            runs = np.zeros(len(hashes) - width + 1, np.uint64)
            for i in range(width):
                runs = mix64(runs * np.uint64(3) + hashes[i : i + len(runs)])
        else:
            runs = np.empty(0, np.uint64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in hashes[a:b]:
                    h = mix64(np.array([h], np.uint64) * np.uint64(3) + x)[0]
                yield np.array([h], np.uint64)
            else:
                yield np.empty(0, np.uint64)
        at = end
