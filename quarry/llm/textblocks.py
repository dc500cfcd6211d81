"""Whole texts as blocks of bytes, and hashes of their words by array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes a block holds, unless a single text is longer.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240501)
_BASE = U(int(_rng.integers(1 << 60, 1 << 63)) * 2 + 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[str, np.ndarray] = {}


@dataclass
class Block:
    """ids: the rows' ids; raw: all bytes; ends: where each text ends in raw, after a leading 0."""

    ids: pa.Array
    raw: np.ndarray
    ends: np.ndarray


def text_blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[Block]:
    """Blocks of batches (id, text): a null text is empty."""
    for batch in batches:
        col = batch.column(1)
        if col.null_count:
            col = col.fill_null("")
        if not len(col):
            continue
        wide = pa.types.is_large_string(col.type)
        _, offsets, data = col.buffers()
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        for i in range(1, len(col) + 1):
            if i == len(col) or ends[i + 1] - ends[start] > most:
                yield Block(batch.column(0).slice(start, i - start), raw[ends[start] : ends[i]], ends[start : i + 1] - ends[start])
                start = i


def _power(name: str, base: U, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, U)
        have[0] = 1
        _powers[name] = have = np.cumprod(have, dtype=U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, inverse): (total[j] - total[i]) * inverse[i] is the same for equal bytes raw[i:j] anywhere."""
    n = len(raw)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_CODE[raw] * _power("base", _BASE, n), out=total[1:])
    return total, _power("inverse", _INVERSE, n + 1)


def word_hashes(block: Block, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and where each text's words end among them, after a leading 0."""
    raw = block.raw
    n = len(raw)
    if not n:
        return np.zeros(0, U), np.zeros(len(block.ends), np.int64)
    inside = ~_space[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    text_starts = block.ends[:-1][block.ends[:-1] < n]
    first[text_starts] = inside[text_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    text_lasts = block.ends[1:][block.ends[1:] > 0] - 1
    last[text_lasts] = inside[text_lasts]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = _CODE[_lower[raw]] if lower else _CODE[raw]
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(codes * _power("base", _BASE, n), out=total[1:])
    hashes = mix((total[stops] - total[starts]) * _power("inverse", _INVERSE, n)[starts] + (stops - starts).astype(U))
    return hashes, np.searchsorted(starts, block.ends)


def shingle_sets(block: Block, width: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word windows; a shorter text is one window, none without words."""
    words, ends = word_hashes(block)
    if len(words) >= width:
        windows = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            windows = mix(windows * U(0x9E3779B97F4A7C15)) + words[k : len(words) - width + 1 + k]
        windows = mix(windows)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            h = U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = mix(np.array([h * U(0x9E3779B97F4A7C15) + w]))[0]
            yield np.array([h], U)
        else:
            yield np.zeros(0, U)
