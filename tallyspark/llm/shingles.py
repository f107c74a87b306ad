"""Vectorised hashing of word shingles straight from Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FOLD = np.uint64(0xD6E8FEB86659FD93)
WORDS = 5
CHUNK = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_white = np.zeros(256, dtype=bool)
_white[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * FOLD
    h = h ^ (h >> np.uint64(29))
    h = h * BASE
    return h ^ (h >> np.uint64(32))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[name] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, split at ASCII white space) and the
    number of words per document.  Works through blocks of whole words."""
    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[offsets] = True
    out, where, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not (_white[data[end]] or breaks[end]):
            ahead = data[end:end + 4096]
            step = np.flatnonzero(_white[ahead] | breaks[end:end + len(ahead)])
            end += int(step[0]) if len(step) else len(ahead)
        block = data[at:end]
        inside = ~_white[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | breaks[at + 1:end]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | breaks[at + 1:end]
        s, t = np.flatnonzero(first), np.flatnonzero(last)
        total = np.cumsum((_lower[block].astype(np.uint64) + np.uint64(1)) * _power("up", BASE, len(block))[:len(block)])
        h = total[t]
        h[s > 0] -= total[s[s > 0] - 1]
        h *= _power("down", INVERSE, len(block))[s]
        out.append(mix(h + (t - s).astype(np.uint64) * FOLD))
        where.append(s + at)
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    edges = np.searchsorted(np.concatenate(where), offsets)
    return np.concatenate(out), np.diff(edges)


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each document; fewer
    words give the whole sequence as one shingle, no words the empty set."""
    runs = None
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        runs = words[:n].copy()
        for k in range(1, WORDS):
            runs *= BASE
            runs += words[k:k + n]
        runs = mix(runs)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            sets.append(np.unique(runs[at:at + n - WORDS + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[at:at + n]:
                    h = h * FOLD + w
            sets.append(mix(np.array([h], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def document_sets(column: pa.Array, block_bytes: int = 1 << 22):
    """Yield (first row, list of shingle sets) for runs of documents of about
    ``block_bytes`` of text, so that memory is bounded by one run or one document."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + block_bytes))
        end = min(n, max(at + 1, end))
        part = data[offsets[at]:offsets[end]]
        yield at, shingle_sets(*word_hashes(part, offsets[at:end + 1] - offsets[at]))
        at = end
