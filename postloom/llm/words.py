"""Words of whole texts as 64-bit hashes, vectorised over a batch of rows.

A word is `[^\\x20\\x09-\\x0D]+`; A-Z are lower-cased. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[np.arange(65, 91)] = _BYTE[np.arange(97, 123)]
_BYTE[SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SHINGLE = 5
AT_ONCE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None], space: np.ndarray = SPACE, heads: tuple[int, ...] = ()):
    """(hash of every word in order, number of words of every text); bytes of `space` separate words.

    With `heads`, a third item has the hashes of each word's first so many bytes, one array per head.
    """
    none = np.zeros(0, np.uint64)
    runs = list(chunks(texts, AT_ONCE))
    if len(runs) > 1:  # some sixty bytes of work space a character
        found = [word_hashes(texts[a:b], space, heads) for a, b in runs]
        words, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return (words, counts, [np.concatenate(h) for h in zip(*(f[2] for f in found))]) if heads else (words, counts)
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not parts:
        return (none, np.zeros(0, np.int64), [none] * len(heads)) if heads else (none, np.zeros(0, np.int64))
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    gap = space[raw]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(p) + 1 for p in parts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return (none, counts, [none] * len(heads)) if heads else (none, counts)
    gaps = np.diff(np.append(starts, len(raw)))
    offset = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
    power = np.cumprod(np.full(max(int(gaps.max()), *heads, 0) + 1, _STEP, np.uint64))
    values = np.where(gap[starts[0]:], np.uint64(0), _BYTE[raw[starts[0]:]] * power[offset])
    words = mix(np.add.reduceat(values, starts - starts[0]))
    if not heads:
        return words, counts
    # the head of a word is marked, so that it is not taken for a word of its own
    size = np.minimum(ends_of(gap, starts) - starts, max(heads))
    total, cut = np.zeros(len(starts), np.uint64), {}
    for k in range(max(heads)):
        inside = size > k
        total += np.where(inside, _BYTE[raw[np.where(inside, starts + k, 0)]] * power[k], np.uint64(0))
        cut[k + 1] = total.copy() if k + 1 in heads else None
    return words, counts, [mix(cut[h] + np.uint64(h)) for h in heads]


def ends_of(gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each word ends."""
    last = ~gap
    last[:-1] &= gap[1:]
    return np.flatnonzero(last) + 1


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's 5-word shingles.

    A text with fewer words has its whole sequence as the one shingle, a text without words none.
    """
    words, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    with np.errstate(over="ignore"):
        weighted = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            weighted += words[k:k + len(weighted)] * _PLACE[k]
        weighted = mix(weighted)
        sets = []
        for stop, n in zip(stops.tolist(), counts.tolist()):
            if n >= SHINGLE:
                sets.append(np.unique(weighted[stop - n:stop - SHINGLE + 1]))
            elif n:
                sets.append(mix((words[stop - n:stop] * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: a Python worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def released(function):
    """`function` over an iterator of batches, with `release` at the end of the partition."""

    def run(batches):
        yield from function(batches)
        release()

    return run


def released_group(function):
    """`function` of one group, with `release` once its own arrays are gone."""

    def run(*groups):
        out = function(*groups)
        release()
        return out

    run.__signature__ = inspect.signature(function)
    return run


def chunks(texts: list, size: int = 4_000_000):
    """(start, stop) of runs of rows whose texts together have about `size` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
