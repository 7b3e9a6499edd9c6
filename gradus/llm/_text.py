"""Word splitting and 64-bit hashing of whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
SLICE = 4 << 20  # bytes of the rows that a Python worker holds as its own objects at a time, about
_P = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}

_LOWER = {c: c + 32 for c in range(65, 91)}


def table(separators: set[int], lower: bool) -> bytes:
    """For ``bytes.translate``: every separator becomes a space."""
    fold = _LOWER if lower else {}
    return bytes(32 if c in separators else fold.get(c, c) for c in range(256))


SPACES = {0x20, *range(0x09, 0x0E)}
SPACED = table(SPACES, lower=False)
SPACED_LOWER = table(SPACES, lower=True)
ALNUM_LOWER = table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, CHUNK)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size <= 4 * CHUNK:
            _powers[name] = got
    return got


Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, size: int = SLICE) -> Batches:
    """The same rows in runs of about ``size`` bytes, without a copy; a single row is never divided."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def release() -> None:
    """Give back what this worker holds beside its imports: tables of powers, freed Arrow buffers, freed heap."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` for mapInArrow on ``slices``, and ``release`` when the task is done.

    Workers stay alive for a while after their task, beside those of the stages that follow; what they keep counts
    against the executor's memory as much as what is in use.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from work(slices(batches))
        finally:
            release()

    return run


class Words(NamedTuple):
    hash: np.ndarray  # uint64 of each word
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    doc: np.ndarray  # words of document d: doc[d]:doc[d + 1]


def buffers(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes and the offsets of the texts; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return memoryview(b""), np.zeros(len(texts) + 1, np.int64)
    return memoryview(data), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, last row + 1, bytes, offsets."""
    data, offsets = buffers(texts)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, bytes(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power("p", _P, n)[:n], out=total[1:])
    return mix((total[end] - total[start]) * _power("inverse", _P_INVERSE, n)[start])


def split_words(raw: bytes, offsets: np.ndarray, fold: bytes) -> Words:
    """Words of a chunk; ``fold`` is a ``table``. Equal folded words have equal hashes."""
    b = np.frombuffer(raw.translate(fold), np.uint8)
    n = len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    word = b != 32
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if n <= 2 * CHUNK:
        hashes = _hashes(b, start, end)
    else:  # a very long text: in pieces that end between words
        hashes, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, "right")))
            base = start[at]
            hashes[at:to] = _hashes(b[base : end[to - 1]], start[at:to] - base, end[at:to] - base)
            at = to
    return Words(hashes, start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; run i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.random.default_rng(seed).integers(1, 1 << 63, width, dtype=np.uint64) | U(1)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * factor[k]
    return mix(total)
