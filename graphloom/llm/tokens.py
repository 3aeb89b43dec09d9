"""Whole-batch tokenising of Arrow text columns with numpy: no Python loop runs over documents or words.

A token is a maximal run of non-space bytes (ASCII white space separates), except that every character of
the scripts written without spaces (three-byte code points from U+3000 on, and four-byte ones) is a token of
its own. Tokens are known by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is a slice of its own, never cut.
SLICE = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Slice:
    """Some documents of a batch. Offsets count within ``buf``; ``doc`` is the document of each token."""

    first: int
    offsets: np.ndarray
    buf: np.ndarray
    space: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def token_offsets(self) -> np.ndarray:
        """Where each document's tokens begin among the slice's, and the end."""
        return np.searchsorted(self.starts, self.offsets)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)


def _run(step: int, n: int) -> np.ndarray:
    """Powers 0 to n of an odd number modulo 2^64."""
    out = np.full(n + 1, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_known = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; those that a slice needs are kept."""
    global _known
    if n > SLICE:
        return _run(_STEP, n), _run(_UNSTEP, n)
    if not len(_known[0]):
        _known = _run(_STEP, SLICE), _run(_UNSTEP, SLICE)
    return _known


def tokenise(buf: np.ndarray, offsets: np.ndarray, first: int = 0) -> Slice:
    space = _SPACE[buf]
    fresh = np.empty(len(buf), bool)
    fresh[1:] = space[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(buf)]] = True
    start = fresh & ~space
    if len(buf) and buf.max() >= 0xE3:
        follow = (buf & 0xC0) == 0x80
        lead = np.maximum.accumulate(np.where(follow, 0, np.arange(len(buf))))
        alone = ((buf >= 0xE3) & (buf < 0xEE) | (buf >= 0xEF))[lead] & ~space
        after = np.zeros(len(buf), bool)
        after[1:] = alone[:-1]
        start |= ~space & ~follow & (alone | after)
    starts = np.flatnonzero(start)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Slice(first, offsets, buf, space, none, none, none, np.zeros(0, np.uint64))
    last = ~space
    last[:-1] &= space[1:] | start[1:]
    ends = np.flatnonzero(last) + 1
    # a token's hash is a sum over its bytes of value times base to the place in the token: a difference of running sums
    # over places in the slice, shifted back
    up, down = _powers(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return Slice(first, offsets, buf, space, starts, ends, doc, hashes)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """The batch in slices of whole documents of about ``size`` bytes."""
    data, off = raw(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield tokenise(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def binary_rows(flat: np.ndarray, sizes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column over one array: row k holds the next sizes[k] items; NULL where it isn't valid."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    kind, width = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
    out = pa.Array.from_buffers(kind, len(sizes), [mask, pa.py_buffer(ends.astype(width).tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
    return out


def flat_rows(column: pa.Array, dtype=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(items, ends) of a binary column without NULLs: row k holds items[ends[k]:ends[k + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    items = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype)
    return items, (ends - ends[0]) // np.dtype(dtype).itemsize
