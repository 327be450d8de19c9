"""Vectorised text primitives on Arrow buffers: byte classes, words, hashes, shingles.

All functions work on one buffer that holds many texts; a text's bytes are
``data[offsets[i]:offsets[i + 1]]``. Nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPLIT_BYTES = 2 << 20
MOST_ROWS = 8192

_LIBC: list = []


def _libc():
    """The C library, asked once to take large blocks from the system one by one; None if it can't."""
    if not _LIBC:
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: freed blocks of that size go back at once
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD: smaller ones are used again until a task ends
            pa.set_memory_pool(pa.system_memory_pool())
            _LIBC.append(libc)
        except (AttributeError, OSError):
            _LIBC.append(None)
    return _LIBC[0]


#: what a worker process keeps from task to task, by operator, and how it is let go
KEPT: dict[str, Callable[[], None]] = {}


def let_go(keeps: str = "") -> None:
    """Let go of what other operators than ``keeps`` have kept in this process.

    A function of the module: in a pickled closure ``KEPT`` would be a copy, without what the worker has kept.
    """
    others = [k for k in KEPT if k != keeps]
    for owner in others:
        KEPT.pop(owner)()
    if others:
        gc.collect()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker process that gives its freed memory back: workers are used again and again,
    by one operator after another, and would otherwise hold the peak of each. What other
    operators than ``keeps`` have kept in the process goes first.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            if libc is not None:
                gc.collect()
                libc.malloc_trim(0)

    return wrapped


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: words [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[9:14] = NOT_BLANK[32] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads a 64-bit hash over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: the bytes of a 64-bit load that belong to a span of so many bytes
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SPLIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` bytes of text and ``MOST_ROWS`` at most, so that memory doesn't follow the batch size."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = min(i + MOST_ROWS, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends in ``data``, and the first word of each text (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mark = member[data]
    before = np.zeros(n, bool)
    before[1:] = mark[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mark[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(mark & ~before)
    ends = np.flatnonzero(mark & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _load(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of a buffer of 64-bit numbers, as little-endian numbers."""
    shift = (at & 7).astype(np.uint64) << np.uint64(3)
    word = at >> 3
    out = packed[word] >> shift
    out |= packed[word + 1] << np.uint64(1) << (shift ^ np.uint64(63))
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER, seed: int = 0, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each span's folded bytes; each ``seed`` gives another one.

    Eight bytes at a time are taken as a number, mixed with their place and summed up: no two
    spans of up to eight bytes and the same length collide, and as the mixing isn't linear,
    patterns in longer ones don't cancel out. ``block`` bounds what is held for that at a time.
    """
    folded = data.tobytes().translate(fold.tobytes())
    packed = np.frombuffer(folded + bytes(24 - len(folded) % 8), "<u8")
    lens = ends - starts
    out = np.empty(len(starts), np.uint64)
    lead = mix(np.array([seed], np.uint64))
    for i in range(0, len(starts), block):
        s, n = starts[i : i + block], lens[i : i + block]
        out[i : i + block] = mix((_load(packed, s) & _MASK[np.minimum(n, 8)]) + n.astype(np.uint64) * _STEP + lead)
    long = np.flatnonzero(lens > 8)
    more = (lens[long] - 1) // 8
    last = np.cumsum(more)
    for lo in range(0, int(last[-1]) if len(long) else 0, block):  # the loads after each span's first
        nth = np.arange(lo, min(lo + block, int(last[-1])))
        owner = np.searchsorted(last, nth, side="right")
        place = nth - (last - more)[owner] + 1
        span = long[owner]
        piece = _load(packed, starts[span] + 8 * place) & _MASK[np.minimum(lens[span] - 8 * place, 8)]
        piece = mix(piece ^ mix(place.astype(np.uint64) * _STEP + lead))
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        out[span[begin]] += np.add.reduceat(piece, begin)
    out[long] = mix(out[long])
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index (ascending) of each run of ``width`` words; a shorter text is one run of all its words."""
    counts = np.diff(first)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = _powers(width + 1, np.uint64(0x2545F4914F6CDD1D))
    text_of = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(first[1:], counts)
    full = np.arange(n) + width <= last
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total[: max(0, n - k)] += hashes[k:] * step[k]
    got, owner = mix(total[full] + step[width]), text_of[full]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int(np.sum(hashes[first[i] : first[i + 1]] * step[: counts[i]], dtype=np.uint64)) for i in short], dtype=np.uint64)
        got = np.concatenate([got, mix(extra + mix(counts[short].astype(np.uint64)))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        got, owner = got[order], owner[order]
    return got, owner


def distinct_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by owner, then value; each value once for an owner. ``owner`` must be sorted."""
    values = values.copy()
    begin = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
    for a, b in zip(begin, [*begin[1:], len(values)], strict=False):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]


def bounds(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` owners begins in a sorted owner array; one entry more than owners."""
    return np.searchsorted(owner, np.arange(n + 1))
