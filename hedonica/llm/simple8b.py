"""Simple-8b: a varying number of ids in each 64-bit word, as its selector says.

The top four bits of a word select how many values it holds and in how many bits each; the
other 60 bits hold them, the first one lowest. Values come in blocks of 512: every block
starts a word, and its offset is stored, so that blocks are coded, decoded and skipped apart
from each other, many at a time. A value of more than 60 bits is an escape: its word holds
an index into a list of full 64-bit values.

Layout (little-endian): ``S8B1``, count of values (u64), blocks, words, escapes (u32 each);
first word of each block (u32); padding to eight bytes; words (u64); escapes (u64).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sQIII")
# Fixed values of the format, by selector: values in a word, bits of each. 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
ESCAPE, ZEROS = 0, 15
SPARE = int(COUNTS.max())  # room for what the last word of a block holds beyond its end
LIMITS = np.uint64(1) << np.array([0, *BITS[1:15]], dtype=np.uint64)
# Selectors from the fewest values to the most: where one fits, all before it do.
BY_COUNT = np.array([ESCAPE, *range(14, 0, -1), ZEROS], dtype=np.uint8)
# The least selector that is wide enough (0 for zeros, 15 for escapes), of small values.
SMALL = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Values below 2**64 in the layout above."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + SPARE), dtype=np.uint64)
    ends = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    whole = n // BLOCK
    grid[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    selectors = _selectors(grid)
    row, start = _walk(selectors, ends)
    chosen = selectors[row, start]

    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, ZEROS):
        at = np.flatnonzero(chosen == s)
        if len(at):
            held = np.arange(COUNTS[s])
            parts = grid[row[at, None], start[at, None] + held]
            parts <<= (held * BITS[s]).astype(np.uint64)
            words[at] |= np.bitwise_or.reduce(parts, axis=1)
    at = np.flatnonzero(chosen == ESCAPE)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    escapes = grid[row[at], start[at]]

    offsets = np.searchsorted(row, np.arange(blocks)).astype("<u4")
    head = HEADER.pack(MAGIC, n, blocks, len(words), len(escapes)) + offsets.tobytes()
    head += bytes(-len(head) % 8)
    return head + words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes()


def _selectors(grid: np.ndarray) -> np.ndarray:
    """For every position: the selector that packs most of the values from there on."""
    if grid.max(initial=0) < len(SMALL):
        widest = SMALL[grid.astype(np.uint16)]
    else:
        widest = np.searchsorted(LIMITS, grid, side="right").astype(np.uint8)
    fitting = np.zeros((len(grid), BLOCK), dtype=np.uint8)
    held = 1  # widest[i] is the widest of so many values from i on
    for s in BY_COUNT[1:].tolist():
        more = int(COUNTS[s]) - held
        if more:
            widest = np.maximum(widest[:, :-more], widest[:, more:])
            held += more
        fits = widest[:, :BLOCK] <= (0 if s == ZEROS else s)
        if not fits.any():
            break
        fitting += fits
    return BY_COUNT[fitting]


def _walk(selectors: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block and start of every word, in order; all blocks take a step at a time."""
    rows, starts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    row = np.arange(len(selectors))
    at = np.zeros(len(selectors), dtype=np.int64)
    while len(row):
        rows.append(row)
        starts.append(at)
        at = at + COUNTS[selectors[row, at]]
        more = at < ends[row]
        row, at = row[more], at[more]
    row, start = np.concatenate(rows), np.concatenate(starts)
    order = np.argsort(row, kind="stable")
    return row[order], start[order]


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """All values, or those of the blocks ``first`` to ``last`` (exclusive)."""
    magic, n, blocks, n_words, n_escapes = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not Simple-8b data")
    at = HEADER.size + 4 * blocks
    offsets = np.append(np.frombuffer(data, "<u4", blocks, HEADER.size), n_words)
    at += -at % 8
    words = np.frombuffer(data, "<u8", n_words, at)
    escapes = np.frombuffer(data, "<u8", n_escapes, at + 8 * n_words)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, dtype=np.uint64)
    words, offsets = words[offsets[first] : offsets[last]], offsets[first : last + 1]

    chosen = (words >> np.uint64(60)).astype(np.uint8)
    per_block = np.diff(offsets.astype(np.int64))
    row = np.repeat(np.arange(last - first), per_block)
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    start = before - np.repeat(before[offsets[:-1] - offsets[0]], per_block)
    grid = np.zeros((last - first, BLOCK + SPARE), dtype=np.uint64)
    for s in range(1, ZEROS):
        at = np.flatnonzero(chosen == s)
        if len(at):
            held = np.arange(COUNTS[s])
            parts = words[at, None] >> (held * BITS[s]).astype(np.uint64)
            parts &= np.uint64((1 << int(BITS[s])) - 1)
            grid[row[at, None], start[at, None] + held] = parts
    at = np.flatnonzero(chosen == ESCAPE)
    grid[row[at], start[at]] = escapes[words[at] & np.uint64((1 << 60) - 1)]
    return grid[:, :BLOCK].ravel()[: n - first * BLOCK]
