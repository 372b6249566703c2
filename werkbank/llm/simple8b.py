"""Simple-8b: whole numbers packed in 64-bit words, in blocks that decode on their own.

A word holds a selector in its upper 4 bits and, in the other 60, a number of values of one width.
Values of 60 ones or more are escapes: their word holds 60 ones and they follow in a list of their
own. Every block of ``BLOCK`` values begins a new word, and a table gives its first word."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 1024
#: How many values of how many bits a word holds, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
FULL = np.uint64((1 << 60) - 1)
PAD = int(COUNTS.max())


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and the escapes in order, all as unsigned numbers.

    The widest value among the next 1, 2, 3, ... 240 is found for all positions at once; each
    position then knows the word that holds most values, and all blocks step from word to word
    side by side. Past a block's end there are zeros, which the decoder cuts off."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    grid = np.zeros((blocks, BLOCK + PAD), np.uint64)
    whole = len(values) // BLOCK
    grid[:whole, :BLOCK] = values[:whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        grid[whole, :len(values) - whole * BLOCK] = values[whole * BLOCK:]
    flat = grid.ravel()
    escapes = values[values >= FULL]
    flat[flat >= FULL] = FULL
    # The exponent of a floating-point number is its width; where rounding carries, it is one too wide at most.
    exponent = (flat.astype(np.float64).view(np.int64) >> 52) - 1022
    width = np.clip(exponent, 0, 60).astype(np.uint8)
    widest, best, span = {1: width}, np.full(len(flat), len(COUNTS) - 1, np.uint8), 1
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = int(COUNTS[selector])
        half = max(c for c in widest if 2 * c >= count) if span * 2 >= count else span
        ahead = count - half
        run = widest[half].copy()
        run[:len(run) - ahead] = np.maximum(run[:len(run) - ahead], widest[half][ahead:])
        widest[count], span = run, count
        best[run <= WIDTHS[selector]] = selector
    step, first = COUNTS[best], np.zeros(len(flat), bool)
    ends = np.arange(blocks) * (BLOCK + PAD) + np.minimum(BLOCK, len(values) - np.arange(blocks) * BLOCK)
    at = np.arange(blocks) * (BLOCK + PAD)
    while len(at):
        first[at] = True
        at = at + step[at]
        going = at < ends
        at, ends = at[going], ends[going]
    places = np.flatnonzero(first)
    kind = best[places]
    words = kind.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(kind).tolist():
        if WIDTHS[selector]:
            here = np.flatnonzero(kind == selector)
            shifts = (np.arange(COUNTS[selector]) * WIDTHS[selector]).astype(np.uint64)
            taken = flat[places[here][:, None] + np.arange(COUNTS[selector])]
            words[here] |= np.bitwise_or.reduce(taken << shifts, axis=1)
    starts = np.searchsorted(places, np.arange(blocks) * (BLOCK + PAD))
    return words, starts.astype(np.uint32), escapes


def decode(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` values. The words of one selector are unpacked together."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[kind]
    before = np.cumsum(counts) - counts
    starts = starts.astype(np.int64)
    block = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(words)]))
    places = before - before[starts][block] + block * (BLOCK + PAD) if len(words) else before
    flat = np.zeros(len(starts) * (BLOCK + PAD), np.uint64)
    for selector in np.unique(kind).tolist():
        if WIDTHS[selector]:
            here = np.flatnonzero(kind == selector)
            shifts = (np.arange(COUNTS[selector]) * WIDTHS[selector]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            flat[places[here][:, None] + np.arange(COUNTS[selector])] = (words[here][:, None] >> shifts) & mask
    values = flat.reshape(-1, BLOCK + PAD)[:, :BLOCK].ravel()[:length]
    if len(escapes):
        values[values == FULL] = escapes
    return values
