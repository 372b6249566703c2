"""Deep-shallow ordering of text suffixes by their first bytes, many buckets at a time.

Shallow: multikey quicksort over words of eight bytes, down to ``SHALLOW`` bytes. Deep: groups that
agree so far are ordered by blind tries, which look only at the bytes where their members part."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHALLOW = 32


def _bounds(labels: np.ndarray) -> np.ndarray:
    """Where runs of equal labels begin."""
    return np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]][:len(labels)])


def deep_shallow(data: np.ndarray, starts: np.ndarray, buckets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes that begin at ``starts`` in ``data`` by bucket and then by their first ``length``
    bytes. Returns the order and, for each place in it, a number that is equal where bucket and bytes are.

    ``data`` holds at least ``length`` bytes from each start on, and eight more at its end."""
    order = np.argsort(buckets, kind="stable")
    group = np.cumsum(np.r_[0, buckets[order][1:] != buckets[order][:-1]])[:len(order)]
    fresh = len(order)  # numbers that no group has yet
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    shallow = min(SHALLOW, length // 8 * 8)
    depth = np.zeros(len(order), np.int64)  # of the group at each place
    active, deep = _together(group, np.arange(len(order))), []
    while len(active):
        # One partition step of all groups: below, at and above the word of the group's middle member.
        labels = group[active]
        begin = _bounds(labels)
        sizes = np.diff(np.r_[begin, len(active)])
        word = words[starts[order[active]] + depth[active]]
        side = _against(word, np.repeat(word[begin + sizes // 2], sizes))
        turn = np.lexsort((side, labels))
        order[active], side, depth[active] = order[active][turn], side[turn], depth[active][turn] + 8 * (side[turn] == 1)
        parts = _bounds(labels * 3 + side)
        group[active] = fresh + np.repeat(np.arange(len(parts)), np.diff(np.r_[parts, len(active)]))
        fresh += len(parts)
        active = _together(group, active)
        done = depth[active] >= shallow
        deep.append(active[done])
        active = active[~done]
    active = np.sort(np.concatenate([np.empty(0, np.int64), *deep]))
    span = np.arange(shallow, length)
    while len(active):
        # One level of all blind tries: where do the members of a node part first, and by which byte?
        labels = np.cumsum(np.r_[0, group[active][1:] != group[active][:-1]])
        begin = _bounds(labels)
        sizes = np.diff(np.r_[begin, len(active)])
        at = starts[order[active]]
        split = np.full(len(active), len(span))
        for i in range(0, len(active), 65_536):
            own = data[at[i:i + 65_536, None] + span]
            heads = data[np.repeat(at[begin], sizes)[i:i + 65_536, None] + span]
            unlike = own != heads
            split[i:i + 65_536] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), len(span))
        branch = np.repeat(np.minimum.reduceat(split, begin), sizes)
        open_ = branch < len(span)  # the others are equal to the end
        active, labels, at, branch = active[open_], labels[open_], at[open_], branch[open_]
        byte = data[at + shallow + branch]
        turn = np.lexsort((byte, labels))
        order[active] = order[active][turn]
        parts = _bounds(labels * 256 + byte[turn])
        group[active] = fresh + np.repeat(np.arange(len(parts)), np.diff(np.r_[parts, len(active)]))
        fresh += len(parts)
        active = _together(group, active)
    return order, group


def _against(word: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return (word >= pivot).astype(np.int64) + (word > pivot)


def _together(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places whose group has more than one member."""
    labels = group[places]
    begin = _bounds(labels)
    sizes = np.diff(np.r_[begin, len(labels)])
    return places[np.repeat(sizes, sizes) > 1]
