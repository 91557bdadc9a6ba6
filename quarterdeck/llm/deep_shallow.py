"""Deep-shallow order of byte strings of one length that start anywhere in a buffer.

Shallow: multikey quicksort with characters of eight bytes; all groups that agree so far are split
by their next character at once. Deep: what still agrees at the shallow depth goes into blind
tries. A trie keeps no strings, only the depth at which a string leaves the group's first one and
the character there; strings that leave at the same place with the same character form the next
group, and those that never leave are equal.
"""

from __future__ import annotations

import numpy as np

SHALLOW_BYTES = 32


def characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one big-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(7, np.uint8)))
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(data)]
    return out


def _at(words: np.ndarray, starts: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Character at ``depth`` of strings that end after ``length`` bytes."""
    found = words[starts + depth]
    spare = depth + 8 - length
    return found >> np.uint64(8 * spare) if spare > 0 else found


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and whether the group has further rows, from the first rows of groups."""
    number = np.cumsum(new) - 1
    return number, np.bincount(number, minlength=1)[number] > 1


def deep_shallow_order(
    data: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW_BYTES
) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the rows of ``starts`` in the order of their strings, and whether each equals the one before."""
    words, n = characters(data), len(starts)
    order, same = np.arange(n), np.zeros(n, bool)
    if not n:
        return order, same
    shallow = min(shallow - shallow % 8, length)
    slots, group = np.arange(n), np.zeros(n, np.int64)
    for depth in range(0, shallow, 8):
        key = _at(words, starts[order[slots]], depth, length)
        inside = np.lexsort((key, group))
        order[slots] = order[slots[inside]]
        key, group = key[inside], group[inside]
        new = np.ones(len(slots), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group, more = _groups(new)
        slots, group = slots[more], group[more]
        if not len(slots):
            return order, same
    _blind_tries(words, starts, length, shallow, order, same, slots, group)
    return order, same


def _blind_tries(words, starts, length, depth, order, same, slots, group) -> None:
    known = np.full(len(slots), depth, np.int64)  # bytes that the rows of a group are known to share
    while len(slots):
        first = np.ones(len(slots), bool)
        first[1:] = group[1:] != group[:-1]
        lead = starts[order[slots[np.flatnonzero(first)]]][np.cumsum(first) - 1]
        own = starts[order[slots]]
        leaves, char = np.full(len(slots), length, np.int64), np.zeros(len(slots), np.uint64)
        greater = np.zeros(len(slots), bool)
        open_ = np.flatnonzero(own != lead)
        for d in range(int(known.min()), length, 8):
            read = open_[known[open_] <= d]
            a, b = _at(words, own[read], d, length), _at(words, lead[read], d, length)
            differs = a != b
            at = read[differs]
            leaves[at], char[at], greater[at] = d, a[differs], a[differs] > b[differs]
            open_ = open_[leaves[open_] == length]
            if not len(open_):
                break
        # Smaller strings that leave earlier come first, greater ones that leave earlier come last.
        side = np.where(leaves == length, length, np.where(greater, 2 * length - leaves, leaves))
        inside = np.lexsort((char, side, group))
        order[slots] = order[slots[inside]]
        group, side, char, leaves, known = (x[inside] for x in (group, side, char, leaves, known))
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1]) | (char[1:] != char[:-1])
        equal = leaves == length
        same[slots[equal & ~new]] = True
        group, more = _groups(new)
        more &= ~equal
        slots, group, known = slots[more], group[more], leaves[more] + 8
