"""Weighted acyclic automata over word symbols: counts of phrases of up to three words.

An arc carries a symbol (an unsigned 64-bit number) and the count of the phrase that ends with it,
0 if that phrase is only the beginning of others. States with the same arcs (symbols, counts and
targets) are one, found from the last words upwards, so a phrase's count is the count on the last
arc of its path. Everything is built from sorted phrases and kept in flat arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from quarterdeck.llm.textbytes import mix

DEPTH = 3
_KINDS = (np.uint8, np.uint16, np.uint32, np.uint64)
#: Phrases of one length: a column of symbols for each word, and their counts.
Table = tuple[list[np.ndarray], np.ndarray]


def _packed(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in _KINDS if top <= np.iinfo(k).max))


def _runs(columns: Sequence[np.ndarray]) -> np.ndarray:
    """First rows of runs of equal rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(columns: list[np.ndarray], counts: np.ndarray) -> Table:
    """Phrases sorted and counted once."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = _runs(columns)
    total = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[first] for c in columns], total


def empty_table(size: int) -> Table:
    return [np.zeros(0, np.uint64) for _ in range(size)], np.zeros(0, np.int64)


class CountAutomaton:
    """``levels[d]``: (state offsets, symbols, counts, target states) of the arcs that read word d + 1."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, tables: Sequence[Table]) -> CountAutomaton:
        """From sorted distinct phrases of 1, 2 and 3 words."""
        levels, prefixes, states = [], None, None
        for size in range(DEPTH, 0, -1):
            columns, counts = tables[size - 1]
            targets = np.full(len(counts), -1, np.int64)
            if prefixes is not None and len(prefixes[0]):
                # Beginnings of longer phrases are arcs too, with count 0 where they are no phrase themselves.
                joined = [np.concatenate(pair) for pair in zip(columns, prefixes, strict=True)]
                order = np.lexsort(joined[::-1])
                joined = [c[order] for c in joined]
                first = _runs(joined)
                counts = np.add.reduceat(np.concatenate((counts, np.zeros(len(states), np.int64)))[order], first)
                targets = np.maximum.reduceat(np.concatenate((targets, states))[order], first)
                columns = [c[first] for c in joined]
            starts = _runs(columns[:-1]) if size > 1 else np.zeros(min(len(counts), 1), np.int64)
            offsets = np.append(starts, len(counts))
            states, kept = _merged(offsets, columns[-1], counts, targets)
            lengths = np.diff(offsets)[kept]
            arcs = np.repeat(offsets[kept] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            levels.append((np.concatenate(([0], np.cumsum(lengths))), columns[-1][arcs], counts[arcs], targets[arcs]))
            prefixes = [c[starts] for c in columns[:-1]]
        return cls(levels[::-1])

    def tables(self) -> list[Table]:
        """All phrases with a count, sorted, by length."""
        out, paths, state = [], [], np.zeros(1, np.int64)
        for offsets, symbols, counts, targets in self.levels:
            if len(offsets) == 1:
                out.append(empty_table(len(out) + 1))
                state = state[:0]
                paths = [p[:0] for p in paths] + [np.zeros(0, np.uint64)]
                continue
            lengths = offsets[state + 1] - offsets[state]
            arcs = np.repeat(offsets[state] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            paths = [np.repeat(p, lengths) for p in paths] + [symbols[arcs]]
            counted = counts[arcs] > 0
            out.append(([p[counted] for p in paths], counts[arcs][counted]))
            further = targets[arcs] >= 0
            paths, state = [p[further] for p in paths], targets[arcs][further]
        return out

    def compose(self, parts: Sequence[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """Counts of the asked phrases (columns of symbols; ``sizes`` words of each are read), 0 if unknown."""
        found, state = np.zeros(len(sizes), np.int64), np.where(sizes > 0, 0, -1)
        for d, (offsets, symbols, counts, targets) in enumerate(self.levels[: len(parts)]):
            at = np.flatnonzero((state >= 0) & (sizes > d))
            if not len(at) or not len(symbols):
                break
            low, high, word = offsets[state[at]].copy(), offsets[state[at] + 1].copy(), parts[d][at]
            end = high.copy()
            while (open_ := low < high).any():
                middle = (low + high) // 2
                less = open_ & (symbols[np.minimum(middle, len(symbols) - 1)] < word)
                low = np.where(less, middle + 1, low)
                high = np.where(open_ & ~less, middle, high)
            hit = low < end
            hit[hit] = symbols[low[hit]] == word[hit]
            last = hit & (sizes[at] == d + 1)
            found[at[last]] = counts[low[last]]
            state[at] = -1
            state[at[hit]] = targets[low[hit]]
        return found

    def to_bytes(self) -> bytes:
        pieces = []
        for offsets, symbols, counts, targets in self.levels:
            for values in (_packed(np.diff(offsets)), symbols.astype(np.uint64), _packed(counts), _packed(targets + 1)):
                pieces.append(np.array([len(values), values.itemsize], np.int64).tobytes())
                pieces.append(values.tobytes())
        return b"".join(pieces)

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountAutomaton:
        at, levels = 0, []
        for _ in range(DEPTH):
            arrays = []
            for _ in range(4):
                n, width = np.frombuffer(raw, np.int64, 2, at)
                arrays.append(np.frombuffer(raw, _KINDS[int(width).bit_length() - 1], n, at + 16))
                at += 16 + int(n * width)
            lengths, symbols, counts, targets = arrays
            levels.append((
                np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), symbols, counts.astype(np.int64),
                targets.astype(np.int64) - 1,
            ))
        return cls(levels)

    @classmethod
    def union(cls, automata: Sequence[CountAutomaton]) -> CountAutomaton:
        """The automaton of all phrases, counts of equal ones summed."""
        if len(automata) == 1:
            return automata[0]
        all_tables = [a.tables() for a in automata]
        merged = []
        for size in range(DEPTH):
            columns = [np.concatenate([t[size][0][c] for t in all_tables]) for c in range(size + 1)]
            merged.append(summed(columns, np.concatenate([t[size][1] for t in all_tables])))
        return cls.build(merged)

    def pruned(self, least: int) -> CountAutomaton:
        """Without phrases that are rarer."""
        return CountAutomaton.build([
            ([c[counts >= least] for c in columns], counts[counts >= least]) for columns, counts in self.tables()
        ])

    def arcs(self) -> int:
        return sum(len(level[1]) for level in self.levels)


def _merged(offsets: np.ndarray, symbols: np.ndarray, counts: np.ndarray, targets: np.ndarray):
    """(number of each state among the kept ones, kept states): states with the same arcs become one."""
    n = len(offsets) - 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(offsets)
    arcs = mix(symbols + mix(counts.astype(np.uint64) + mix(targets.astype(np.uint64) + np.uint64(1))))
    marks = mix(np.add.reduceat(arcs, offsets[:-1]) + lengths.astype(np.uint64))
    _, kept, number = np.unique(marks, return_index=True, return_inverse=True)
    # The mark only proposes; states are one if their arcs agree.
    model = kept[number]
    same = lengths == lengths[model]
    rows = np.repeat(same, lengths)
    own = np.arange(len(symbols))[rows]
    other = own + np.repeat(offsets[model] - offsets[:-1], lengths)[rows]
    differs = (symbols[own] != symbols[other]) | (counts[own] != counts[other]) | (targets[own] != targets[other])
    if differs.any() or not same.all():
        state = np.repeat(np.arange(n), lengths)[rows]
        alone = ~same
        alone[state[differs]] = True
        number = number.copy()
        number[alone] = len(kept) + np.arange(int(alone.sum()))
        kept = np.concatenate((kept, np.flatnonzero(alone)))
    return number, kept
