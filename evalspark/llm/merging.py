"""Byte-pair merging of many sequences at once, over ragged numpy arrays.

A vocabulary of merges joins neighbouring symbols, best rank first and leftmost
among equals, until no pair can be joined. Here all sequences take their steps
together: in every round each sequence joins the pairs of its own best rank at
once. A sequence whose joins keep opening better pairs, such as a very long run
of blanks, takes its remaining steps one by one from a heap.
"""

from __future__ import annotations

import heapq

import numpy as np

NEVER = np.iinfo(np.int32).max
SLOT_BITS = 20
BATCH = 1 << 17  # symbols that take their steps together
PATIENCE = 64  # rounds that stop at an opening join before a sequence goes to the heap; the result is the same


class RankMerger:
    """The pairs ``left[i], right[i]`` join to ``whole[i]`` with rank ``rank[i]``; symbols are below ``size``."""

    def __init__(self, left, right, rank, whole, size: int):
        self.size = size
        keys = np.asarray(left, np.int64) * size + np.asarray(right, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.append(np.asarray(rank, np.int32)[order], np.int32(NEVER))
        self.wholes = np.append(np.asarray(whole, np.int32)[order], np.int32(0))
        self.places: dict[int, tuple[int, int]] = {}
        # places by hash; a place whose slot is taken goes to the next table
        self.wanted = np.append(self.keys, -1)
        self.tables, rest = [], np.arange(len(self.keys), dtype=np.int32)
        while len(rest):
            slots = self._slot(self.keys[rest], len(self.tables))
            table = np.full(1 << SLOT_BITS, len(self.keys), np.int32)
            table[slots[::-1]] = rest[::-1]
            self.tables.append(table)
            rest = rest[table[slots] != rest]

    @staticmethod
    def _slot(keys: np.ndarray, table: int) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * table & (1 << 64) - 1)) >> np.uint64(64 - SLOT_BITS)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table; the last place stands for pairs that do not join."""
        keys, none = left.astype(np.int64) * self.size + right, len(self.keys)
        found = self.tables[0][self._slot(keys, 0)]
        other = np.flatnonzero((self.wanted[found] != keys) & (found != none))
        for k, table in enumerate(self.tables[1:], 1):
            if not len(other):
                break
            found[other] = table[self._slot(keys[other], k)]
            other = other[(self.wanted[found[other]] != keys[other]) & (found[other] != none)]
        found[other] = none
        return found

    def merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all sequences, flat and in order, and the number of each.

        ``starts`` are the first places of the sequences in ``symbols``, none of
        them empty. They are taken in batches that fit the processor's caches.
        """
        edges = np.append(starts, len(symbols))
        cuts = np.unique(np.append(np.searchsorted(edges, np.arange(0, len(symbols), BATCH)), len(starts)))
        parts = [self._merged(symbols[edges[a]: edges[b]], starts[a:b] - edges[a]) for a, b in zip(cuts[:-1], cuts[1:])]
        if not parts:
            return symbols[:0], np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in parts]), np.concatenate([n for _, n in parts])

    def _merged(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(starts), np.int64)
        owner, done = np.arange(len(starts)), []
        symbols, opened = symbols.copy(), np.zeros(len(starts), np.int64)
        pairs = self._pairs(symbols, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        rows = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        while len(symbols):
            ranks = self.ranks[pairs]
            best = np.minimum.reduceat(ranks, starts)
            slow = opened > PATIENCE
            for k in np.flatnonzero(slow):
                rest = self.one_by_one(symbols[starts[k]: starts[k] + lengths[k]])
                done.append((owner[k: k + 1], rest))
                counts[owner[k]] = len(rest)
            live = (best < NEVER) & ~slow
            if not live.all():  # finished sequences leave
                ended = ~live & ~slow
                keep = live[rows]
                done.append((owner[ended], symbols[ended[rows]]))
                counts[owner[ended]] = lengths[ended]
                symbols, pairs, ranks = symbols[keep], pairs[keep], ranks[keep]
                rows = (np.cumsum(live, dtype=np.int32) - np.int32(1))[rows[keep]]
                lengths, owner, best, opened = lengths[live], owner[live], best[live], opened[live]
                if not len(symbols):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(ranks == best[rows])
            keep, stopped = self._step(symbols, pairs, starts, lengths, at, rows[at], best)
            symbols, pairs, rows = symbols[keep], pairs[keep], rows[keep]
            lengths = np.bincount(rows, minlength=len(starts))
            starts = np.cumsum(lengths) - lengths
            opened[stopped] += 1
        begin = np.cumsum(counts) - counts
        owners = np.concatenate([o for o, _ in done])
        sizes = counts[owners]
        out = np.empty(int(counts.sum()), np.int32)
        place = np.repeat(begin[owners] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(out))
        out[place] = np.concatenate([s for _, s in done])
        return out, counts

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The surviving symbols of one sequence, joined pair by pair in the order of rank and place."""
        if not self.places:
            self.places = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.wholes.tolist())))
        at = symbols.tolist()
        following, preceding = [*range(1, len(at)), -1], [*range(-1, len(at) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            found = self.places.get(at[a] * self.size + at[b])
            if found:
                heapq.heappush(heap, (found[0], a, at[a], at[b], found[1]))

        for k in range(len(at) - 1):
            offer(k, k + 1)
        while heap:
            _, a, left, right, whole = heapq.heappop(heap)
            b = following[a]
            if at[a] != left or b < 0 or at[b] != right:
                continue  # one of the two has been joined since
            at[a], at[b] = whole, -1
            following[a] = following[b]
            if following[b] >= 0:
                preceding[following[b]] = a
            if preceding[a] >= 0:
                offer(preceding[a], a)
            if following[a] >= 0:
                offer(a, following[a])
        return np.array([k for k in at if k >= 0], np.int32)

    def _pairs(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For every symbol the place of the pair that it begins; the last symbol of a sequence begins none."""
        pairs = np.full(len(symbols), len(self.keys), np.int32)
        if len(symbols) > 1:
            pairs[:-1] = self.join(symbols[:-1], symbols[1:])
            pairs[starts[1:] - 1] = len(self.keys)
        return pairs

    def _step(self, symbols, pairs, starts, lengths, at, row, best):
        """Join the best pairs of every sequence, from the left up to the first join that opens a better pair.

        ``at`` are the places of the best pairs and ``row`` their sequences. Returns
        which symbols stay, and the sequences that stopped at an opening join.

        Up to there one after the other gives the same as all at once: pairs that
        overlap go to the left one, and no join changes which pair is best.
        """
        none, last = len(self.keys), len(symbols) - 1
        # of overlapping pairs every second one counts, from the left; a sequence's last symbol begins no pair
        fresh = np.ones(len(at), bool)
        fresh[1:] = at[1:] != at[:-1] + 1
        run = np.flatnonzero(fresh)
        odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, row = at[odd], row[odd]
        whole = self.wholes[pairs[at]]
        ends = starts + lengths
        # the neighbours as they are when this pair's turn comes: left ones joined already, right ones not
        has_left, has_right = at > starts[row], at + 2 < ends[row]
        left = symbols[np.maximum(at - 1, 0)]
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] == at[:-1] + 2
        chained &= has_left
        left[chained] = whole[np.flatnonzero(chained) - 1]
        before = np.where(has_left, self.join(left, whole), none)
        after = np.where(has_right, self.join(whole, symbols[np.minimum(at + 2, last)]), none)
        opens = np.minimum(self.ranks[before], self.ranks[after]) <= best[row]
        # of every sequence: the joins before the first opening one, and that one
        earlier = np.cumsum(opens) - opens
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        take = earlier == np.repeat(earlier[first], np.diff(np.append(first, len(at))))
        stopped = row[take & opens]
        at, row, whole, before, after = at[take], row[take], whole[take], before[take], after[take]
        symbols[at] = whole
        pairs[at] = after
        left_open = at > starts[row]
        pairs[at[left_open] - 1] = before[left_open]
        # two joins side by side: the pair between them is that of the joined symbols
        beside = np.flatnonzero((at[1:] == at[:-1] + 2) & (row[1:] == row[:-1]))
        pairs[at[beside]] = before[beside + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        return keep, stopped
