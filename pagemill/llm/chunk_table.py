"""A table of distinct chunks and their token ids, probed for whole batches at once.

A text is cut only where no token can reach across, so that each chunk can be segmented by itself.
Each distinct chunk is segmented once by the tokenizer library; all its occurrences get their ids
by position from the table. Keys are two independent 64-bit hashes of the chunk's bytes. The table
lives in the Python worker, which serves many tasks. When it is full, only chunks that were met again
since stay (none, if these are many), so its memory has a bound that doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pagemill.llm.common import span_hashes_2

#: Distinct chunks that a table holds before it lets go of those met once.
CAPACITY = 1 << 19


class ChunkTable:
    def __init__(self, cuts: Callable[[np.ndarray], np.ndarray], segment: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], capacity: int = CAPACITY):
        """cuts: positions in a byte array where a chunk may start. segment: ids of all
        chunks in order, and their number for each; its second argument says which chunks start
        their text."""
        self.cuts, self.segment, self.capacity = cuts, segment, capacity
        self._clear()

    def _clear(self, slots: int = 1 << 16) -> None:
        self.key, self.check = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.at, self.n = np.zeros(slots, np.int64), np.zeros(slots, np.int32)
        self.again = np.zeros(slots, bool)
        self.pool, self.used, self.count = np.zeros(1 << 18, np.uint32), 0, 0

    def _thin(self) -> None:
        """Keeps the chunks met again, if they leave room for as many others."""
        own = np.flatnonzero(self.again & (self.key != 0))
        key, check, at, n, pool = self.key[own], self.check[own], self.at[own], self.n[own], self.pool
        self._clear(len(self.key))
        if 2 * len(own) > self.capacity:
            return
        total = int(n.sum())
        first = np.cumsum(n) - n
        self.pool = np.zeros(max(total, len(self.pool)), np.uint32)
        self.pool[:total] = pool[np.arange(total) + np.repeat(at - first, n)]
        self.used = total
        self._put(key, check, first.astype(np.int64), n)

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = len(self.key) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            k = self.key[slot]
            hit = (k == key[left]) & (self.check[slot] == check[left])
            out[left[hit]] = slot[hit]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & mask
        return out

    def _put(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Adds distinct keys that the table doesn't hold."""
        while (self.count + len(key)) * 2 > len(self.key):
            old = self.key, self.check, self.at, self.n, self.again
            self.key, self.check = np.zeros(len(old[0]) * 2, np.uint64), np.zeros(len(old[0]) * 2, np.uint64)
            self.at, self.n = np.zeros(len(self.key), np.int64), np.zeros(len(self.key), np.int32)
            self.again = np.zeros(len(self.key), bool)
            own = np.flatnonzero(old[0])
            self._place(*(x[own] for x in old[:4]))
            met = own[old[4][own]]
            self.again[self._find(old[0][met], old[1][met])] = True
        self._place(key, check, at, n)
        self.count += len(key)

    def _place(self, key, check, at, n) -> None:
        mask = len(self.key) - 1
        slot = (key & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = self.key[slot] == 0
            s, who = slot[free], left[free]
            self.key[s], self.check[s], self.at[s], self.n[s] = key[who], check[who], at[who], n[who]
            won = np.zeros(len(left), bool)
            won[free] = (self.key[s] == key[who]) & (self.check[s] == check[who])
            left, slot = left[~won], (slot[~won] + 1) & mask

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's offsets among them."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        first = np.zeros(len(buf) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        starts = np.flatnonzero(self.cuts(buf) | first)
        lens = np.diff(starts, append=len(buf))
        opening = first[starts]
        key, check = span_hashes_2(buf, starts, lens)
        check ^= opening.astype(np.uint64)
        key += opening.astype(np.uint64)
        key[key == 0] = 1
        slot = self._find(key, check)
        miss = np.flatnonzero(slot < 0)
        if len(miss) and self.count and self.count + len(np.unique(key[miss])) > self.capacity:
            self._thin()
            miss = np.arange(len(key))
            slot = self._find(key, check)
            miss = np.flatnonzero(slot < 0)
        else:
            self.again[slot[slot >= 0]] = True
        data = buf.tobytes() if len(miss) else b""
        while len(miss):  # again only if two chunks share a key but not the second hash
            _, one = np.unique(key[miss], return_index=True)
            one, slots = miss[one], len(self.key)
            ids, n = self.segment([data[s : s + n] for s, n in zip(starts[one].tolist(), lens[one].tolist())], opening[one])
            total = len(ids)
            if self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
            self.pool[self.used : self.used + total] = ids
            self._put(key[one], check[one], self.used + np.cumsum(n) - n, n)
            self.used += total
            if slots != len(self.key):  # it has grown, and every chunk has another slot
                miss = np.arange(len(key))
            slot[miss] = self._find(key[miss], check[miss])
            miss = miss[slot[miss] < 0]
        n = self.n[slot].astype(np.int64)
        ends = np.cumsum(n)
        out = self.pool[np.arange(int(ends[-1])) + np.repeat(self.at[slot] - (ends - n), n)]
        text_of = np.searchsorted(starts, offsets, "left")  # chunks before each text
        return out, np.concatenate([[0], ends])[text_of]
