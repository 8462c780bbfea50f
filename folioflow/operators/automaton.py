"""An automaton over bytes that finds all of many strings in all texts of a batch, as numpy arrays.

States are the distinct prefixes of the strings; their edges are a hash table of (state, byte), the failure link of a
state is its longest proper suffix that is a state too, and its output link the longest suffix that is a whole string.
Texts are cut into lanes of equal length that overlap by the longest string, and all lanes take a step together.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a lane besides its overlap; of the texts that are worked on at once.
LANE, TOGETHER = 2048, 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """strings: distinct and not empty. The arrays can be broadcast; their size is bounded by the strings' bytes."""

    def __init__(self, strings: list[bytes]):
        order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        size = np.array([len(strings[i]) for i in order], np.int64)
        self.longest = int(size.max(initial=0))
        flat = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        start = np.cumsum(size) - size
        state = np.zeros(len(order), np.int64)
        parents, letters, levels, n = [], [], [], 1
        ends = np.zeros(len(order), np.int64)
        for depth in range(self.longest):  # a level of the tree of prefixes; equal ones lie side by side
            alive = np.flatnonzero(size > depth)
            byte = flat[start[alive] + depth].astype(np.int64)
            new = np.append(True, (state[alive][1:] != state[alive][:-1]) | (byte[1:] != byte[:-1]))
            ids = n + np.cumsum(new) - 1
            parents.append(state[alive][new]), letters.append(byte[new]), levels.append(np.unique(ids))
            state[alive] = ids
            ends[alive[size[alive] == depth + 1]] = ids[size[alive] == depth + 1]
            n += int(new.sum())
        self.parent = np.concatenate([[0], *parents]).astype(np.int64)
        self.letter = np.concatenate([[0], *letters]).astype(np.int64)
        self._edges()
        self.string = np.full(n, -1, np.int64)
        self.string[ends] = order
        self.fail = np.zeros(n, np.int64)
        self.output = np.where(self.string >= 0, np.arange(n), 0)
        for level in levels[1:]:
            self.fail[level] = self.step(self.fail[self.parent[level]], self.letter[level])
            self.output[level] = np.where(self.string[level] >= 0, level, self.output[self.fail[level]])

    def _edges(self) -> None:
        """The hash table: places by open addressing, tried in rounds until every edge has one."""
        n = len(self.parent)
        self.bits = max(4, int(2 * n - 1).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left = np.arange(1, n)
        key = self.parent[left] << 8 | self.letter[left]
        place = self._place(key)
        while len(left):
            free = self.key[place] < 0
            self.key[place[free]] = key[free]  # of several for one place the last stays
            won = self.key[place] == key
            self.to[place[won]] = left[won]
            left, key, place = left[~won], key[~won], (place[~won] + 1) & (len(self.key) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _child(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state behind each edge, or 0."""
        key = state << 8 | byte
        place = self._place(key)
        out = np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        while len(left):
            held = self.key[place]
            same = held == key
            out[left[same]] = self.to[place[same]]
            go = (held >= 0) & ~same
            left, key, place = left[go], key[go], (place[go] + 1) & (len(self.key) - 1)
        return out

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out = self._child(state, byte)
        left = np.flatnonzero((out == 0) & (state > 0))
        own = state[left]
        while len(left):
            own = self.fail[own]
            out[left] = self._child(own, byte[left])
            go = (out[left] == 0) & (own > 0)
            left, own = left[go], own[go]
        return out

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text and string that is in it, in order."""
        found: list[np.ndarray] = []
        at, n = 0, len(self.string)
        while at < len(texts) and self.longest:
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size, end = size + len(texts[end]), end + 1
            found.append(self._run(texts[at:end]) + at * n)
            at = end
        text, state = np.divmod(np.concatenate([*found, np.zeros(0, np.int64)]), n)
        pairs = []
        while len(state):
            pairs.append(text * n + self.string[state])
            state = self.output[self.fail[state]]
            text, state = text[state > 0], state[state > 0]
        return np.divmod(np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)])), n)

    def _run(self, texts: list[bytes]) -> np.ndarray:
        """text * states + the output state, for all distinct ones."""
        n = len(self.string)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(sizes) - sizes)[text] + place * LANE
        length = np.minimum(sizes[text] - place * LANE, LANE + self.longest - 1)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        state, seen = np.zeros(len(text), np.int64), []
        for k in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -k, "left"))  # lanes that are longer than k
            state = self.step(state[:m], buf[begin[:m] + k].astype(np.int64))
            out = self.output[state]
            hit = np.flatnonzero(out)
            if len(hit):
                seen.append(text[hit] * n + out[hit])
            if len(seen) > 256:
                seen = [np.unique(np.concatenate(seen))]
        return np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]))
