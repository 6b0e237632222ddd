"""A bounded cache from words to their token ids, looked up for many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordTable:
    """Ids of words in one flat array; ``encode`` is asked for unseen words only.

    ``encode`` gives the ids of all words end to end and how many each has.  The table
    holds at most about ``limit`` words; beyond that it starts anew, which costs time
    and changes nothing.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_100_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, words: list[str]) -> None:
        base = len(self.index)
        ids, sizes = self.encode(words)
        while len(self.starts) < base + len(words) + 1:
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        ends = self.used + np.cumsum(sizes)
        self.starts[base + 1 : base + 1 + len(words)] = ends
        total = int(ends[-1])
        while len(self.flat) < total:
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : total] = ids
        self.used = total
        self.index.update(zip(words, range(base, base + len(words)), strict=True))

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text) of texts given as word lists."""
        if len(self.index) > self.limit:
            self.clear()
        words = [w for t in texts for w in t]
        at = list(map(self.index.get, words))
        unseen = [k for k, i in enumerate(at) if i is None]
        if unseen:
            self._add(list(dict.fromkeys(words[k] for k in unseen)))
            for k in unseen:
                at[k] = self.index[words[k]]
        where = np.array(at, np.int64)
        lo, hi = self.starts[where], self.starts[where + 1]
        sizes = hi - lo
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.repeat(lo - ends + sizes, sizes) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.cumsum([0, *map(len, texts)])]
        return out, np.diff(cuts)
