"""Ragged arrays: texts as codes of their distinct words, and memos that hold an array for each word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between single spaces, each word's code in order, and where each text's words begin and end."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)


def gather(flat: np.ndarray, stops: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of the rows one after another, and their lengths. Row i is flat[stops[i]:stops[i + 1]]."""
    start = stops[rows]
    lens = stops[rows + 1] - start
    out = np.cumsum(lens)
    total = int(out[-1]) if len(out) else 0
    return flat[np.arange(total) + np.repeat(start - (out - lens), lens)], lens


class RaggedMemo:
    """An array for each word that was asked for, up to `most` words; emptied when full."""

    def __init__(self, most: int) -> None:
        self.most, self.index = most, {}
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.flat, self.stops, self.n, self.used = np.zeros(1 << 12, dtype="<u4"), np.zeros(1 << 10, dtype=np.int64), 0, 0

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        return self.flat, self.stops

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.flat, self.stops, rows)

    def _add(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        need, rows = self.used + len(flat), self.n + len(words) + 1
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, 2 * len(self.flat)) - self.used, dtype="<u4")])
        if rows > len(self.stops):
            self.stops = np.concatenate([self.stops[: self.n + 1], np.zeros(max(rows, 2 * len(self.stops)) - self.n - 1, dtype=np.int64)])
        self.flat[self.used : need] = flat
        self.stops[self.n + 1 : rows] = self.used + np.cumsum(lens)
        self.index.update(zip(words, range(self.n, self.n + len(words))))
        self.n, self.used = self.n + len(words), need

    def rows(self, words: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The row of each word. learn: gives the arrays of new words one after another, and their lengths."""
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if self.n + len(new) > self.most and self.n:
            self.clear()
            new = list(dict.fromkeys(words))
        if new:
            self._add(new, *learn(new))
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
