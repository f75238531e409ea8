"""What the tokenizers' operators share: a table of words and their ids, and slices of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of texts that are split at a time (one text at least)
BATCH = 8 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of runs of items laid end to end, and where each run begins and the last one ends."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1]), upto


class IdTable:
    """Ids of words, one after the other; `learn` adds those of new words. When
    more than `most` words would be held, the table starts anew."""

    def __init__(self, most: int, learn: Callable[[list[str]], None]) -> None:
        self.most, self.learn = most, learn
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 16, dtype="<u4")  # in the order of places
        self.bounds = np.zeros(1 << 14, dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        """Words whose ids stand one after the other, each up to its stop."""
        n = len(self.place)
        at = self.bounds[n]
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + len(words) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[at : at + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(words)] = at + stops
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def _places(self, words: list[str]) -> np.ndarray:
        found = list(map(self.place.get, words))
        if None in found:
            new = [w for w, i in zip(words, found, strict=True) if i is None]
            if len(self.place) + len(new) > self.most:
                self.clear()
                new = words
            self.learn(new)
            found = list(map(self.place.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and where each word's begin and the last one's end."""
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        at, upto = ragged(self.bounds[place], self.bounds[place + 1] - self.bounds[place])
        return self.ids[at], upto


def by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole texts (column 1) of BATCH bytes or a little more."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        done = upto[at - 1] if at else 0
        stop = int(np.searchsorted(upto, done + BATCH)) + 1
        yield batch.slice(at, stop - at)
        at = stop
