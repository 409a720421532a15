r"""Words of texts as numpy arrays: places and hashes, for whole batches at once.

Words are runs of ``[^\x20\x09-\x0D]`` in the text with A-Z in lower case.  A word's hash is
64 bits wide and depends on its bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at a time; a longer text is worked on alone.
RUN_BYTES = 3_000_000
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of several texts: ``hashes``; text i has those from bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.data = np.frombuffer(b"\n".join([b"", *raw, b""]).lower(), np.uint8)
        blank = _BLANK[self.data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.starts, self.ends = edge[0::2], edge[1::2]
        #: place of each text in ``data``
        self.offsets = np.cumsum([1, *[len(r) + 1 for r in raw]])
        self.bounds = np.searchsorted(self.starts, self.offsets)
        lengths = self.ends - self.starts
        if not len(lengths):
            self.hashes = np.zeros(0, np.uint64)
            return
        first = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(first, lengths)
        power = np.cumprod(np.full(lengths.max(), _STEP, np.uint64))
        value = _BYTE[self.data[within + np.repeat(self.starts, lengths)]] * power[within]
        self.hashes = mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one text, and the text of each."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = total * _STEP + self.hashes[k : k + n]
        text = np.searchsorted(self.bounds, np.arange(n), side="right") - 1
        inside = np.arange(n) + size <= self.bounds[text + 1]
        return mixed(total[inside]), text[inside]


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of bounded length, each with the place of its first; nulls are empty."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        run.append(text or "")
        size += len(run[-1])
        if size > RUN_BYTES:
            yield first, run
            first, run, size = i + 1, [], 0
    if run:
        yield first, run
