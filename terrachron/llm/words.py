"""Word and shingle hashes with numpy, used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_CHUNK = 4 << 20
#: Words that a memo holds at most; some 30 MB.
KEEP = 120_000


class WordHashes(dict):
    """word bytes -> 64-bit hash; emptied when it holds too many words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEEP:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def pieces(data: bytes, spaces: bytes = b" \t\n\r\x0b\x0c"):
    """``data`` in pieces of a few MB that end at white space, so a very long text never becomes one list of words."""
    start = 0
    while len(data) - start > _CHUNK:
        end = max(data.rfind(bytes((c,)), start, start + _CHUNK) for c in spaces)
        if end <= start:
            ends = [i for i in (data.find(bytes((c,)), start + _CHUNK) for c in spaces) if i >= 0]
            if not ends:
                break
            end = min(ends)
        yield data[start:end]
        start = end
    yield data[start:]


def word_hashes(data: bytes, memo: WordHashes) -> np.ndarray:
    """64-bit hashes of the words of ``data`` (separated by ASCII white space)."""
    parts = []
    for piece in pieces(data):
        words = piece.split()
        parts.append(np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of fewer words, the one whole sequence."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    width = min(size, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            h = (h + words[i : n - width + 1 + i]) * _M[i % len(_M)]
            h ^= h >> np.uint64(29)
        return np.unique(_mixed(h).view(np.int64))
