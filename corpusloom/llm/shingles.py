"""Five-word shingles as flat numpy arrays inside tasks; the words are hashed on the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm.common import SHINGLE, word_list

#: Words taken at once in a task; only bounds memory.
PIECE = 400_000


def word_hashes(text: Column) -> Column:
    """array<bigint>: a 64-bit hash per word."""
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and length per row (null: 0)."""
    size = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy().view(np.uint64), size.astype(np.int64)


def shingles(words: np.ndarray, size: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words per row and their number; fewer than k words are one shingle, none is none."""
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(size) - size, count) + at
    left = np.minimum(size, k)[row]
    out = np.zeros(len(start), np.uint64)
    for j in range(k):
        there = left > j
        w = np.zeros(len(start), np.uint64)
        w[there] = words[start[there] + j]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(j + 1))
    return out, count


def slices(size: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` words together; a longer row stands alone."""
    a, total = 0, 0
    for b, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(size):
        yield a, len(size)
