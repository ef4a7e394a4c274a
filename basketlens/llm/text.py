"""Words and shingle hashes inside tasks."""

from __future__ import annotations

import re
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")        # fixed: words between ASCII white space
WORDS = re.compile(r"[^\W_]+")                   # letters and digits of any script
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))

CACHED_WORDS = 1 << 17   # entries one task remembers
SLICE_ROWS = 500         # rows turned into Python objects at a time


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, everything else as it is (bytes of other characters are all above 127)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").translate(LOWER).decode(
        "utf-8", "surrogatepass")


def spaced_words(text: str) -> list[str]:
    """Runs of anything but ASCII white space."""
    return SPACED.findall(text) if OTHER_SPACE.search(text) else text.split()


class WordHashes(dict):
    """64-bit hash of a word; remembers the usual words of a task."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


def shingle_hashes(words: list[str], n: int, known: WordHashes) -> np.ndarray:
    """Hashes of the n-word shingles in text order (uint64); with fewer than n
    words the whole sequence is one shingle, without words there is none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    m = len(h) - k + 1
    out = np.full(m, k, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i:i + m]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    ordered = np.sort(hashes)
    return ordered[np.append(True, ordered[1:] != ordered[:-1])] if len(ordered) else ordered


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that a task holds few Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Short pieces of the batches with the texts of a column, null as empty."""
    for batch in slices(batches):
        yield batch, [t or "" for t in batch.column(column).to_pylist()]
