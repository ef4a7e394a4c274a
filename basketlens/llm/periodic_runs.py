"""Periodic runs of words in a text: stretches that repeat with one period.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(least, 3 * q)`` that no neighbouring word extends.

1. Words become numbers, other numbers in every text, so that many texts can
   be laid end to end and worked on together: no two of them have a word in
   common.
2. Longest common extensions (how many words follow alike from two places)
   come from a difference cover: only suffixes that start at the sampled
   places, ``COVER`` modulo ``PERIOD``, are sorted, by their first ``PERIOD``
   words and then by doubling.  For any two places a few words are compared
   until both stand on samples; from there the answer is the least common
   prefix between their ranks, read from a sparse table.
3. For every period p the places 0, g, 2g, ... are compared with the places p
   further on, to the right and to the left.  A stretch of the least length
   holds a place of that grid when g = max(least, 3p) - p, so no run is missed,
   and the grids have n log n places in all.  A multiple of a run's period
   gives the same stretch again; the smallest stays.

Defined cases: null or empty texts have no words and no runs; a text
of any length is worked on whole, by one task; repeated rows are worked on each
by itself; an empty table gives no rows; ids may be null or of any type; other
columns are not looked at.
"""

from __future__ import annotations

from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = 21                       # of the difference cover
COVER = (3, 6, 7, 12, 14)         # fixed: every difference modulo 21 is one of two of these

LEAST = 24                        # words of the shortest run
REPEATS = 3                       # periods of the shortest run
BATCH_WORDS = 1 << 17             # words that are worked on together; a longer text is alone
GRID_POINTS = 1 << 19             # comparisons made at a time
BATCH_ROWS = 256

RUNS = "array<struct<start: long, length: long, period: long>>"


def _sync_table() -> np.ndarray:
    """[i mod PERIOD, j mod PERIOD] -> the least d with i + d and j + d both sampled."""
    table = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    for a in COVER:
        for b in COVER:
            for i in range(PERIOD):
                d = (a - i) % PERIOD
                j = (b - d) % PERIOD
                table[i, j] = min(table[i, j], d)
    return table


SYNC = _sync_table()
SAMPLE_OF = np.zeros(PERIOD, np.int64)     # place of a residue among the sampled ones
SAMPLE_OF[list(COVER)] = np.arange(len(COVER))


def _ranks(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the entries in ``order``; ``same[k]``: entry k + 1 equals entry k."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.concatenate([[1], 1 + np.cumsum(~same)])
    return ranks


class CommonExtension:
    """Longest common extensions to the right in a sequence of numbers from 1 on."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * PERIOD, words.dtype)])   # 0 matches no word
        cycles = np.arange(n // PERIOD + 1) * PERIOD
        places = (cycles[:, None] + np.array(COVER)).reshape(-1)
        self.places = places[places < n]
        levels = self._levels()
        self.rank = np.append(levels[-1] - 1, 0) if len(self.places) else np.zeros(1, np.int64)
        self.table = self._sparse_table(self._common_prefixes(levels))

    def _levels(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first PERIOD, 2 PERIOD, 4 PERIOD ... words."""
        count = len(self.places)
        if not count:
            return [np.empty(0, np.int64)]
        bits = max(1, int(self.words.max()).bit_length())
        packed = 63 // bits
        keys = []
        for first in range(0, PERIOD, packed):
            key = np.zeros(count, np.uint64)
            for k in range(first, min(PERIOD, first + packed)):
                key = (key << np.uint64(bits)) | self.words[self.places + k].astype(np.uint64)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        same = np.ones(max(0, count - 1), bool)
        for key in keys:
            same &= key[order][1:] == key[order][:-1]
        levels, step = [_ranks(order, same)], len(COVER)
        while levels[-1].max() < count:
            key = levels[-1] * (count + 1)
            key[:max(0, count - step)] += levels[-1][step:]
            order = np.argsort(key, kind="stable")
            levels.append(_ranks(order, key[order][1:] == key[order][:-1]))
            step *= 2
        return levels

    def _common_prefixes(self, levels: list[np.ndarray]) -> np.ndarray:
        """Words that neighbours in the order of sampled suffixes have in common."""
        count = len(self.places)
        if count < 2:
            return np.zeros(0, np.int64)
        order = np.argsort(levels[-1], kind="stable")
        a, b = order[:-1], order[1:]
        skipped = np.zeros(count - 1, np.int64)      # samples behind which both are alike
        for k in range(len(levels) - 1, -1, -1):
            ranks, step = np.append(levels[k], 0), len(COVER) << k
            alike = ranks[np.minimum(a + skipped, count)] == ranks[np.minimum(b + skipped, count)]
            skipped[alike] += step
        common = skipped // len(COVER) * PERIOD
        x, y = self.places[a] + common, self.places[b] + common
        going = np.arange(count - 1)
        while len(going):
            going = going[self.words[x[going]] == self.words[y[going]]]
            x[going] += 1
            y[going] += 1
        return x - self.places[a]

    @staticmethod
    def _sparse_table(prefixes: np.ndarray) -> np.ndarray:
        """Row k holds the least of 2**k neighbours from each place on."""
        rows = [prefixes]
        while 2 << (len(rows) - 1) <= len(prefixes):
            half = 1 << (len(rows) - 1)
            last = rows[-1].copy()
            last[:-half] = np.minimum(last[:-half], last[half:])
            rows.append(last)
        return np.stack(rows)

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from the places ``i`` and ``j`` (never equal) on are alike."""
        out = np.zeros(len(i), np.int64)
        wait = SYNC[i % PERIOD, j % PERIOD]
        going, ready = np.arange(len(i)), []
        for t in range(PERIOD):
            arrived = wait[going] == t
            ready.append(going[arrived])
            going = going[~arrived]
            if not len(going):
                break
            alike = self.words[i[going] + t] == self.words[j[going] + t]
            out[going[~alike]] = t
            going = going[alike]
        at = np.concatenate(ready)
        x, y = i[at] + wait[at], j[at] + wait[at]
        out[at] = wait[at]
        inside = (x < self.n) & (y < self.n)
        at, x, y = at[inside], x[inside], y[inside]
        if len(at):
            ranks = self.rank[np.stack([x, y]) // PERIOD * len(COVER) + SAMPLE_OF[np.stack([x, y]) % PERIOD]]
            low, high = ranks.min(axis=0), ranks.max(axis=0)
            k = np.frexp((high - low).astype(np.float64))[1] - 1      # floor of the binary logarithm
            out[at] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return out


def grid(n: int, least: int, repeats: int, points: int = GRID_POINTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the comparisons that find every run among ``n`` words."""
    periods = np.arange(1, (n // repeats if n >= least else 0) + 1)
    steps = np.maximum(least, repeats * periods) - periods
    counts = -(-(n - periods) // steps)
    ends = np.cumsum(counts)
    start = 0
    while start < len(periods):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + points, "right")))
        some = counts[start:stop]
        number = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        yield number * np.repeat(steps[start:stop], some), np.repeat(periods[start:stop], some)
        start = stop


def find_runs(words: np.ndarray, sizes: list[int], least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of texts laid end to end.

    ``words``: numbers from 1 on, of which no two texts share one; ``sizes``: the words of each text.
    """
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    right, left, n = CommonExtension(words), CommonExtension(words[::-1].copy()), len(words)
    found: list[np.ndarray] = []

    def compare(i: np.ndarray, p: np.ndarray) -> None:
        some = words[i] == words[i + p]
        i, p = i[some], p[some]
        after, before = right.extend(i, i + p), left.extend(n - i, n - i - p)
        length = before + after + p
        long = length >= np.maximum(least, repeats * p)
        found.append(np.stack([(i - before)[long], length[long], p[long]], axis=1))

    waiting, held, start = [], 0, 0
    for size in sizes:
        for i, p in grid(size, least, repeats):
            waiting.append((i + start, p))
            held += len(i)
            if held >= GRID_POINTS:
                compare(*(np.concatenate(c) for c in zip(*waiting)))
                waiting, held = [], 0
        start += size
    if waiting:
        compare(*(np.concatenate(c) for c in zip(*waiting)))
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]      # by start, length, period
    first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)) if len(runs) else np.zeros(0, bool)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stand in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                  repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per document.

    ``runs`` are all runs by start and period (places are word numbers from 0);
    ``collapsed`` is the text's words without those that stand in a run behind
    its first period, joined by one space.

    Scale: a narrow pass over the texts, nothing is shuffled or sent to the
    driver; a lost task is worked on again by itself.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(start, BATCH_ROWS)
                texts, numbers, total, known, first = [], [], 0, 0, 0
                for k, text in enumerate(piece.column("text")):
                    words = (text.as_py() or b"").split()      # bytes: between ASCII white space
                    ids: dict[bytes, int] = {}
                    numbers.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
                                   + (known + 1))
                    known += len(ids)
                    texts.append(words)
                    total += len(words)
                    if total >= BATCH_WORDS:
                        yield _answer(piece.column("doc_id").slice(first, k + 1 - first), texts, numbers, least, repeats)
                        texts, numbers, total, known, first = [], [], 0, 0, k + 1
                if texts:
                    yield _answer(piece.column("doc_id").slice(first), texts, numbers, least, repeats)

    found = rows.mapInArrow(run, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _answer(ids: pa.Array, texts: list[list[bytes]], numbers: list[np.ndarray], least: int,
            repeats: int) -> pa.RecordBatch:
    sizes = [len(t) for t in texts]
    words = np.concatenate(numbers)
    runs = find_runs(words, sizes, least, repeats)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.searchsorted(runs[:, 0], starts)
    gone = repeated(runs, len(words))
    collapsed = []
    for k, text in enumerate(texts):
        if bounds[k] < bounds[k + 1]:
            text = [w for w, drop in zip(text, gone[starts[k]:starts[k + 1]].tolist()) if not drop]
        collapsed.append(b" ".join(text))
    places = runs[:, 0] - np.repeat(starts[:-1], np.diff(bounds))
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (places, runs[:, 1], runs[:, 2])],
                                         ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
         pa.array(collapsed, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length/period (ties: smallest start, then period), or null."""
    def compare(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0))
    return F.get(F.array_sort(runs, compare), F.lit(0))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts of the query's contract, in which a tenth of the ids get a periodic end.

    With h = crc32 of the decimal id and g = h / 10: where h is divisible by 10
    the words from a = g % n on repeat those from a to a + p - 1, for
    p = 1 + (n - a) / (3 + g % 8).  Those words are joined by one space; other texts, and rows without an
    id, stay as they are.
    """
    spaces = "\t\n\x0b\x0c\r "
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), spaces, " " * len(spaces)), " "),
                     lambda w: w != "")

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def periodic(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise(F.lit(""))

    return docs.withColumn(text_col, F.when(h % 10 == 0, let(words, periodic)).otherwise(F.col(text_col)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query's contract, from ``periodic_runs``."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    best = F.col("best")
    return (periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"),
                    best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256)
                    .alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
