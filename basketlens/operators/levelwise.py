"""Frequent sets level by level: candidates from the level below, counted over
bitmaps of chunks of baskets.

For sets of three and more members, and for baskets so large that listing
their C(k, n) subsets is the cost.

1. Level 1 are the items in at least ``min_count`` baskets, level 2 their pairs
   (``cooccur.itemset_counts``).
2. A set of k + 1 items is a candidate only if all its k-subsets are frequent:
   two frequent sets that agree but for their last member make one, and
   semi-joins with the level below test the other subsets.  No basket is looked
   at, so what is formed does not depend on how large baskets are.
3. The baskets are dealt into chunks by a hash, and a chunk is one row: its
   frequent items and, for every item, a bitmap of the chunk's baskets that hold
   it.  The table is written once and serves all levels.
4. Candidates go to the tasks as a trie (sorted sets, walked by shared
   prefixes) when their number allows it, else in parts.  In a chunk the
   bitmap of a prefix is the AND of its members' and is shared by all sets
   below it; words in which the prefix is empty are left out of the counting.
   Counts add up over chunks, so no task needs more than one chunk at a time
   and none sees all baskets of a frequent item.
"""

from __future__ import annotations

import math
from typing import Callable, Dict, Iterable, Iterator, List, Optional, Union

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.operators.cooccur import itemset_counts, member_names, pinned
from basketlens.session import arrow_rows, written

# Engineering limits.
CHUNK_BASKETS = 1 << 15     # baskets of a chunk, fewer ...
CHUNK_BYTES = 16 << 20      # ... where the bitmaps of all items would take more than this
SHIPPED_SETS = 1 << 20      # candidates that go to the tasks at a time
CHUNK_ROWS = 2              # chunks a task receives at a time


# -- chunks ---------------------------------------------------------------------

def chunk_table(lines: DataFrame, basket: str, item: str, baskets: Union[int, Dict[int, int]], items: int,
                power: Optional[str] = None) -> DataFrame:
    """``(items, words, bitmaps, power)``, one row per chunk of baskets; ids are longs.

    ``power`` is a column of the basket: a chunk holds baskets of one value of
    it, and ``baskets`` is their number by value (without it, just a number).
    """
    size = max(64, min(CHUNK_BASKETS, 8 * CHUNK_BYTES // max(1, items)))
    groups = sorted(baskets.items()) if power else [(0, baskets)]
    counts = [max(1, math.ceil(count / size)) for _, count in groups]
    powers = np.repeat(np.array([value for value, _ in groups], np.int32), counts)
    chunk = F.pmod(F.xxhash64(basket), F.lit(counts[0]))
    if power:
        chunk, start = F.lit(None).cast("long"), 0
        for (value, _), count in zip(groups, counts):
            chunk = F.when(F.col(power) == value, start + F.pmod(F.xxhash64(basket), F.lit(count))).otherwise(chunk)
            start += count
    rows = (lines.select(chunk.cast("long").alias("chunk"), F.col(basket).cast("long").alias("basket"),
                         F.col(item).cast("long").alias("item"))
            .repartition("chunk").sortWithinPartitions("chunk", "basket"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            chunks, baskets, ids = (batch.column(c).to_numpy() for c in ("chunk", "basket", "item"))
            bounds = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for start, stop in zip(bounds, bounds[1:]):
                if start == stop:
                    continue
                if chunks[start] != name and held:
                    yield _chunk(held, powers[name])
                    held = []
                name = chunks[start]
                held.append((baskets[start:stop], ids[start:stop]))
        if held:
            yield _chunk(held, powers[name])

    with arrow_rows(lines.sparkSession, 10_000):
        return written(rows.mapInArrow(run, "items binary, words int, bitmaps binary, power int"), "chunks")


def _chunk(held: list, power: int) -> pa.RecordBatch:
    baskets, ids = (np.concatenate(c) for c in zip(*held))
    place = np.concatenate([[0], np.cumsum(baskets[1:] != baskets[:-1])])
    items, row = np.unique(ids, return_inverse=True)
    words = int(place[-1]) // 64 + 1
    spot = row * words + place // 64
    order = np.argsort(spot, kind="stable")
    spots, first = np.unique(spot[order], return_index=True)
    bitmaps = np.zeros(len(items) * words, np.uint64)
    bitmaps[spots] = np.bitwise_or.reduceat(np.uint64(1) << (place[order] % 64).astype(np.uint64), first)
    return pa.RecordBatch.from_arrays(
        [pa.array([items.astype(np.int64).tobytes()], pa.binary()), pa.array([words], pa.int32()),
         pa.array([bitmaps.tobytes()], pa.binary()), pa.array([power], pa.int32())], ["items", "words", "bitmaps", "power"])


def count_in_chunk(sets: np.ndarray, items: np.ndarray, bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``sets``, count) of the sets that some basket of a chunk holds.

    ``sets``: one set a row, rows sorted; ``items``: the chunk's items, sorted;
    ``bitmaps``: one row per item.
    """
    place = np.minimum(np.searchsorted(items, sets), len(items) - 1)
    here = np.flatnonzero((items[place] == sets).all(axis=1))
    place = place[here]
    if not len(here):
        return here, here
    prefix = place[:, :-1]
    changed = np.ones(len(here), bool)
    changed[1:] = (prefix[1:] != prefix[:-1]).any(axis=1)
    starts = np.flatnonzero(changed)
    counts = np.zeros(len(here), np.int64)
    path: list = []                                   # (item, AND of the bitmaps down to it) of the last prefix
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(here)]):
        members = prefix[start].tolist()
        same = 0
        while same < len(path) and path[same][0] == members[same]:
            same += 1
        del path[same:]
        for m in members[same:]:
            path.append((m, bitmaps[m] & path[-1][1] if path else bitmaps[m]))
        mask = path[-1][1]
        some = np.flatnonzero(mask)
        if len(some):
            last = bitmaps[np.ix_(place[start:stop, -1], some)]
            counts[start:stop] = np.bitwise_count(last & mask[some]).sum(axis=1)
    held = counts > 0
    return here[held], counts[held]


# -- candidates -----------------------------------------------------------------

def candidates(sets: DataFrame, k: int) -> DataFrame:
    """``(item_1 < ... < item_{k+1})``, k >= 2: the sets all of whose k-subsets are in ``sets``."""
    names = member_names(k + 1)
    left = sets.select(*names[:k])
    right = sets.select(*names[:k - 1], F.col(names[k - 1]).alias(names[k]))
    found = left.join(right, names[:k - 1]).where(F.col(names[k - 1]) < F.col(names[k])).select(*names)
    for left_out in range(k - 1):       # without one of the last two they are in ``sets`` already
        rest = [m for i, m in enumerate(names) if i != left_out]
        found = found.join(sets.select(*[F.col(a).alias(b) for a, b in zip(names, rest)]), rest, "left_semi")
    return found.select(*names)


def count_candidates(chunks: DataFrame, found: DataFrame, n: int, min_count: int, count_col: str = "count") -> DataFrame:
    """``(item_1..item_n, count)`` of the candidates in at least ``min_count`` baskets, written.

    ``found`` is a written table.  It goes to the tasks in parts of
    ``SHIPPED_SETS``: sets are distinct, so a hash deals them evenly.
    """
    names = member_names(n)
    total = found.count()
    parts = max(1, math.ceil(2 * total / SHIPPED_SETS)) if total > SHIPPED_SETS else 1
    context = found.sparkSession.sparkContext
    tables = []
    with arrow_rows(found.sparkSession, CHUNK_ROWS):
        for part in range(parts if total else 0):
            some = found.where(F.pmod(F.xxhash64(*names), F.lit(parts)) == part).toArrow()
            sets = np.stack([some.column(c).to_numpy() for c in names], axis=1)
            if len(sets):
                shipped = context.broadcast(sets[np.lexsort(sets.T[::-1])])
                tables.append(chunks.mapInArrow(_counting(shipped, n), ", ".join(f"{m} long" for m in names) + ", c long"))
        if not tables:
            return found.withColumn(count_col, F.lit(0).cast("long")).limit(0)
        counts = tables[0]
        for more in tables[1:]:
            counts = counts.unionByName(more)
        return written(counts.groupBy(*names).agg(F.sum("c").alias(count_col))
                       .where(F.col(count_col) >= min_count), f"level-{n}")


def _counting(shipped, n: int):
    names = member_names(n)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = shipped.value
        total = np.zeros(len(sets), np.int64)
        for batch in batches:
            for items, words, bitmaps in zip(*(batch.column(c) for c in ("items", "words", "bitmaps"))):
                held = np.frombuffer(items.as_buffer(), np.int64)
                rows, counts = count_in_chunk(sets, held, np.frombuffer(bitmaps.as_buffer(), np.uint64)
                                              .reshape(len(held), words.as_py()))
                total[rows] += counts
        some = np.flatnonzero(total)
        for start in range(0, len(some), 1 << 16):
            piece = some[start:start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*[pa.array(sets[piece, i]) for i in range(n)], pa.array(total[piece])],
                                             [*names, "c"])
    return run


# -- levels -----------------------------------------------------------------------

def frequent_levels(lines: DataFrame, min_count: int, max_size: Optional[int] = None, *, basket: str = "order_id",
                    item: str = "product_id", baskets: int, profile_lines: Optional[DataFrame] = None,
                    supports: Optional[DataFrame] = None, count_col: str = "count",
                    last: Optional[Callable[[DataFrame, List[str]], DataFrame]] = None) -> List[DataFrame]:
    """``[(item_1, count), (item_1, item_2, count), ...]``: all sets in at least ``min_count`` baskets.

    One written table per level, up to ``max_size`` members or until a level is
    empty.  ``lines`` holds long ids; ``baskets`` is their number of baskets (an
    upper bound will do); ``supports`` (item, count) saves a pass;
    ``last(candidates, members)`` filters the candidates of level ``max_size``.
    """
    lines = lines.where(F.col(item).isNotNull() & F.col(basket).isNotNull())
    if supports is None:
        supports = lines.groupBy(item).agg(F.count_distinct(basket).alias(count_col))
    single = pinned(supports.select(F.col(item).alias("item_1"), F.col([c for c in supports.columns if c != item][0])
                                    .cast("long").alias(count_col)).where(F.col(count_col) >= min_count))
    levels, items = [single], single.count()
    if max_size == 1 or items < 2:
        return levels
    frequent = lines.join(single.select(F.col("item_1").alias(item)), item, "left_semi")
    pairs = itemset_counts(frequent, 2, basket=basket, item=item, min_count=min_count, prune=False, count_col=count_col,
                           profile_lines=lines if profile_lines is None else profile_lines, known=single)
    if max_size == 2 and last:
        pairs = last(pairs, member_names(2))
    levels.append(written(pairs, "level-2"))
    chunks, k = None, 2
    while k != max_size and not levels[-1].isEmpty():
        found = candidates(levels[-1], k)
        if last and k + 1 == max_size:
            found = last(found, member_names(k + 1))
        found = written(found, "candidates")
        if found.isEmpty():
            break
        if chunks is None:
            # only items of a frequent pair can be in larger sets
            left = levels[1].select(F.explode(F.array("item_1", "item_2")).alias(item)).distinct()
            chunks = chunk_table(frequent.join(left, item, "left_semi"), basket, item, baskets, items)
        levels.append(count_candidates(chunks, found, k + 1, min_count, count_col))
        k += 1
    return levels if len(levels) == 1 or not levels[-1].isEmpty() else levels[:-1]
