"""Pairs that can't be frequent are stopped before they are shuffled.

Counting pairs shuffles every distinct pair of a task, though at low support
most pairs stand in one or two baskets.  A first pass hashes the pairs into
buckets and only counts those: a task holds one number per bucket, and what it
hands on are its numbers, capped at ``min_count``, in compressed pages.  A
bucket whose sum over the tasks stays below ``min_count`` holds no frequent
pair.  The buckets that reach it become a bitmap of bounded size, and pairs of
other buckets are dropped where they are made.  The rows that remain, and the
counts, are those of all pairs that can be frequent, so results are the same.

Few items make few different pairs, which a task counts without handing on more
than one row for each: up to ``COUNTED_PAIRS`` there is no first pass.
"""

from __future__ import annotations

import math
import zlib
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.session import written

# Engineering limits.
FILTER_FROM = 20_000_000                      # pairs of all baskets from which on a first pass pays
COUNTED_PAIRS = 1 << 20                       # different pairs that a task counts and hands on without one
LEAST_BUCKET_BITS, MOST_BUCKET_BITS = 16, 24  # of a task's counters: 64 MB at most; the bitmap has 2 MB at most
PAGE_BUCKETS = 1 << 15                        # fixed: what a bitmap page holds


def bucket_bits(pairs: float, min_count: int) -> int:
    """So many buckets that usual ones stay below ``min_count``: four for every ``min_count`` pairs."""
    return min(MOST_BUCKET_BITS, max(LEAST_BUCKET_BITS, math.ceil(math.log2(max(1.0, 4 * pairs / min_count)))))


def different_pairs(items: DataFrame, keys: Sequence[str]) -> float:
    """How many pairs the items of (keys, item) can make, each key group for itself."""
    groups = items.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]


def worth_it(pairs: float, min_count: int) -> bool:
    """Enough pairs, and buckets that are not full of pairs that have nothing in common."""
    return min_count > 1 and pairs >= FILTER_FROM and pairs / (1 << bucket_bits(pairs, min_count)) < min_count


def _bucket(columns: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << bits)).cast("int")


def frequent_buckets(pairs: DataFrame, columns: Sequence[str], bits: int, min_count: int) -> DataFrame:
    """``(page, bits)``: one bitmap page per ``PAGE_BUCKETS`` buckets of which some hold ``min_count`` pairs; written."""
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            np.add.at(counts, batch.column("bucket").to_numpy(), 1)
        np.minimum(counts, min_count, out=counts)                  # in place: the counters are most of a task's memory
        pages = counts.astype("<u4", copy=False).reshape(-1, PAGE_BUCKETS)
        for page in range(len(pages)):
            if not pages[page].any():
                continue
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([zlib.compress(pages[page].tobytes(), 1)])],
                                             ["page", "counts"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None

        def answer():
            bitmap = np.packbits(total >= min_count, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([bitmap])], ["page", "bits"])

        for batch in batches:
            for page, counts in zip(batch.column("page").to_pylist(), batch.column("counts").to_pylist()):
                if page != name:
                    if name is not None:
                        yield answer()
                    name, total = page, np.zeros(PAGE_BUCKETS, np.uint64)
                total += np.frombuffer(zlib.decompress(counts), "<u4")
        if name is not None:
            yield answer()

    parts = (pairs.select(_bucket(columns, bits).alias("bucket")).mapInArrow(counted, "page int, counts binary")
             .repartition("page").sortWithinPartitions("page"))
    return written(parts.mapInArrow(summed, "page int, bits binary"), "buckets")


def possibly_frequent(pairs: DataFrame, columns: Sequence[str], total: float, min_count: int) -> DataFrame:
    """The rows of ``pairs`` (about ``total``) whose bucket holds ``min_count`` pairs or more.

    ``pairs`` is made twice, by a narrow step over written or shuffled baskets.
    The bitmap has one bit per bucket: 2 MB at most, so it is broadcast.
    """
    bits = bucket_bits(total, min_count)
    pages = frequent_buckets(pairs, columns, bits, min_count).withColumnsRenamed({"page": "_page", "bits": "_bits"})
    spot = _bucket(columns, bits)
    place = spot % PAGE_BUCKETS
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (pairs.withColumn("_page", F.floor(spot / PAGE_BUCKETS).cast("int")).join(F.broadcast(pages), "_page")
            .where(F.bit_get(byte, (place % 8).cast("int")) == 1).select(*pairs.columns))
