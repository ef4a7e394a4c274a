"""Mixing sources to target weights by subset-sum budget fitting.

Sources get word budgets by weight (water filling below a cap).  Each source
then takes whole passes over its documents and, for what is left of its
budget, a subset of documents whose lengths add up to it: documents are
counted by exact length, a bounded-knapsack dynamic program decides how many
documents of each length to take, and a seeded hash decides which ones.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 take part in whole passes only; an empty table gives an empty result; repeated rows are
separate documents, interchangeable where they tie in the seeded order.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.session import written

# Engineering limits.
FIT_BUDGET = 1 << 16   # words the dynamic program fits exactly; the rest goes by proportion and greedily
HANDED_BACK = 8        # documents of each length that the program may choose anew
MAX_SUMS = 1 << 18     # sums that the exchange of long documents tells apart before it stops
SEED_BUCKETS = 4096    # hash ranges that split one (source, length) group

GROUP = ["source", "size", "bucket"]


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that is never null and sorts like the sources, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), where a source is
    given by its key, see ``source_key``.

    Water filling in closed form: ordered by cap/weight, the level rises over
    the sources; those whose cap lies under it are full, the others get level
    times weight.  One row per source, so the ordered windows see the list of
    sources only (they spill, and hold no per-document rows).
    """
    by_name = Window.orderBy("source")
    by_ratio = Window.orderBy("ratio", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = ((F.lit(share) * F.sum("source_size").over(everything)
              - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"),
                                          F.struct("ratio", "level"))).over(everything)["level"])
        .select("source", "source_size",
                F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))
    )


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near
    to ``budget`` from below as the method finds.

    By proportion first (every length gives its share), then longest first
    until at most ``FIT_BUDGET`` words are open; where the documents left are too
    long for that, some are exchanged, see ``_exchanged``.  Some documents of every
    length are handed back within that budget, and an exact bounded knapsack
    chooses among all that are left.
    """
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    counts = np.where(lengths > 0, counts, 0)
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= FIT_BUDGET:
            break
        more = min(int(counts[i] - take[i]), left // max(1, int(lengths[i])))
        take[i] += more
        left -= more * int(lengths[i])
    if left > FIT_BUDGET:
        change = _exchanged(lengths, counts, take, left)
        take, left = take + change, left - int((change * lengths).sum())
    for i in np.argsort(lengths, kind="stable"):
        back = min(int(take[i]), HANDED_BACK, max(0, FIT_BUDGET - left) // max(1, int(lengths[i])))
        take[i] -= back
        left += back * int(lengths[i])
    return take + _knapsack(lengths, counts - take, min(left, FIT_BUDGET))


def _exchanged(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, left: int) -> np.ndarray:
    """How many more (or fewer) documents of each length to take so that the words
    added come nearest to ``left`` from below: reachable sums as a set, longest
    first, with at most ``HANDED_BACK`` documents of a length either way."""
    change = np.zeros_like(take)
    order = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0 and counts[i]]
    down = {i: min(int(take[i]), HANDED_BACK) for i in order}
    room = left + sum(down[i] * int(lengths[i]) for i in order)   # what later lengths can still take off a sum
    sums, steps = np.zeros(1, dtype=np.int64), []
    for i in order:
        room -= down[i] * int(lengths[i])
        moves = range(-down[i], min(int(counts[i] - take[i]), HANDED_BACK) + 1)
        steps.append((i, moves, sums))
        sums = np.unique(np.concatenate([sums + m * int(lengths[i]) for m in moves]))
        sums = sums[sums <= room]
        if len(sums) > MAX_SUMS or left in sums:
            break
    at = int(sums[sums <= left].max())
    for i, moves, before in reversed(steps):
        m = next(m for m in sorted(moves, key=abs) if at - m * int(lengths[i]) in before)
        change[i] = m
        at -= m * int(lengths[i])
    return change


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded subset sum.  ``reached[s]`` is the item that first made sum ``s``
    possible; items are binary multiples of one length, so walking back from the
    best sum uses every item at most once."""
    reached = np.full(budget + 1, -1, dtype=np.int64)
    possible = np.zeros(budget + 1, dtype=bool)
    possible[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        if possible[budget]:
            break
        size, rest, step = int(lengths[i]), int(counts[i]), 1
        rest = min(rest, budget // size) if size else 0
        while rest > 0:
            step = min(step, rest)
            words = size * step
            new = np.zeros_like(possible)
            new[words:] = possible[: budget + 1 - words]
            new &= ~possible
            reached[new] = len(items)
            possible |= new
            items.append((int(i), step))
            rest -= step
            step *= 2
    out = np.zeros_like(counts)
    at = int(np.flatnonzero(possible)[-1])
    while at:
        i, step = items[reached[at]]
        out[i] += step
        at -= int(lengths[i]) * step
    return out


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    passes = int(target // size) if size else 0
    counts = group["n"].to_numpy(dtype=np.int64)
    take = fit_lengths(group["size"].to_numpy(dtype=np.int64), counts, round(target - passes * size))
    return group[["source", "size"]].assign(passes=passes, take=take)


def _plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """From (source, size, bucket, ...) rows: targets per source, and per
    (source, size, bucket) the whole passes and how many more documents the
    partial pass has open when it comes to that bucket."""
    buckets = written(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("in_bucket")), "lengths")
    lengths = buckets.groupBy("source", "size").agg(F.sum("in_bucket").alias("n"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    fitted = (lengths.join(targets, "source").groupBy("source")
              .applyInPandas(_fit_source, "source string, size long, passes long, take long"))
    below = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (buckets.join(fitted, ["source", "size"])
            .withColumn("before", F.coalesce(F.sum("in_bucket").over(below), F.lit(0)))
            .select(*GROUP, "passes", (F.col("take") - F.col("before")).alias("open")))
    return targets, written(cuts, "cuts")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17,
        whole_rows: bool = False, copies_col: str = "copies") -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)``, one row per document;
    with ``whole_rows`` the rows of ``docs`` that the mix takes, and their copies
    in ``copies_col``, which must be no column of ``docs``.

    ``weights`` repeat over the sources in code point order (null last);
    ``share`` of all words is given out; no source gets more than ``cap``
    times its words.  ``copies`` is how often the mix reads the document and
    ``taken`` = copies * size.  Reruns with the same ``seed`` agree.

    Scale: documents cross the network once, dealt by (source, size, hash
    range), so neither a hot source nor a hot length meets in one task.  The
    fit sees one row per distinct length of a source -- at most
    sqrt(2 * words of the source) rows, since distinct lengths add up.
    """
    if whole_rows and copies_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{copies_col!r} is a column already")
    seeded = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    payload = F.struct("*") if whole_rows else F.col(id_col)
    rows = docs.select(payload.alias("row"), source_key(F.col(source_col)).alias("source"),
                       word_count(F.col(text_col)).alias("size"), seeded.alias("seeded"))
    rows = rows.withColumn("bucket", F.pmod("seeded", F.lit(SEED_BUCKETS)).cast("int"))
    if not whole_rows:   # a narrow table: written once, read by the count and by the ranking
        rows = written(rows, "mix")
    targets, cuts = _plan(rows, weights, share, cap)
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy("seeded"))
    copies = F.col("passes") + (F.col("rank") <= F.col("open")).cast("long")
    taken = rows.withColumn("rank", rank).join(cuts, GROUP).withColumn("copies", copies)   # dealt once for both
    if whole_rows:
        return taken.where("copies > 0").select("row.*", F.col("copies").alias(copies_col))
    return taken.join(targets, "source").select(
        F.col("row").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies")
