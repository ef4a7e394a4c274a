"""Co-occurrence core: exact counts of n-item sets per basket.

Used by every analysis that counts "baskets holding all of these members"
(item sets, searches, department sets, temporal, reorder and cross-department
patterns, pair views).

Plan (two shuffles of line-sized data for any n):

1. ``(keys, basket, item)`` with null items dropped.
2. Apriori pruning (exact): a member of a set with count >= m is itself in >= m
   baskets of its key group, so lines of rarer items are removed with a
   semi-join before any set is formed.
3. One row per basket: ``sort_array(collect_set(item))`` (shuffle 1; dedupes
   repeated lines).
4. n chained ``posexplode`` steps over the remaining tail of that array produce
   each n-subset once, members ascending.  Narrow and streaming: no row holds
   more than one array, no self-join of the lines.
5. ``groupBy(keys, members).count()`` with map-side partial aggregation
   (shuffle 2), so a very common set never piles up in one task.

Pairs in very many baskets: those whose hash bucket can't reach the count are
dropped between 4 and 5 (``pair_filter``), if there are too many different ones.

A condition on the members (a name that matches, different departments) is
carried as a ``tag`` of each item and tested between 4 and 5, so sets that fail
it are neither shuffled nor counted.

Oversized baskets: one row may stand for ``COMBOS_PER_ROW`` sets, so a basket
of more than ``row_limit(n)`` items is never one row.  Its items are dealt into
hash chunks of about ``chunk_items(n)``; the chunk tuples (ids only) are listed
from the basket's chunk count, meet their chunk arrays in joins on (basket,
chunk), and are repartitioned by (basket, tuple) before the explode steps, in
which member i comes from chunk i.  Each n-subset is made exactly once, and the
work of one hot basket is spread over as many tasks as it has tuples.  The list
of oversized baskets is a written table: the planner broadcasts it by its size
or joins it by a shuffle; there is no count above which the split is off.
"""

from __future__ import annotations

import math
import weakref
from dataclasses import dataclass
from typing import Callable, Iterable, List, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.config import check_itemset_size
from basketlens.operators import pair_filter
from basketlens.session import written

# Engineering limits (not reference values).
COMBOS_PER_ROW = 1_000_000    # sets that one basket row or chunk tuple may expand to
HOT_LINES = 4096              # lines of one basket that a join keeps in one task


def row_limit(n: int) -> int:
    """Items of the largest basket whose n-subsets one row may make."""
    k = n
    while math.comb(k + 1, n) <= COMBOS_PER_ROW:
        k += 1
    return k


def chunk_items(n: int) -> int:
    """Items of a chunk, so that a tuple of n chunks makes at most ``COMBOS_PER_ROW`` sets."""
    return max(1, int(COMBOS_PER_ROW ** (1 / n)))


# Per line table results that cost a pass over the lines (basket profiles, pinned
# item supports), shared by the analyses that receive the same DataFrame object
# (e.g. every analysis of one Dataset).  Keyed by object identity and dropped
# with the DataFrame; a new DataFrame over the same files computes afresh.
_PER_LINES: "weakref.WeakKeyDictionary[DataFrame, dict]" = weakref.WeakKeyDictionary()


def memo(lines: DataFrame, key: tuple, compute):
    try:
        slot = _PER_LINES.setdefault(lines, {})
    except TypeError:  # not weak-referenceable: no sharing
        return compute()
    if key not in slot:
        slot[key] = compute()
    return slot[key]


def pinned(df: DataFrame) -> DataFrame:
    """Compute a per-item aggregate once.

    It is written to the shared folder and read back: the lineage is cut (lost
    executors cost nothing), its columns are new to the plans that use it, and
    the planner knows its real size, so it is broadcast only below
    ``spark.sql.autoBroadcastJoinThreshold`` and else joined by a shuffle.
    """
    return written(df, "pinned")


def member_names(n: int, prefix: str = "item_") -> List[str]:
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def frequent_only(lines: DataFrame, basket: str, item: str, keys: Sequence[str],
                  min_count: int, item_counts: Optional[DataFrame] = None) -> DataFrame:
    """Keep lines of items found in >= ``min_count`` distinct baskets of their key group.

    ``item_counts`` -- (keys, item, count) already computed over the same
    lines (e.g. the item supports a caller also joins for its metrics); passing
    it lets both uses share one aggregation.
    """
    if item_counts is None:
        item_counts = pinned(item_supports(lines, basket, item, keys=keys))
    count_col = [c for c in item_counts.columns if c not in (*keys, item)][0]
    keep = item_counts.where(F.col(count_col) >= min_count).select(*keys, item)
    return lines.join(keep, [*keys, item], "left_semi")


@dataclass(frozen=True)
class BasketProfile:
    """What one pass over the lines says about the baskets.

    ``baskets``   -- distinct non-null basket ids (one number)
    ``oversized`` -- (basket, _k) for baskets of more than ``limit`` lines, or None

    A profile of a line table also serves any subset of its lines: a basket
    can only shrink, so the oversized list stays a superset (the split paths
    are exact for baskets of any size).
    """
    baskets: int
    oversized: Optional[DataFrame]
    limit: int


def _sizes(lines: DataFrame, basket: str) -> DataFrame:
    return memo(lines, ("sizes", basket), lambda: written(
        lines.where(F.col(basket).isNotNull()).groupBy(basket).agg(F.count(F.lit(1)).alias("_k")), "sizes"))


def basket_profile(lines: DataFrame, basket: str = "order_id", limit: int = HOT_LINES) -> BasketProfile:
    """Profile of ``lines`` (shared across analyses of the same DataFrame object).

    One aggregation by basket writes its line counts; the profiles for all
    limits read that table.
    """
    sizes = _sizes(lines, basket)
    total, most = memo(lines, ("total", basket), lambda: sizes.agg(F.count(F.lit(1)), F.max("_k")).first())

    def oversized() -> Optional[DataFrame]:
        return written(sizes.where(F.col("_k") > limit), "oversized") if (most or 0) > limit else None

    return BasketProfile(int(total), memo(lines, ("oversized", basket, limit), oversized), limit)


def expanded_sets(lines: DataFrame, n: int, basket: str = "order_id") -> tuple[float, int]:
    """(n-subsets of all baskets, lines), from the basket sizes of ``lines``."""
    sizes = _sizes(lines, basket)
    choose = F.lit(1.0)
    for i in range(n):
        choose = choose * F.greatest(F.col("_k") - i, F.lit(0)) / (i + 1)
    return tuple(memo(lines, ("expanded", basket, n), lambda: sizes.agg(
        F.coalesce(F.sum(choose), F.lit(0.0)), F.coalesce(F.sum("_k"), F.lit(0))).first()))


def join_baskets(lines: DataFrame, baskets: DataFrame, basket: str = "order_id",
                 how: str = "inner", profile: Optional[BasketProfile] = None) -> DataFrame:
    """``lines`` joined to a one-row-per-basket table, hot baskets salted.

    A plain join on the basket id sends all lines of one basket to one task.
    Lines of the oversized baskets named by ``profile`` (a profile of these
    lines or of a superset) get a salt, their basket rows one copy per salt,
    so that no task gets more than about ``profile.limit`` lines of a basket.
    ``how`` is ``inner``, ``left`` or ``left_semi``.
    """
    if profile is None:
        profile = basket_profile(lines, basket)
    if profile.oversized is None:
        return lines.join(baskets, basket, how)
    salts = profile.oversized.select(basket, F.ceil(F.col("_k") / profile.limit).cast("int").alias("_salts"))
    cold = lines.join(salts.select(basket), basket, "left_anti").join(baskets, basket, how)
    hot = (lines.join(salts, basket)
           .withColumn("_salt", F.pmod(F.xxhash64(*lines.columns), F.col("_salts")).cast("int")).drop("_salts"))
    copies = (baskets.join(salts, basket)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts"))
    return cold.unionByName(hot.join(copies, [basket, "_salt"], how).drop("_salt"))


def _combos_in_row(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """rows: (keys, _items sorted) -> (keys, item_1 < ... < item_n)."""
    size = F.size("_items")
    out = rows.select(*keys, "_items", F.posexplode("_items").alias("_p1", "item_1"))
    out = out.where(F.col("_p1") <= size - n)
    for i in range(2, n + 1):
        prev = F.col(f"_p{i - 1}")
        out = out.select(
            *keys, *member_names(i - 1), "_items", prev.alias(f"_p{i - 1}"),
            F.posexplode(F.slice("_items", prev + 2, size)).alias("_q", f"item_{i}"),
        ).withColumn(f"_p{i}", prev + 1 + F.col("_q"))
        if i < n:
            out = out.where(F.col(f"_p{i}") <= size - 1 - (n - i))
    return out.select(*keys, *member_names(n))


def chunk_tuples(split: DataFrame, basket: str, n: int) -> DataFrame:
    """(basket, _c1 <= ... <= _cn): the chunk tuples of every basket in ``split`` (basket, _chunks)."""
    out = split
    for i in range(1, n + 1):
        low = F.lit(0) if i == 1 else F.col(f"_c{i - 1}")
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(low, F.col("_chunks") - 1)))
        out = out.repartition(basket, *[f"_c{j}" for j in range(1, i + 1)])
    return out.drop("_chunks")


def _combos_across_chunks(lines: DataFrame, split: DataFrame, basket: str, item: str,
                          keys: Sequence[str], n: int) -> DataFrame:
    """Oversized baskets: hash chunks, chunk tuples, one member per chunk slot."""
    chunked = (lines.join(split, basket)
               .withColumn("_c", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int"))
               .groupBy(*keys, basket, "_c")
               .agg(F.sort_array(F.collect_set(item)).alias("_a")))
    tuples = chunk_tuples(split, basket, n)
    for i in range(1, n + 1):
        side = chunked.withColumnsRenamed({"_c": f"_c{i}", "_a": f"_a{i}"})
        if i == 1:
            tuples = tuples.join(side, [basket, "_c1"])
            continue
        right = side.withColumnsRenamed({k: f"_r_{k}" for k in keys} | {basket: "_r_basket", f"_c{i}": "_r_c"})
        same = [tuples[basket] == right["_r_basket"], tuples[f"_c{i}"] == right["_r_c"]]
        same += [tuples[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
        tuples = tuples.join(right, same).drop("_r_basket", "_r_c", *[f"_r_{k}" for k in keys])
    # the tuples of one basket go to as many tasks as there are, before they expand
    tuples = tuples.repartition(basket, *[f"_c{i}" for i in range(1, n + 1)])

    carried = [c for i in range(2, n + 1) for c in (f"_c{i}", f"_a{i}")]
    out = tuples.select(*keys, "_c1", *carried, F.posexplode("_a1").alias("_p1", "item_1"))
    for i in range(2, n + 1):
        same = F.col(f"_c{i}") == F.col(f"_c{i - 1}")
        arr, prev = F.col(f"_a{i}"), F.col(f"_p{i - 1}")
        source = F.when(same, F.slice(arr, prev + 2, F.size(arr))).otherwise(arr)
        offset = F.when(same, prev + 1).otherwise(F.lit(0))
        rest = [c for j in range(i + 1, n + 1) for c in (f"_c{j}", f"_a{j}")]
        out = out.select(
            *keys, *member_names(i - 1), f"_c{i}", *rest,
            (F.posexplode(source)).alias("_q", f"item_{i}"),
            offset.alias("_off"),
        ).withColumn(f"_p{i}", F.col("_q") + F.col("_off"))
    ordered = F.sort_array(F.array(*member_names(n)))
    return out.select(*keys, *[ordered[i].alias(m) for i, m in enumerate(member_names(n))])


def itemset_combos(lines: DataFrame, n: int, basket: str, item: str, keys: Sequence[str],
                   profile: BasketProfile, chunk: Optional[int] = None) -> DataFrame:
    """(keys, item_1 < ... < item_n): one row per n-subset of every basket.

    ``profile`` names the baskets too large for one row; ``chunk`` is the
    number of items in a chunk of those.
    """
    split = profile.oversized
    normal = lines if split is None else lines.join(split.select(basket), basket, "left_anti")
    rows = (normal.groupBy(*keys, basket)
            .agg(F.sort_array(F.collect_set(item)).alias("_items"))
            .where(F.size("_items") >= n))
    combos = _combos_in_row(rows, keys, n)
    if split is None:
        return combos
    chunks = split.select(basket, F.ceil(F.col("_k") / (chunk or chunk_items(n))).cast("int").alias("_chunks"))
    return combos.unionByName(_combos_across_chunks(lines, chunks, basket, item, keys, n))


def itemset_counts(lines: DataFrame, n: int, *, basket: str = "order_id",
                   item: str = "product_id", keys: Iterable[str] = (),
                   min_count: int = 1, prune: bool = True,
                   count_col: str = "count", row_items: Optional[int] = None,
                   chunk: Optional[int] = None, profile_lines: Optional[DataFrame] = None,
                   item_counts: Optional[DataFrame] = None, tag: Optional[str] = None,
                   keep: Optional[Callable[[List[Column]], Column]] = None,
                   known: Optional[DataFrame] = None) -> DataFrame:
    """``(keys..., item_1 < ... < item_n, count_col)``: distinct baskets per set.

    ``keys`` must be functions of the basket (e.g. its time slot); counts are
    per key group.  Only sets with ``count >= min_count`` are returned.
    ``profile_lines`` -- the table whose profile names the oversized baskets
    (these lines or a superset, default these); ``item_counts`` -- (keys, item,
    count) over these lines, reused for pruning.  ``tag`` is a column that
    depends on the item; only sets whose member tags satisfy ``keep`` count.
    ``known`` -- a small table with a row for every item of lines that are not
    pruned here; it tells how many different pairs there can be.
    """
    n = check_itemset_size(n)
    keys = list(keys)
    base = lines.where(F.col(item).isNotNull())
    if prune and min_count > 1:
        if item_counts is None:
            item_counts = pinned(item_supports(base, basket, item, keys=keys))
        count = [c for c in item_counts.columns if c not in (*keys, item)][0]
        base, known = frequent_only(base, basket, item, keys, min_count, item_counts), item_counts.where(F.col(count) >= min_count)
    member = F.col(item) if tag is None else F.struct(F.col(item).alias("item"), F.col(tag).alias("tag"))
    base = base.select(*keys, basket, member.alias("_item"))

    sized = lines if profile_lines is None else profile_lines
    profile = basket_profile(sized, basket, row_items or row_limit(n))
    combos = itemset_combos(base, n, basket, "_item", keys, profile, chunk)
    if tag is not None:
        combos = (combos.where(keep([F.col(f"{m}.tag") for m in member_names(n)]))
                  .select(*keys, *[F.col(f"{m}.item").alias(m) for m in member_names(n)]))

    if (n == 2 and min_count > 1 and pair_filter.worth_it(expanded_sets(sized, 2, basket)[0], min_count)
            and (known is None or pair_filter.different_pairs(known, [k for k in keys if k in known.columns])
                 > pair_filter.COUNTED_PAIRS)):
        combos = pair_filter.possibly_frequent(combos, [*keys, *member_names(2)], expanded_sets(sized, 2, basket)[0], min_count)
    counts = combos.groupBy(*keys, *member_names(n)).agg(F.count(F.lit(1)).alias(count_col))
    if min_count > 1:
        counts = counts.where(F.col(count_col) >= min_count)
    return counts


def top_rows(df: DataFrame, order: Sequence[Column], limit: Optional[int]) -> DataFrame:
    """``df`` in ``order``, the first ``limit`` rows (None: all; 0: none)."""
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def pinned_supports(lines: DataFrame, basket: str = "order_id", item: str = "product_id",
                    name: str = "support_count", keys: Sequence[str] = ()) -> DataFrame:
    """``pinned(item_supports(...))``, shared across analyses of the same lines."""
    return memo(lines, ("supports", basket, item, name, tuple(keys)),
                 lambda: pinned(item_supports(lines, basket, item, name, keys)))


def item_supports(lines: DataFrame, basket: str = "order_id", item: str = "product_id",
                  name: str = "support_count", keys: Sequence[str] = ()) -> DataFrame:
    """Distinct baskets per item (per key group)."""
    return (lines.where(F.col(item).isNotNull()).groupBy(*keys, item)
            .agg(F.count_distinct(basket).alias(name)))


def with_members(df: DataFrame, n: int, table: DataFrame, key: str,
                 columns: dict, how: str = "inner", prefix: str = "item_") -> DataFrame:
    """Join a per-item table once per member.

    ``columns`` maps a column of ``table`` to a name pattern holding ``{i}``.
    """
    for i in range(1, n + 1):
        side = table.select(F.col(key).alias(f"{prefix}{i}"),
                            *[F.col(c).alias(p.format(i=i)) for c, p in columns.items()])
        df = df.join(side, f"{prefix}{i}", how)
    return df

