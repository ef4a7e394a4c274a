"""O21 purchase history and O22 co-purchase recommendations.

``association_strength`` of a candidate item is the number of distinct prior
orders (anyone's) that hold the candidate and at least one item the user has
bought.  It is not a sum of pair counts (an order with two of the user's items
counts once), so it is computed from orders, not from pair tables:

    user items -> orders touching them (semi-join) -> their lines
    -> minus the user's items (anti-join) -> distinct orders per candidate
"""

from __future__ import annotations

import math
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.dataset import Dataset
from basketlens.operators import levelwise
from basketlens.operators.cooccur import BasketProfile, basket_profile, join_baskets, pinned_supports
from basketlens.operators.levelwise import CHUNK_ROWS, chunk_table
from basketlens.session import arrow_rows, written

LOOKUP_ORDERS = 1_000     # order ids that a scan is asked for
# Engineering limits of the many-user form.
OWNED_ROWS = 1 << 18      # owned items of the classes in a block (2 MB)
HELD_BYTES = 128 << 20    # bitmaps a task works on together
RUN_WORDS = 16            # shorter runs of words are not cut
PASSED_WORDS = 1 << 16    # words (of classes x orders) that are counted together: what the cache holds
SHARED_ITEMS = 2          # items of all orders of a run that are looked at
SUM_CELLS = 1 << 22       # sums (users x items) a task holds at a time (32 MB)


def _lines_of(ds: Dataset, user_id: int) -> DataFrame:
    """The user's prior lines.

    A user has few orders: up to ``LOOKUP_ORDERS`` ids become a filter of the
    scan, which skips the row groups that can't hold them (tables saved for
    lookups are sorted and carry Bloom filters); more are a written table that
    the lines are joined with.
    """
    orders = written(ds.orders.where(F.col("user_id") == F.lit(user_id)).select("order_id").distinct(), "user")
    ids = [r["order_id"] for r in orders.limit(LOOKUP_ORDERS + 1).collect()]
    if len(ids) > LOOKUP_ORDERS:
        return ds.order_products_prior.join(orders, "order_id", "left_semi")
    return ds.order_products_prior.where(F.col("order_id").isin(ids))


def history(ds: Dataset, user_id: int) -> DataFrame:
    """The user's prior lines per product, most bought first."""
    return (_lines_of(ds, user_id)
            .groupBy("product_id").agg(F.count(F.lit(1)).alias("purchase_count"))
            .join(ds.products.select("product_id", "product_name"), "product_id")
            .select("product_id", "product_name", "purchase_count")
            .orderBy(F.col("purchase_count").desc(), "product_id"))


def _dims(ds: Dataset) -> DataFrame:
    return (ds.products_clean.join(ds.aisles, "aisle_id").join(ds.departments, "department_id")
            .select("product_id", "product_name", "aisle", "department"))


def for_user(ds: Dataset, user_id: int, n: int = 10) -> DataFrame:
    """Top ``n`` candidates by strength with their global ``rank``.

    The user's orders and items are small written tables; the orders touching
    an item are one row per order, joined to the lines with hot orders salted.
    The rank of a row in the top ``n`` only depends on rows with a higher
    strength, all of which are in the top ``n``; so ranking the ``n`` kept rows
    (a bounded window) gives the rank over all candidates.
    """
    lines = ds.order_products_prior.select("order_id", "product_id")
    profile = basket_profile(ds.order_products_prior)
    owned = written(_lines_of(ds, user_id).select("product_id").where(F.col("product_id").isNotNull()).distinct(), "owned")
    touching = lines.join(owned, "product_id", "left_semi").select("order_id").distinct()
    cands = (join_baskets(lines, touching, how="left_semi", profile=profile)
             .join(owned, "product_id", "left_anti")
             .groupBy("product_id").agg(F.count_distinct("order_id").alias("association_strength"))
             .join(_dims(ds), "product_id"))
    top = cands.orderBy(F.col("association_strength").desc(), "product_id").limit(n)
    w = Window.orderBy(F.col("association_strength").desc())
    return (top.select("product_name", "product_id", "aisle", "department",
                       "association_strength", F.rank().over(w).alias("rank"))
            .orderBy(F.col("association_strength").desc(), "product_id"))


def for_users(ds: Dataset, users: DataFrame, n: int = 10) -> DataFrame:
    """Many-user form of O22: ``users`` holds a ``user_id`` column (all users will do).

    Users who own the same items get the same answer, so the work is done once
    for each class of them, named by its smallest user.  Equal orders are
    counted once too (``_weighted_orders``).  Items are coded by their support,
    the most bought first, and the orders are sorted by their codes and cut into
    chunks, one row each, with a bitmap of orders for every item; the classes
    are dealt into blocks of ``OWNED_ROWS`` owned items, and every block meets
    every chunk in some task of a grid.  In a chunk the orders that touch a
    class are the OR of the bitmaps of the owned items, and the strength of a
    candidate is the number of those orders in its own bitmap; strengths add up
    over chunks.  Neighbours in a chunk share their first items, so a class that
    owns one of these touches them all and is left out there; of the others the
    orders that they don't touch are counted (``_Orders``).  So no (user, order)
    row exists, an order that touches every user, or an item in a
    third of all orders, is one bit or one bitmap as any other, and nothing that
    grows with the users or the orders passes the driver.  Where neither owned
    sets nor orders repeat, the work still grows with classes times orders.
    """
    codes = _codes(ds)
    lines = (ds.order_products_prior.select("order_id", "product_id").where(F.col("order_id").isNotNull())
             .join(codes, "product_id").select("order_id", F.col("code").alias("product_id")))
    profile = basket_profile(ds.order_products_prior)
    user_orders = (ds.orders.join(users.select("user_id").distinct(), "user_id", "left_semi")
                   .select("order_id", "user_id").distinct())
    sets = written(join_baskets(lines, user_orders, profile=profile).select("user_id", "product_id").distinct()
                   .groupBy("user_id").agg(F.sort_array(F.collect_list("product_id")).alias("owned")), "owned")
    classes = written(sets.groupBy("owned").agg(F.min("user_id").alias("class_id")), "classes")
    members = written(sets.join(classes, "owned").select("user_id", "class_id"), "members")
    cands = (_strengths(_weighted_orders(ds, lines, profile), classes).withColumnRenamed("product_id", "code")
             .join(codes, "code").join(_dims(ds), "product_id"))
    best = Window.partitionBy("class_id").orderBy(F.col("association_strength").desc(), "product_id")
    kept = cands.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= n)
    # the rank of a kept row depends on rows of higher strength only, which are kept too
    w = Window.partitionBy("class_id").orderBy(F.col("association_strength").desc())
    ranked = written(kept.withColumn("rank", F.rank().over(w)), "ranked")
    return members.join(ranked, "class_id").select("user_id", "product_name", "product_id", "aisle", "department",
                                                   "association_strength", "rank")


def _codes(ds: Dataset) -> DataFrame:
    """(product_id, code): items by falling support have rising codes; written."""
    supports = pinned_supports(ds.order_products_prior)
    return written(supports.orderBy(F.col("support_count").desc(), "product_id")
                   .select("product_id", F.monotonically_increasing_id().alias("code")), "codes")


def _weighted_orders(ds: Dataset, lines: DataFrame, profile: BasketProfile) -> DataFrame:
    """Chunks of the orders, in which a row stands for ``2 ** power`` orders of the same items.

    So many equal orders are as many rows as their number has binary digits 1,
    never more than there are orders.  Oversized orders are rows of their own.
    """
    items = pinned_supports(ds.order_products_prior).count()
    split = profile.oversized
    normal = lines if split is None else lines.join(split.select("order_id"), "order_id", "left_anti")
    equal = (normal.groupBy("order_id").agg(F.sort_array(F.collect_set("product_id")).alias("_items"))
             .groupBy("_items").agg(F.count(F.lit(1)).alias("_times")))
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.bit_get("_times", b) == 1)
    chunks = _sorted_chunks(written(equal.select(F.explode(digits).alias("power"), "_items"), "equal-orders"), items)
    if split is None:
        return chunks
    large = lines.join(split.select("order_id"), "order_id")
    return chunks.unionByName(chunk_table(large, "order_id", "product_id", split.count(), items))


def _sorted_chunks(rows: DataFrame, items: int) -> DataFrame:
    """``levelwise.chunk_table`` of ``(power, _items)`` rows, whose chunks are runs of the sorted rows."""
    size = max(64, min(2 * levelwise.CHUNK_BASKETS, 8 * levelwise.CHUNK_BYTES // max(1, items)))
    parts = max(1, math.ceil(rows.count() / (0.8 * size)))      # ranges come from a sample: room for uneven ones

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, count = None, [], 0
        for batch in batches:
            powers, lists = batch.column("power").to_numpy(), batch.column("_items")
            bounds = [0, *(np.flatnonzero(powers[1:] != powers[:-1]) + 1).tolist(), len(powers)]
            for start, stop in zip(bounds, bounds[1:]):
                while start < stop:
                    if held and (powers[start] != name or count == size):
                        yield levelwise._chunk(held, name)
                        held, count = [], 0
                    name, part = powers[start], lists.slice(start, min(stop - start, size - count))
                    rows_ = np.repeat(np.arange(count, count + len(part)), part.value_lengths().to_numpy())
                    held.append((rows_, part.flatten().to_numpy()))
                    start, count = start + len(part), count + len(part)
        if held:
            yield levelwise._chunk(held, name)

    ranges = rows.repartitionByRange(parts, "power", "_items").sortWithinPartitions("power", "_items")
    with arrow_rows(rows.sparkSession, 10_000):
        return written(ranges.mapInArrow(run, "items binary, words int, bitmaps binary, power int"), "chunks")


def _blocks(classes: DataFrame) -> DataFrame:
    """``(block, classes, sizes, owned)``: about ``OWNED_ROWS`` owned items of some classes in a row; written."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owned = batch.column("class_id").to_numpy(), batch.column("owned")
            sizes = owned.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            flat = owned.flatten().to_numpy()
            part = (ends - sizes) // OWNED_ROWS
            bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            for start, stop in zip(bounds, [*bounds[1:], len(part)]):
                pieces = (ids[start:stop], sizes[start:stop], flat[ends[start] - sizes[start]:ends[stop - 1]])
                yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.int64).tobytes()], pa.binary()) for p in pieces],
                                                 ["classes", "sizes", "owned"])

    with arrow_rows(classes.sparkSession, 10_000):
        return written(classes.mapInArrow(run, "classes binary, sizes binary, owned binary")
                       .withColumn("block", F.monotonically_increasing_id()), "blocks")


def _strengths(chunks: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, product_id, association_strength) of all items that a class doesn't own.

    A cell of the grid is a block and one of ``groups`` parts of the chunks;
    there are more groups where few blocks would leave tasks idle.
    """
    spark, blocks = classes.sparkSession, _blocks(classes)
    count, tasks = blocks.count(), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.ceil(tasks / max(1, count)))
    every = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    part = F.pmod(F.xxhash64("power", "bitmaps"), F.lit(groups)).cast("int")
    met = chunks.withColumn("group", part).crossJoin(blocks.select("block"))
    cells = (every.unionByName(met, allowMissingColumns=True).withColumn("_later", F.col("bitmaps").isNotNull())
             .repartition(max(tasks, count * groups), "block", "group").sortWithinPartitions("block", "group", "_later"))
    with arrow_rows(spark, CHUNK_ROWS):
        sums = written(cells.mapInArrow(_touching, "class_id long, product_id long, c long"), "sums")
    # dealt by the class alone, as the ranking needs them next
    return sums.repartition("class_id").groupBy("class_id", "product_id").agg(F.sum("c").alias("association_strength"))


def _touching(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell the strengths of all candidates of the block's classes over its chunks."""
    block, held, size = None, [], 0
    for batch in batches:
        for row in batch.select(["classes", "sizes", "owned", "items", "words", "bitmaps", "power"]).to_pylist():
            if row["classes"] is not None:
                if held:
                    yield from _sums(held, *block)
                block = [np.frombuffer(row[c], np.int64) for c in ("classes", "sizes", "owned")]
                held, size = [], 0
                continue
            held.append(_Orders(row["items"], row["words"], row["bitmaps"], row["power"]))
            size += held[-1].bitmaps.nbytes
            if size >= HELD_BYTES:
                yield from _sums(held, *block)
                held, size = [], 0
    if held:
        yield from _sums(held, *block)


class _Orders:
    """A chunk of orders: bitmaps per item, or lists of its lines where they are shorter."""

    def __init__(self, items: bytes, words: int, bitmaps: bytes, power: int):
        self.power = power
        self.items = np.frombuffer(items, np.int64)
        self.bitmaps = np.frombuffer(bitmaps, np.uint64).reshape(len(self.items), words)
        self.counts = np.bitwise_count(self.bitmaps).sum(axis=1, dtype=np.int64)
        self.every = np.bitwise_or.reduce(self.bitmaps, axis=0)     # the bits that are orders
        self.orders = int(np.bitwise_count(self.every).sum(dtype=np.int64))
        self.by_line = self.counts.sum() < self.bitmaps.size        # fewer lines than words: look at the lines
        if self.by_line:
            self.line_order = np.concatenate([np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
                                              for row in self.bitmaps])
            self.item_ends = np.cumsum(self.counts)
            self.line_item = np.repeat(np.arange(len(self.items)), self.counts)[np.argsort(self.line_order, kind="stable")]
            self.sizes = np.bincount(self.line_order, minlength=self.orders)
            self.starts = np.cumsum(self.sizes) - self.sizes
        else:
            self.runs = self._runs()

    def add(self, sums: np.ndarray, place: np.ndarray, sizes: np.ndarray, owned: np.ndarray) -> None:
        """Adds for every class (a row of ``sums``) and item the orders that hold it and an owned item.

        ``place`` are the columns of the chunk's items, ``sizes`` and ``owned`` the classes' items.
        """
        at = np.searchsorted(self.items, owned)
        here = self.items[np.minimum(at, len(self.items) - 1)] == owned
        at, row = at[here], np.repeat(np.arange(len(sizes)), sizes)[here]
        if not self.by_line:
            some, row = np.unique(row, return_inverse=True)
            found = self._words(len(some), at, row)
            sums[np.ix_(some, place)] += found << self.power
            return
        ends = np.searchsorted(row, np.arange(len(sizes)), side="right").tolist()
        for k in np.unique(row).tolist():
            sums[k, place] += self._lines(at[ends[k - 1] if k else 0:ends[k]]) << self.power

    def _lines(self, owned: np.ndarray) -> np.ndarray:
        """For every item the orders that hold it and one of the items at ``owned``."""
        touched = np.zeros(self.orders, bool)
        for i in owned.tolist():
            touched[self.line_order[self.item_ends[i] - self.counts[i]:self.item_ends[i]]] = True
        less = 2 * np.count_nonzero(touched) > self.orders          # there are fewer orders that it doesn't touch
        some = np.flatnonzero(~touched if less else touched)
        sizes = self.sizes[some]
        lines = np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = np.bincount(self.line_item[lines], minlength=len(self.items))
        return self.counts - found if less else found

    def _words(self, classes: int, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``_lines`` of many classes at once: class ``row[i]`` owns the item at ``at[i]``.

        Of a run of words, left are the classes that own none of the items which
        all its orders share.  A table of the ORs of eight items' words gives the
        orders that such a class touches; of the others the bits are counted,
        item by item.
        """
        items = len(self.items)
        own = np.zeros((-(-items // 8) * 8, classes), bool)
        own[at, row] = True
        eights = np.packbits(own, axis=0, bitorder="little")
        untouched = np.zeros((classes, items), np.int32)
        for start, stop, shared in self.runs:
            left = np.flatnonzero(~own[shared].any(axis=0))
            if not len(left):
                continue
            held = np.flatnonzero(self.bitmaps[:, start:stop].any(axis=1))
            found = np.zeros((items, len(left)), np.int32)
            owned = [(eight, eights[eight].take(left)) for eight in np.unique(held // 8).tolist()]
            step = max(1, min(512, PASSED_WORDS // len(left)))      # so that a count fits into 16 bits
            for first in range(start, stop, step):
                last = min(stop, first + step)
                words, touched = self.bitmaps[:, first:last], np.zeros((len(left), last - first), np.uint64)
                for eight, pattern in owned:
                    table = np.zeros((256, last - first), np.uint64)
                    for j, of_item in enumerate(words[8 * eight:8 * eight + 8]):
                        np.bitwise_or(table[:1 << j], of_item, out=table[1 << j:2 << j])
                    touched |= table.take(pattern, axis=0)
                others = np.ascontiguousarray((self.every[first:last] & ~touched).T)
                both, bits = np.empty_like(others), np.empty(others.shape, np.uint8)
                for i in held.tolist():
                    np.bitwise_and(others, words[i, :, None], out=both)
                    np.bitwise_count(both, out=bits)
                    found[i] += np.add.reduce(bits, axis=0, dtype=np.uint16)
            untouched[left] += np.ascontiguousarray(found.T)
        return self.counts - untouched

    def _runs(self) -> list:
        """``(start, stop, items)``: runs of words, cut where the items that their orders share change."""
        shared, firsts = self.bitmaps == self.every, []
        for _ in range(SHARED_ITEMS):
            firsts.append(np.where(shared.any(axis=0), shared.argmax(axis=0), -1))
            shared[firsts[-1], np.arange(shared.shape[1])] = False

        def cut(start: int, stop: int, depth: int) -> Iterator[tuple]:
            if depth == SHARED_ITEMS or stop - start <= RUN_WORDS // 2 or (firsts[depth][start:stop] < 0).all():
                yield start, stop, [int(f[start]) for f in firsts[:depth]]
                return
            of = firsts[depth][start:stop]
            bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(bounds, bounds[1:]):
                if of[a] < 0:
                    yield start + a, start + b, [int(f[start]) for f in firsts[:depth]]
                else:
                    yield from cut(start + a, start + b, depth + 1)

        return list(cut(0, len(self.every), 0))


def _sums(held: list, classes: np.ndarray, sizes: np.ndarray, products: np.ndarray) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(sizes)
    every = np.unique(np.concatenate([h.items for h in held]))
    block = max(1, SUM_CELLS // len(every))
    for first in range(0, len(classes), block):
        some = sizes[first:first + block]
        owned = products[ends[first] - sizes[first]:ends[first + len(some) - 1]]
        sums = np.zeros((len(some), len(every)), np.int64)
        for orders in held:                                         # one chunk at a time stays in the cache
            orders.add(sums, np.searchsorted(every, orders.items), some, owned)
        mine = np.searchsorted(every, owned)
        here = every[np.minimum(mine, len(every) - 1)] == owned
        sums[np.repeat(np.arange(len(some)), some)[here], mine[here]] = 0
        row, item = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(classes[first + row]), pa.array(every[item]), pa.array(sums[row, item])],
            ["class_id", "product_id", "c"])
