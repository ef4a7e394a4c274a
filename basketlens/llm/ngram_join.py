"""Similarity self-join of documents on n-gram sets (Jaccard), by prefix trees.

1. Every text becomes a set of hashed word n-grams.  Rows with the same set
   form a class; from here on one row stands for a class.
2. All sets are put into one global order, rare n-grams first.  The order comes
   from a sketch of n-gram counts over all documents: an n-gram's rank is the
   count of its cell, then its hash.  Any such function orders all sets alike,
   so collisions cost selectivity, never a link.
3. Two sets that are similar enough share an n-gram of their prefixes.  Prefix
   n-grams with one class are dropped; the rest say who may meet whom.
4. Star step: every class is compared with the most central class it shares
   prefix n-grams with.  That joins groups of near copies without comparing
   all their pairs.
5. Trie step, for what the stars leave apart: the classes that share an n-gram
   but lie in different components are stored in a trie of their ordered
   prefixes; each class walks the trie, carrying the overlap that a whole
   subtree shares, and leaves subtrees whose remaining lengths can't reach the
   threshold.  Pairs inside one component need no test: it is one already.
6. Pairs are verified on the whole sets; links are closed to components.

Defined cases: null or empty texts, and texts without words, have the empty
set and link with nothing (their component is their own id); shorter texts
than n words are one n-gram; repeated rows share a class; a row with a null id
takes the smallest other id of its component, or null; an empty table gives no
rows.  Hashes have 64 bits; equality of n-grams is equality of their hashes.
"""

from __future__ import annotations

import math
import zlib
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.graph import components, smallest_ids
from basketlens.llm.text import CACHED_WORDS, WordHashes, distinct, lower_ascii, shingle_hashes, slices, spaced_words, texts
from basketlens.session import written

# Engineering limits.
MIN_CELL_BITS, MAX_CELL_BITS = 20, 25   # size of the count sketch (4 bytes a cell in a task, one in the merged ranks)
PAGE_CELLS = 1 << 16                    # cells of a page of the sketch
STEP_PAGES = 256                        # pages added in one step; more are added in two
RUN_ROWS = 50_000                       # classes of one n-gram that one task sees in the star step
STAR_SHARE = 0.3                        # of the shorter prefix that a class shares with its star's centre
BLOCK_ROWS = 2_000                      # classes of one side of a trie
GROUP_ROWS = 5_000                      # classes compared with one leader in one task
BITMAP_BYTES = 4096                     # fixed: what bitmap_construct_agg returns
SIZE_BITS = 40                          # of ``info`` that hold the size of a set


def needed_overlap(size: int, other: int, percent: int) -> int:
    """Least intersection with which two sets of these sizes are similar enough."""
    return -(-percent * (size + other) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def gram_set(text: str, n: int, known: WordHashes) -> np.ndarray:
    return distinct(shingle_hashes(spaced_words(lower_ascii(text)), n, known))


def class_id(grams: np.ndarray) -> int:
    """Identity of a set: a hash of all its members, signed for Spark; 0 is kept for the empty set."""
    value = xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams)) if len(grams) else 0
    return value - (1 << 64) if value >= 1 << 63 else value


# -- passes over the texts -----------------------------------------------------

def _census(docs: DataFrame, n: int, cells: int) -> DataFrame:
    """(doc_id, n_shingles, fp) of every row, and per task the pages (``page``, ``counts``) of its sketch."""
    id_type = docs.schema["doc_id"].dataType
    pages = cells // PAGE_CELLS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, ids = WordHashes(), np.zeros(cells, np.uint32), None
        for batch, values in texts(batches, "text"):
            ids, sizes, fps, seen = batch.column("doc_id"), [], [], []
            for text in values:
                grams = gram_set(text, n, known)
                sizes.append(len(grams))
                fps.append(class_id(grams))
                seen.append(grams)
            if seen:
                np.add.at(counts, np.concatenate(seen) & np.uint64(cells - 1), 1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.nulls(len(sizes), pa.int32()),
                 pa.nulls(len(sizes), pa.binary())], ["doc_id", "n_shingles", "fp", "page", "counts"])
        if ids is not None:
            for page in np.flatnonzero(counts.reshape(pages, -1).any(axis=1)).tolist():
                some = np.minimum(counts[page * PAGE_CELLS:(page + 1) * PAGE_CELLS], 255).astype(np.uint8)
                blob = zlib.compress(some.tobytes(), 1)      # frequent enough at 255 in one task
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                     pa.array([page], pa.int32()), pa.array([blob], pa.binary())],
                    ["doc_id", "n_shingles", "fp", "page", "counts"])

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, n_shingles long, fp long, page int, counts binary")


def _added_pages(rows: DataFrame, *keys: str, ranked: bool = False) -> DataFrame:
    """(page, counts): the pages of each key added up, one at a time; at last as ranks (uint8, logarithmic)."""
    rows = rows.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None

        def answer():
            blob = np.minimum(np.log2(total + 1.0) * 4, 126).astype(np.uint8).tobytes() if ranked else total.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int32()), pa.array([zlib.compress(blob, 1)], pa.binary())],
                                              ["page", "counts"])

        for batch in batches:
            for *key, blob in zip(*(batch.column(c) for c in (*keys, "counts"))):
                key = [k.as_py() for k in key]
                if key != name:
                    if name is not None:
                        yield answer()
                    name, total = key, np.zeros(PAGE_CELLS, np.uint32)
                cells = zlib.decompress(blob.as_py())
                total += np.frombuffer(cells, np.uint8 if len(cells) == PAGE_CELLS else np.uint32)
        if name is not None:
            yield answer()

    return rows.mapInArrow(run, "page int, counts binary")


def _ranks(census: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch as ranks: ``cells`` bytes, whatever the input.

    The tasks' pages are added in Spark, those of many tasks in two steps;
    only the ranks come to the driver.
    """
    pages = census.where(F.col("counts").isNotNull()).select("page", "counts")
    most = pages.groupBy("page").count().agg(F.max("count")).first()[0] or 0
    if most > STEP_PAGES:
        part = F.pmod(F.xxhash64("counts"), F.lit(math.ceil(most / STEP_PAGES))).cast("int")
        pages = _added_pages(pages.withColumn("part", part), "page", "part")
    out = np.zeros(cells, np.uint8)
    for row in _added_pages(pages, "page", ranked=True).toLocalIterator():
        out[row["page"] * PAGE_CELLS:(row["page"] + 1) * PAGE_CELLS] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out


def _prefixes(docs: DataFrame, n: int, percent: int, ranks) -> DataFrame:
    """(fp, info, prefix): the globally ordered prefix of each row's set.

    A prefix n-gram is one long, rank in the upper bits, so longs compare in
    the global order.  ``info`` holds the mean rank of the set (high for the
    text that many others are copies of) above its size.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), ranks.value
        mask = np.uint64(len(table) - 1)
        for _, values in texts(batches, "text"):
            out: dict[int, tuple] = {}
            for text in values:
                grams = gram_set(text, n, known)
                if not len(grams) or (fp := class_id(grams)) in out:
                    continue
                rank = table[grams & mask].astype(np.uint64)
                ordered = np.sort((rank << np.uint64(56)) | (grams >> np.uint64(8)))
                out[fp] = ((int(rank.mean() * 1000) << SIZE_BITS) + len(grams),
                           ordered[:prefix_length(len(grams), percent)].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out.keys(), pa.int64()), pa.array([v[0] for v in out.values()], pa.int64()),
                 pa.array([v[1] for v in out.values()], pa.list_(pa.int64()))], ["fp", "info", "prefix"])

    return docs.select("text").mapInArrow(run, "fp long, info long, prefix array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, n: int, cells: int) -> DataFrame:
    """(fp, grams) of the classes in ``wanted`` (doc_id, fp), from the text of one row each.

    Texts are not shuffled: a bitmap of the wanted ids' hashes (``cells`` bits)
    goes to all tasks, which skip the other rows.  Of rows that only share a
    bit some sets come along; the joins with ``wanted`` classes drop them.
    """
    spots = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("spot")
    page = 8 * BITMAP_BYTES
    bits = (wanted.select(spots).groupBy(F.floor(F.col("spot") / page).cast("int").alias("page"))
            .agg(F.bitmap_construct_agg(F.col("spot") % page).alias("bits")))
    pages = np.zeros((cells // page, BITMAP_BYTES), np.uint8)
    for r in bits.collect():   # cells / 8 bytes in all, whatever the number of ids
        pages[r["page"]] = np.frombuffer(r["bits"], np.uint8)
    shipped = docs.sparkSession.sparkContext.broadcast(pages.reshape(-1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chosen, seen = WordHashes(), np.unpackbits(shipped.value, bitorder="little").view(bool), set()
        for batch in slices(batches):
            batch = batch.filter(pa.array(chosen[batch.column("spot").to_numpy(zero_copy_only=False)]))
            pairs = []
            for text in batch.column("text").to_pylist():
                grams = gram_set(text or "", n, known)
                if len(grams) and (fp := class_id(grams)) not in seen:
                    pairs.append((fp, grams.tobytes()))
                    if len(seen) < CACHED_WORDS:
                        seen.add(fp)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                              pa.array([p[1] for p in pairs], pa.binary())], ["fp", "grams"])

    return docs.select(spots, "text").mapInArrow(run, "fp long, grams binary")


# -- links ----------------------------------------------------------------------

def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of sorted batches, group by group; the first ``keys`` columns name the group."""
    group: list[tuple] = []
    for batch in slices(batches):
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int, cells: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough.

    Pairs are grouped by ``a``: its set comes first and the others stream past
    it.  A class with many pairs is dealt out in groups of ``GROUP_ROWS``.
    """
    pairs = written(pairs.where("a <> b"), "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    others = (pairs.join(groups.where("parts > 1"), "a", "left")
              .select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"),
                      F.lit(1).alias("place"), F.col("b").alias("fp")))
    firsts = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                           F.lit(0).alias("place"), F.col("a").alias("fp"))
    members = written(others.unionByName(firsts), "members")
    wanted = reps.join(members.select("fp").distinct(), "fp")
    rows = (members.join(_sets(docs, wanted, n, cells), "fp").select("a", "part", "place", "fp", "grams")
            .repartition("a", "part").sortWithinPartitions("a", "part", "place"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, np.empty(0, np.uint64)
        for batch in slices(batches):
            keep = []
            for a, part, place, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "place", "grams"))):
                grams = np.frombuffer(blob, np.uint64)
                if (a, part) != group:
                    group, first = (a, part), grams if place == 0 else np.empty(0, np.uint64)
                if place == 0:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([first, grams]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("fp")], ["a", "b"])

    return written(rows.mapInArrow(run, "a long, b long").distinct(), "links")


def _size(info: str) -> Column:
    return F.pmod(F.col(info), F.lit(1 << SIZE_BITS))


def _rest(size: Column, percent: int) -> Column:
    """What stands behind the prefix of a set."""
    return F.ceil(size * percent / 100) - 1


def _star_pairs(grams: DataFrame, percent: int) -> DataFrame:
    """At most one candidate pair per class: with the leader it shares most prefix n-grams with.

    ``grams``: (w, salts, fp, info, leader).  Stars only save work: pairs that
    share less than ``STAR_SHARE`` of the shorter prefix are seldom similar and
    are left to the trie step.  A very frequent n-gram has many salts with a
    leader each; those are paired with the first.
    """
    size, other = _size("info"), F.pmod(F.col("best.leader.info"), F.lit(1 << SIZE_BITS))
    own = (grams.where(F.col("leader.fp") != F.col("fp")).groupBy("fp", "info", "leader").agg(F.count(F.lit(1)).alias("shared"))
           .groupBy("fp", "info").agg(F.max(F.struct("shared", "leader")).alias("best"))
           .where(F.col("best.shared") >= STAR_SHARE * F.least(size - _rest(size, percent), other - _rest(other, percent)))
           .select("fp", F.col("best.leader.fp").alias("leader")))
    heads = grams.where(F.col("salts") > 1).select("w", F.col("leader.fp").alias("fp")).distinct()
    heads = (heads.withColumn("leader", F.max("fp").over(Window.partitionBy("w")))
             .where(F.col("leader") != F.col("fp")).select("fp", "leader").distinct())
    return own.unionByName(heads).select(F.col("leader").alias("a"), F.col("fp").alias("b"))


class _Node:
    __slots__ = ("gram", "children", "ends", "deepest", "rest", "least")

    def __init__(self, gram: int):
        self.gram, self.children, self.ends = gram, {}, []
        self.deepest, self.rest, self.least = 0, 0, math.inf


def _insert(root: _Node, grams: list[int], member: tuple[int, int, int, int]) -> None:
    """Store one ordered set; every node on its path learns the bounds of its subtree."""
    node = root
    _, size, rest, _ = member
    for depth in range(len(grams) + 1):
        node.deepest = max(node.deepest, len(grams) - depth)
        node.rest = max(node.rest, rest)
        node.least = min(node.least, size)
        if depth < len(grams):
            node = node.children.setdefault(grams[depth], _Node(grams[depth]))
    node.ends.append(member)


def _probe(root: _Node, grams: list[int], member: tuple[int, int, int, int], percent: int) -> Iterator[int]:
    """Members of the trie that may be similar to ``member`` (fp, size, rest, component).

    The walk carries the overlap of the path so far, which its whole subtree
    shares.  What can still come is bounded by the shorter remaining prefix
    plus the part behind the prefixes; subtrees that can't get there are left.
    """
    _, size, rest, component = member
    stack = [(root, 0, 0)]
    while stack:
        node, at, overlap = stack.pop()
        if node is not root:
            while at < len(grams) and grams[at] < node.gram:
                at += 1
            if at < len(grams) and grams[at] == node.gram:
                at, overlap = at + 1, overlap + 1
        can_come = min(len(grams) - at, node.deepest) + max(rest, node.rest)
        if overlap + can_come < needed_overlap(size, node.least, percent):
            continue
        for other, other_size, other_rest, other_component in node.ends:
            if (other_component != component
                    and overlap + max(rest, other_rest) >= needed_overlap(size, other_size, percent)):
                yield other
        stack.extend((child, at, overlap) for child in node.children.values())


def _feasible(rows: list[tuple], percent: int) -> list[bool]:
    """Which rows (..., block, fp, n, component, place, tail) of one n-gram have a partner
    in another component by the lengths that remain from it on.

    If it is the first common n-gram of two sets, their overlap is at most the
    shorter remainder of the sets, and at most the shorter ``tail`` (what is
    left of the prefix n-grams that other classes have too) plus what stands
    behind the prefixes."""
    _, i, j = rows[0][:3]
    block, size, component, place, tail = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6, 7, 8))
    left, rest = size - place, -(-percent * size // 100) - 1
    out = np.zeros(len(rows), bool)
    for k in range(len(rows)):
        most = np.minimum(np.minimum(left, left[k]), np.minimum(tail, tail[k]) + np.maximum(rest, rest[k]))
        possible = (component != component[k]) & (most * (100 + percent) >= percent * (size + size[k]))
        if i != j:
            possible &= block != block[k]
        out[k] = possible.any()
    return out.tolist()


def _trie_pairs(grams: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) between components, from tries over blocks of classes.

    ``grams``: (w, fp, info, place) of shared prefix n-grams.  Only n-grams
    whose classes lie in several components are looked at, and of those only
    classes with a partner of fitting length.  A frequent n-gram is cut into
    blocks by hash; each pair of blocks is a group of its own, so nothing is
    left out and no task holds more than two blocks at a time.
    """
    tail = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("w"))).cast("long")   # a prefix at most
    rows = (grams.join(labels, "fp", "left")
            .select("w", "fp", _size("info").alias("n"), F.coalesce("component", "fp").alias("component"), "place",
                    tail.alias("tail")))
    rows = written(rows, "shared")
    open_grams = (rows.groupBy("w").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                        F.count(F.lit(1)).alias("members"))
                  .where("low < high").select("w", F.ceil(F.col("members") / BLOCK_ROWS).cast("int").alias("blocks")))
    group = ["w", "i", "j"]
    dealt = (rows.join(open_grams, "w")
             .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("w", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "fp", "n", "component", "place", "tail")
             .repartition(*group).sortWithinPartitions(*group))

    def fitting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for rows in _runs(batches, 3):
            fits = [r[:7] for r, ok in zip(rows, _feasible(rows, percent)) if ok]
            same = class_id(np.sort(np.array([r[4] for r in fits], np.int64)))
            kept += [(*r, same) for r in fits]
            if len(kept) > 10_000:
                yield _batch(kept, fit_schema)
                kept = []
        yield _batch(kept, fit_schema)

    fit_schema = pa.schema([("w", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()),
                              ("fp", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("same", pa.int64())])
    fit = dealt.mapInArrow(fitting, "w long, i int, j int, block int, fp long, n long, component long, same long")
    # of n-grams with the same members the first is the first common one of every pair: the others add nothing
    fit = written(fit.withColumn("first", F.min("w").over(Window.partitionBy("same", "fp", "i", "j")))
                  .where("w = first").drop("same", "first"), "fitting")
    lists = (rows.join(fit.select("fp").distinct(), "fp", "left_semi")
             .groupBy("fp").agg(F.sort_array(F.collect_list("w")).alias("grams")))   # a prefix at most
    members = (fit.join(lists, "fp")
               .select(*group, "block", "fp", "n", "component",
                       F.filter("grams", lambda g: g >= F.col("w")).alias("grams"))
               .repartition(*group).sortWithinPartitions(*group))

    def tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, 3):
            _, i, j = rows[0][:3]
            root, pairs = _Node(0), []
            known = [(r[3], r[7], (r[4], r[5], r[5] - prefix_length(r[5], percent), r[6])) for r in rows]
            for block, own, member in known:
                if block == i:
                    if i == j:
                        pairs += [(member[0], other) for other in _probe(root, own, member, percent)]
                    _insert(root, own, member)
            for block, own, member in known:
                if i != j and block == j:
                    pairs += [(member[0], other) for other in _probe(root, own, member, percent)]
            if pairs:
                yield _batch([(min(p), max(p)) for p in pairs], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return members.mapInArrow(tries, "a long, b long")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document.

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their
    sets of ``n``-word shingles (A-Z lower-cased, words between white space).
    ``component_id`` is the smallest id reachable by links, itself included.

    Scale: texts are read twice, plus once for each verification, where all
    rows but those of candidate pairs are skipped.  Shuffled are prefixes and
    the sets of candidate pairs, not texts.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    bits = math.ceil(math.log2(16 * max(1, docs.count())))
    cells = 1 << min(MAX_CELL_BITS, max(MIN_CELL_BITS, bits))
    census = written(_census(docs, n, cells), "census")
    ranks = spark.sparkContext.broadcast(_ranks(census, cells))      # `cells` bytes
    rows = census.where(F.col("counts").isNull()).select("doc_id", "n_shingles", "fp")
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")), "firsts")
    reps = firsts.where("n_shingles > 0").select("fp", "doc_id")

    classes = (_prefixes(docs, n, percent, ranks).groupBy("fp")
               .agg(F.first("info").alias("info"), F.first("prefix").alias("prefix")))
    index = classes.select("fp", "info", F.posexplode("prefix").alias("place", "w"))
    # the rank in an n-gram tells how many salts it needs
    salts = F.ceil(F.pow(F.lit(2.0), F.shiftright("w", 56) / 4) / RUN_ROWS).cast("int")
    index = index.withColumn("salt", F.when(salts > 1, F.pmod(F.xxhash64("fp"), salts)).otherwise(F.lit(0)).cast("int"))
    run = Window.partitionBy("w", "salt")
    grams = written(index.select("w", "fp", "info", "place", F.count(F.lit(1)).over(run).alias("members"),
                                 F.max(F.struct("info", "fp")).over(run).alias("leader"))
                    .withColumn("salts", salts).where("members > 1 or salts > 1").drop("members"), "grams")

    tested = written(_star_pairs(grams, percent).distinct(), "stars")
    stars = _verified(tested, docs, reps, n, percent, cells)
    labels = components(stars)
    tries = _trie_pairs(grams.select("w", "fp", "info", F.col("place").cast("long").alias("place")), labels, percent)
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))   # linked or not
    rest = _verified(tries.distinct().join(known, ["a", "b"], "left_anti"), docs, reps, n, percent, cells)
    if not rest.isEmpty():
        labels = components(stars.unionByName(rest))
    found = smallest_ids(rows, firsts.select("fp", "doc_id"), labels)
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id"))
                        .otherwise(F.col("doc_id")).alias("component_id"))
