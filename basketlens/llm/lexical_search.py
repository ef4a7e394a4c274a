"""Ranked lexical search over a length-stratified index.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased.  A document of n terms has the normaliser
``m = 100 - 75 + 75 * n * N div L``; the score of a document for an item is the
sum of ``w * (10**9 * tf div (1000 * tf + 8 * m))`` over the item's terms,
repeats included, with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))``.  All but
the logarithm is integer arithmetic, so scores are exact.

Index: documents with equal m form a stratum.  A stratum of many words is cut
into blocks by a hash of the id; a block is one row of the index, which holds
its documents and, for every term, its postings grouped by tf, highest first.

Search: in a stratum a posting's impact depends on tf alone, so it is worked
out once per tf.  The greatest tf of every term bounds the score of a block for
an item.  First every item visits the block with its highest bound, which gives
the score its last rank has at least; then all tasks visit their blocks in the
order of the bounds and leave out those whose bound is below that score or
below the last rank found in the task itself.  A bound is never below a score
and equal scores are visited, so results are exact.

Defined cases: null or empty texts have no terms: such a document is in no
stratum and counts in neither N nor L, such an item has no results; terms that
no document holds add nothing; a repeated document is ranked each time, after
or before its equal; a repeated item has its results each time; ties go to the
smaller id, null ids last; empty tables give no rows; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.session import written

# Every ASCII character but letters and digits becomes a space, A-Z become a-z.
TERM_BYTES = bytes((c + 32 if 65 <= c <= 90 else c) if c > 127 or chr(c).isalnum() else 32 for c in range(256))

BLOCK_WORDS = 1 << 17        # terms of the documents of one index block; a longer document is alone
ITEM_TERMS = 1 << 18         # terms of the items that go to the tasks at a time; a longer item is alone
SEED_BLOCKS = 4              # blocks that every item visits first
ORDERED_BLOCKS = 32          # index blocks whose visits are ordered together ...
ORDERED_BYTES = 16 << 20     # ... as long as their packed postings take no more than this
VECTOR_ROWS = 256            # documents, and ...
INDEX_ROWS = 16              # ... index blocks that a task receives at a time

BLOCK = "m long, docs array<{id}>, terms array<binary>, df array<int>, max_tf array<int>, groups int, postings binary"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, jobs hand their tasks this many rows at a time (the rows are long)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


# -- index ------------------------------------------------------------------------

@dataclass(frozen=True)
class Index:
    """``blocks``: one row per block; ``documents`` (N) and ``words`` (L) of the collection."""
    blocks: DataFrame
    documents: int
    words: int


def _vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs): the distinct terms of a document, joined by spaces, and their counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                sizes, terms, tfs = [], [], []
                for text in piece.column("text"):
                    counts = Counter(terms_of(text.as_py() or b""))
                    terms.append(b" ".join(counts))
                    numbers = np.fromiter(counts.values(), np.int32, len(counts))
                    sizes.append(int(numbers.sum()))
                    tfs.append(numbers.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
                     pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n long, terms binary, tfs binary").where("n > 0")


def _block(m: int, ids: list, terms: list[bytes], tfs: list[bytes]) -> list:
    """One index row: documents by id (null last), postings by term, then tf (highest first), then place."""
    known: dict[bytes, int] = {}
    by_id = sorted(range(len(ids)), key=lambda k: (ids[k] is None, 0 if ids[k] is None else ids[k]))
    ids, split, tfs = [ids[k] for k in by_id], [terms[k].split() for k in by_id], [tfs[k] for k in by_id]
    term = np.fromiter((known.setdefault(t, len(known)) for some in split for t in some), np.int64,
                       sum(map(len, split)))
    tf = np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
    place = np.repeat(np.arange(len(ids)), [len(some) for some in split])
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    fresh = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    numbers = np.concatenate([tf[fresh], np.diff(np.append(fresh, len(term))), place])
    return [m, ids, list(known), np.diff(np.append(first, len(term))).tolist(), tf[first].tolist(),
            len(fresh), zlib.compress(numbers.astype(np.int32).tobytes(), 1)]


def unpacked(groups: int, postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tf, size) of the groups of equal tf, in the order of the terms, and the places of all postings."""
    numbers = np.frombuffer(zlib.decompress(postings), np.int32)
    return numbers[:groups].astype(np.int64), numbers[groups:2 * groups], numbers[2 * groups:]


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents, as a written table.

    Texts are read once.  Their term counts are written, then dealt to the
    blocks of their strata, so a stratum that holds much of the collection is
    spread over as many blocks as its words need.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    vectors = written(_vectors(rows), "vectors")
    lengths = written(vectors.groupBy("n").agg(F.count(F.lit(1)).alias("docs")), "lengths")
    documents, words = lengths.agg(F.coalesce(F.sum("docs"), F.lit(0)),
                                   F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0))).first()
    m = F.expr(f"100L - 75L + ((75L * n * {documents}L) div {max(words, 1)}L)")
    hot = written(lengths.groupBy(m.alias("m")).agg(F.sum(F.col("n") * F.col("docs")).alias("held"))
                  .where(F.col("held") > BLOCK_WORDS)
                  .select("m", F.ceil(F.col("held") / BLOCK_WORDS).cast("int").alias("parts")), "strata")
    dealt = (vectors.withColumn("m", m).join(hot, "m", "left")
             .withColumn("block", F.pmod(F.xxhash64("doc_id", "terms"), F.coalesce("parts", F.lit(1))).cast("int"))
             .select("m", "block", "doc_id", "terms", "tfs").repartition("m", "block").sortWithinPartitions("m", "block"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = BLOCK.format(id=id_type)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, types = None, [[], [], []], pa.null()

        def answer():
            row = _block(name[0], *held)
            kinds = [pa.int64(), pa.list_(types), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                     pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            types = batch.column("doc_id").type
            for m, block, doc, terms, tfs in zip(*(batch.column(c) for c in ("m", "block", "doc_id", "terms", "tfs"))):
                if (m.as_py(), block.as_py()) != name:
                    if name is not None:
                        yield answer()
                    name, held = (m.as_py(), block.as_py()), [[], [], []]
                for values, value in zip(held, (doc, terms, tfs)):
                    values.append(value.as_py())
        if name is not None:
            yield answer()

    with arrow_rows(docs.sparkSession, VECTOR_ROWS):
        blocks = written(dealt.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "index")
    return Index(blocks, int(documents), int(words))


# -- search -----------------------------------------------------------------------

def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


class Queries:
    """Items in a task: each one's distinct terms with their weights, repeats counted in."""

    def __init__(self, terms: list[bytes], starts: np.ndarray, columns: np.ndarray, weights: np.ndarray,
                 least: np.ndarray):
        self.terms = pa.array(terms, pa.binary())
        self.starts, self.columns, self.weights = starts, columns, weights
        self.least = least      # the score that the last rank has at least, known beforehand

    def bounds(self, top: np.ndarray) -> np.ndarray:
        """For every item the greatest score that the greatest impacts of the terms allow."""
        sums = np.concatenate([[0], np.cumsum(self.weights * top[self.columns])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def places(self, batch: pa.RecordBatch, k: int) -> np.ndarray:
        """Where the terms stand in the vocabulary of a block, -1 for those it lacks."""
        found = pc.index_in(self.terms, value_set=batch.column("terms")[k].values)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def tops(self, batch: pa.RecordBatch, k: int, places: np.ndarray) -> np.ndarray:
        """The greatest impact of every term in a block."""
        tf = np.append(batch.column("max_tf")[k].values.to_numpy(zero_copy_only=False), 0).astype(np.int64)
        return impact(tf[places], batch.column("m")[k].as_py())


class Block:
    """The postings of a block for the terms that the items ask for."""

    def __init__(self, batch: pa.RecordBatch, k: int, places: np.ndarray):
        tf, sizes, self.positions = unpacked(batch.column("groups")[k].as_py(), batch.column("postings")[k].as_py())
        self.docs = batch.column("docs")[k].values
        self.impacts = np.repeat(impact(tf, batch.column("m")[k].as_py()), sizes)      # once per tf of a term
        df = batch.column("df")[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(np.cumsum(df), 0)          # place -1: the empty slice
        self.stops = ends[places]
        self.starts = np.where(places < 0, 0, self.stops - np.append(df, 0)[places])

    def scores(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.docs), np.int64)
        for column, weight in zip(columns.tolist(), weights.tolist()):
            some = slice(self.starts[column], self.stops[column])
            total[self.positions[some]] += weight * self.impacts[some]
        return total


class Best:
    """The ``k`` best (score, document) of every item seen in a task."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.heaps: dict[int, list] = {}
        self.count = 0

    def add(self, item: int, scores: np.ndarray, docs: pa.Array) -> None:
        heap = self.heaps.setdefault(item, [])
        good = np.flatnonzero(scores >= max(1, self.least[item]))
        for place in good[np.argsort(-scores[good], kind="stable")[:self.k]].tolist():   # equals: by place, so by id
            doc = docs[place].as_py()
            self.count += 1
            entry = (int(scores[place]), _Last(doc), self.count)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = max(self.least[item], heap[0][0])

    def rows(self) -> list[tuple]:
        return [(item, entry[1].doc, entry[0]) for item, heap in self.heaps.items() for entry in heap]


class _Last:
    """Orders documents for a heap: the greatest id is the least entry, null below all."""
    __slots__ = ("doc",)

    def __init__(self, doc):
        self.doc = doc

    def __eq__(self, other):
        return self.doc == other.doc

    def __lt__(self, other):
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, size, terms, counts); ``item`` numbers the rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t or b"")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([len(c) for c in found], pa.int64()),
                 pa.array([list(c) for c in found], pa.list_(pa.binary())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                ["item_id", "size", "terms", "counts"])

    id_type = items.schema["item_id"].dataType.simpleString()
    return written(items.mapInArrow(run, f"item_id {id_type}, size long, terms array<binary>, counts array<long>")
                   .where("size > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def _parts(items: DataFrame) -> list[DataFrame]:
    """The items in parts of at most ``ITEM_TERMS`` terms (or one item): what goes to the tasks at a time."""
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // ITEM_TERMS)) if total > ITEM_TERMS else 1
    while True:
        part = F.pmod(F.xxhash64("item"), F.lit(count)).alias("part")
        most = (items.groupBy(part).agg(F.sum("size").alias("terms"), F.count(F.lit(1)).alias("items"))
                .where((F.col("terms") > ITEM_TERMS) & (F.col("items") > 1)))
        if count == 1 and total <= ITEM_TERMS or most.isEmpty():
            break
        count *= 2
    if count == 1:
        return [items] if total else []
    dealt = written(items.withColumn("part", part), "parts")
    return [dealt.where(F.col("part") == k).drop("part") for k in range(count)]


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest score above 0 of every item.

    Scale: the index is read once for its bounds and once for the visits;
    nothing but ``k`` rows per task and item is shuffled.  To the tasks go the
    items, in parts of bounded size; to the driver one score per item of a part.
    """
    asked = _item_terms(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text")))
    with arrow_rows(items.sparkSession, INDEX_ROWS):
        found = [_search_part(index, part, k) for part in _parts(asked)]
    id_type = index.blocks.schema["docs"].dataType.elementType.simpleString()
    if not found:
        empty = items.sparkSession.createDataFrame([], f"item long, doc_id {id_type}, score long")
        found = [empty]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_part(index: Index, items: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score), written: what the tasks find; holds the ``k`` best of every item."""
    spark = items.sparkSession
    wanted = items.select(F.explode("terms").alias("term")).distinct()
    df = (index.blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t"))
          .select(F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
          .join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")))
    weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * index.documents + 2) / (2 * r["df"] + 1)))
               for r in df.collect()}                 # at most the terms of a part
    names, starts, columns, values, spots = [], [0], [], [], {t: i for i, t in enumerate(weights)}
    for r in items.select("item", "terms", "counts").collect():      # a part
        known = [(bytes(t), c) for t, c in zip(r["terms"], r["counts"]) if bytes(t) in spots]
        names.append(r["item"])
        columns += [spots[t] for t, _ in known]
        values += [weights[t] * c for t, c in known]
        starts.append(len(columns))
    shared = lambda least: spark.sparkContext.broadcast((
        list(weights), np.array(starts), np.array(columns, np.int64), np.array(values, np.int64), least))
    least = np.zeros(len(names), np.int64)

    plain = shared(least)
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    seeds = (index.blocks.select("block", "m", "terms", "max_tf")
             .mapInArrow(_bounds(plain), "item int, block long, bound long")
             .withColumn("n", F.row_number().over(best)).where(F.col("n") <= SEED_BLOCKS).select("item", "block"))
    asked: dict[int, list[int]] = {}
    for r in seeds.collect():                          # SEED_BLOCKS for each item of the part
        asked.setdefault(r["block"], []).append(r["item"])
    id_type = index.blocks.schema["docs"].dataType.elementType.simpleString()
    answer = f"item int, doc_id {id_type}, score long"
    chosen = F.broadcast(spark.createDataFrame([(b,) for b in asked], "block long"))   # of that size at most
    first = index.blocks.join(chosen, "block", "left_semi").mapInArrow(
        _visits(plain, k, spark.sparkContext.broadcast(asked)), answer)
    rank = Window.partitionBy("item").orderBy(F.desc("score"))
    last = first.select("item", "score", F.row_number().over(rank).alias("n")).where(F.col("n") == k)
    for r in last.collect():                           # one score for each item of the part
        least[r["item"]] = r["score"]
    table = spark.createDataFrame(list(enumerate(names)), "number int, item long")
    rows = index.blocks.mapInArrow(_visits(shared(least), k), answer).withColumnRenamed("item", "number")
    return written(rows.join(table, "number").select("item", "doc_id", "score"), "found")


def _bounds(shared):
    """Per task and item the block with the highest bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best, where = Queries(*shared.value), None, None
        for batch in batches:
            for k in range(batch.num_rows):
                bounds = queries.bounds(queries.tops(batch, k, queries.places(batch, k)))
                block = batch.column("block")[k].as_py()
                if best is None:
                    best, where = np.zeros(len(bounds), np.int64), np.zeros(len(bounds), np.int64)
                where[bounds > best] = block
                best = np.maximum(best, bounds)
        if best is not None:
            some = np.flatnonzero(best)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(where[some]), pa.array(best[some])],
                                             ["item", "block", "bound"])
    return run


def _visits(shared, k: int, chosen=None):
    """Visit blocks, those with high bounds first; ``chosen`` names the items that ask for a block (None: all do)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kind = Queries(*shared.value), pa.null()
        best = Best(k, queries.least)

        def visit(held: list[tuple]) -> None:
            """Of every item the held blocks, highest bound first."""
            opened: dict[int, Block] = {}
            bounds = np.stack([b for _, _, _, b in held])          # [block, item]
            for item in np.flatnonzero((bounds > 0).any(axis=0)).tolist():
                some = slice(queries.starts[item], queries.starts[item + 1])
                for n in np.argsort(-bounds[:, item], kind="stable").tolist():
                    if bounds[n, item] < max(1, best.least[item]):
                        break
                    if n not in opened:
                        opened[n] = Block(*held[n][:3])
                    best.add(item, opened[n].scores(queries.columns[some], queries.weights[some]), opened[n].docs)

        held, weight = [], 0
        for batch in batches:
            kind = batch.column("docs").type.value_type
            for row in range(batch.num_rows):
                places = queries.places(batch, row)
                bounds = queries.bounds(queries.tops(batch, row, places))
                if chosen is not None:
                    only = np.zeros(len(bounds), bool)
                    only[chosen.value[batch.column("block")[row].as_py()]] = True
                    bounds = np.where(only, bounds, 0)
                if not (bounds >= np.maximum(1, best.least)).any():
                    continue
                held.append((batch, row, places, bounds))
                weight += batch.column("postings")[row].as_buffer().size
                if len(held) >= ORDERED_BLOCKS or weight >= ORDERED_BYTES:
                    visit(held)
                    held, weight = [], 0
        if held:
            visit(held)
        rows = best.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                              pa.array([r[1] for r in rows], kind),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index ``docs`` and search them for all ``items``."""
    return search(build(docs), items, k)
