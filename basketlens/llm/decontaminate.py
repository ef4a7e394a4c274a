"""Benchmark decontamination: containment search for short items in long documents.

Items are partitioned by size.  For the partition with sizes up to u every
document is read as overlapping windows of 2u shingles, one starting every u:
an item of that size that stands in the text lies in one window whole, so a
small containment in the document is a large similarity in the window.  Items
and windows are compared by one-permutation MinHash signatures (the least hash
in each bin); one equal entry makes a candidate, and the candidate is verified
by the exact share of the item's shingles that the document holds.

With a share of 0.8 the similarity to the window is 0.19 at least, so 128 bins
miss an item with a chance of 1e-11; below 64 shingles that many bins would not keep the
chance so low, so every hash has a bin of its own there: the signature of an
item of up to 32 shingles is its whole set.

Defined cases: items without words match nothing; items or documents with
fewer than n words are one shingle, the whole sequence, and match only an
equal one; null texts are empty; repeated items and rows give repeated pairs;
empty tables give no pairs.
"""

from __future__ import annotations

import uuid
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.graph import hash_bits, join_hot
from basketlens.llm.text import WORDS, WordHashes, distinct, shingle_hashes, texts
from basketlens.session import written

# Engineering limits.
SHIPPED_SHINGLES = 2_000_000   # item shingles that go to the tasks (16 MB, 24 MB more as entries); more are joined by a shuffle
LEAST_PARTITION = 8            # upper size of the smallest partition
PREFILTER_BITS = 20
ENTRY_BITS = 25                # of the bitmap of entry hashes that goes to the tasks in the shuffled search: 4 MB

PAIRS = "item_id {item}, n_item_shingles long, n_common long, containment double"


def partition_of(size: int) -> int:
    """Upper size of the partition: the next power of two."""
    return max(LEAST_PARTITION, 1 << (size - 1).bit_length())


def bins_shift(upper: int) -> np.uint64:
    """Hashes shifted by this many bits are bins: 2**32 of them below 64 shingles, else 128."""
    return np.uint64(32 if upper < 64 else 57)


def signature(grams: np.ndarray, upper: int) -> np.ndarray:
    """The least hash of every bin that has one."""
    ordered = np.unique(grams)
    return ordered[np.unique(ordered >> bins_shift(upper), return_index=True)[1]]


def _grams(text: str, n: int, known: WordHashes) -> np.ndarray:
    return shingle_hashes(WORDS.findall(text.lower()), n, known)


def _item_sets(items: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, values in texts(batches, "text"):
            sets = [distinct(_grams(t, n, known)) for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["item_id", "grams"])

    return (items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, grams array<long>")
            .where(F.size("grams") > 0))


class Search:
    """The items in a task, as a few arrays: their sets end to end, and the signature entries sorted by hash."""

    def __init__(self, ids: list, sizes: np.ndarray, grams: np.ndarray):
        self.ids, self.grams = ids, grams
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        entries, items = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for k in range(len(ids)):
            entries.append(signature(self.item(k), partition_of(int(sizes[k]))))
            items.append(np.full(len(entries[-1]), k, np.int32))
        hashes, items = np.concatenate(entries), np.concatenate(items)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]
        self.uppers = np.array([partition_of(int(n)) for n in sizes], np.int64)
        self.mask = np.uint64((1 << PREFILTER_BITS) - 1)
        self.maybe = np.zeros(1 << PREFILTER_BITS, bool)
        self.maybe[self.hashes & self.mask] = True

    def item(self, k: int) -> np.ndarray:
        return self.grams[self.starts[k]:self.ends[k]]

    def candidates(self, grams: np.ndarray) -> set[int]:
        """Items that share a signature entry with a window of their partition."""
        found: set[int] = set()
        places = np.flatnonzero(self.maybe[grams & self.mask])
        first, last = (np.searchsorted(self.hashes, grams[places], side) for side in ("left", "right"))
        some = first < last
        for at, low, high in zip(places[some].tolist(), first[some].tolist(), last[some].tolist()):
            h = grams[at]
            for k in self.items[low:high].tolist():
                upper = int(self.uppers[k])
                if k not in found and any(least_in_bin(grams, start * upper, upper, h)
                                          for start in {max(0, at // upper - 1), at // upper}):
                    found.add(k)
        return found

    def verified(self, grams: np.ndarray, percent: int) -> list[tuple]:
        out, own = [], None
        for k in sorted(self.candidates(grams)):
            own = distinct(grams) if own is None else own
            row = contained(self.item(k), own, percent)
            if row:
                out.append((self.ids[k], *row))
        return out


_BUILT: dict[str, Search] = {}   # of a Python worker, which serves many tasks: the search of the items it was last sent


def built(shipped) -> Search:
    name, ids, sizes, grams = shipped.value
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Search(ids, sizes, grams)
    return _BUILT[name]


def least_in_bin(grams: np.ndarray, start: int, upper: int, h: np.uint64) -> bool:
    """Whether ``h`` is in the signature of the window that starts at ``start``."""
    window = grams[start:start + 2 * upper]
    shift = bins_shift(upper)
    return window[(window >> shift) == (h >> shift)].min() == h


def contained(item: np.ndarray, document: np.ndarray, percent: int):
    """(size, common, share) if the document holds enough of the item's shingles."""
    common = int(np.isin(item, document).sum())
    return (len(item), common, common / len(item)) if 100 * common >= percent * len(item) else None


def _rows(batch: pa.RecordBatch, hits: list[tuple[int, tuple]], ids: str, out: pa.Schema) -> pa.RecordBatch:
    taken = batch.column(ids).take(pa.array([i for i, _ in hits], pa.int64()))
    columns = [pa.array([row[c] for _, row in hits], out.field(c + 1).type) for c in range(4)]
    return pa.RecordBatch.from_arrays([taken, *columns], schema=out)


def _search_shipped(docs: DataFrame, sets: DataFrame, n: int, percent: int, schema: str) -> DataFrame:
    """Every task has all items: one pass over the documents, no shuffle."""
    rows = sets.collect()   # at most SHIPPED_SHINGLES hashes, checked by the caller
    sizes = np.array([len(r["grams"]) for r in rows], np.int64)
    grams = np.fromiter((g for r in rows for g in r["grams"]), np.int64, sizes.sum()).astype(np.uint64)
    shipped = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["item_id"] for r in rows], sizes, grams))
    out = _arrow_schema(docs, sets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, search = WordHashes(), built(shipped)
        for batch, values in texts(batches, "text"):
            hits = [(i, row) for i, text in enumerate(values)
                    for row in search.verified(_grams(text, n, known), percent)]
            yield _rows(batch, hits, "doc_id", out)

    return docs.mapInArrow(run, schema)


def _search_joined(docs: DataFrame, sets: DataFrame, n: int, percent: int, schema: str) -> DataFrame:
    """Signatures of items and windows meet in a shuffle; for a benchmark of any size."""
    item_type = sets.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    sized = sets.withColumn("n", F.size("grams"))
    uppers = [r[0] for r in sized.select(F.greatest(F.lit(LEAST_PARTITION), F.pow(F.lit(2), F.ceil(F.log2("n"))))
                                         .cast("int")).distinct().collect()]   # one per power of two
    out = _arrow_schema(docs, sets)

    def of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, partition_of(len(g)), h) for i, g in zip(
                batch.column("item_id").to_pylist(), batch.column("grams").to_pylist())
                for h in signature(np.array(g, np.int64).astype(np.uint64), partition_of(len(g))).astype(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.column("item_id").type),
                 pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
                ["item_id", "upper", "h"])

    entries = written(sets.mapInArrow(of_items, f"item_id {item_type}, upper int, h long"), "entries")
    known_hashes = docs.sparkSession.sparkContext.broadcast(hash_bits(entries, "h", ENTRY_BITS))   # 4 MB, packed

    def of_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = WordHashes(), np.unpackbits(known_hashes.value, bitorder="little").view(bool)
        for batch, values in texts(batches, "text"):
            rows, sizes, found = [], [], [np.empty(0, np.uint64)]
            for i, text in enumerate(values):
                grams = _grams(text, n, known)
                for upper in uppers:
                    parts = [signature(grams[s:s + 2 * upper], upper) for s in range(0, len(grams), upper)]
                    hashes = np.unique(np.concatenate(parts)) if parts else grams
                    hashes = hashes[wanted[hashes & np.uint64((1 << ENTRY_BITS) - 1)]]
                    rows += [i] * len(hashes)
                    sizes += [upper] * len(hashes)
                    found.append(hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()),
                 pa.array(np.concatenate(found).astype(np.int64))], ["doc_id", "upper", "h"])

    # few hashes of a text are an item's; what many texts share is split
    key = F.struct("upper", "h").alias("key")
    windows = written(docs.mapInArrow(of_windows, f"doc_id {doc_type}, upper int, h long").select("doc_id", key), "windows")
    pairs = written(join_hot(windows, entries.select("item_id", key), "key").select("doc_id", "item_id").distinct(), "candidates")
    keyed = pairs.withColumnRenamed("doc_id", "_id")
    found = docs.join(keyed, docs["doc_id"].eqNullSafe(keyed["_id"])).drop("_id").withColumnRenamed("item_id", "_item")
    both = found.join(sets, found["_item"].eqNullSafe(sets["item_id"]))

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch, values in texts(batches, "text"):
            hits = []
            for i, (text, item, g) in enumerate(zip(values, batch.column("item_id").to_pylist(),
                                                    batch.column("grams").to_pylist())):
                row = contained(np.array(g, np.int64).astype(np.uint64), distinct(_grams(text, n, known)), percent)
                if row:
                    hits.append((i, (item, *row)))
            yield _rows(batch, hits, "doc_id", out)

    return both.select("doc_id", "text", "item_id", "grams").mapInArrow(verify, schema)


def _arrow_schema(docs: DataFrame, sets: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)),
                      ("item_id", to_arrow_type(sets.schema["item_id"].dataType)),
                      ("n_item_shingles", pa.int64()), ("n_common", pa.int64()), ("containment", pa.float64())])


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 shipped_shingles: int = SHIPPED_SHINGLES) -> DataFrame:
    """``(doc_id, item_id, n_item_shingles, n_common, containment)``: the pairs where
    the document holds ``percent`` per cent of the item's ``n``-word shingles or more.

    Scale: while the items' shingles number ``shipped_shingles`` at most (they
    are counted), they go to every task and the documents are read once,
    without a shuffle; a larger benchmark meets the windows' signatures in a
    shuffle, with the same pairs.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    sets = written(_item_sets(items, n), "items")
    types = [f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {types[0]}, " + PAIRS.format(item=types[1])
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    search = _search_shipped if total <= shipped_shingles else _search_joined
    return search(docs, sets, n, percent, schema)
