"""Near duplicates by SimHash: fingerprints that differ in few bits are linked.

1. A text's fingerprint has bit b set if more than half of its n-word shingles
   (repeats included) have bit b set in their XXH64.  Documents with the same
   fingerprint form a class; from here on one row stands for a class.
2. The 64 bits are cut into blocks.  Of r + e blocks two fingerprints within
   distance r agree on e at least, so in the table of some choice of e blocks
   both have the same key.  e follows from the number of classes, so that a key
   stays selective; every choice is exact.
3. The fingerprints of one key are compared bit-sliced: 64 of them make a block
   whose bit planes are stored vertically.  A fingerprint meets a whole block
   plane by plane; the 64 distances are kept in bitwise counters, to which two
   planes are added at a time by a carry-save adder, and a block is abandoned
   as soon as all its distances exceed the radius.  A key with many
   fingerprints is cut into parts, and pairs of parts are dealt out to tasks.
4. Of a key's links a spanning forest is kept (never all pairs), as trees with
   few links a member; the forests of all keys are closed to components.

Defined cases: null or empty texts, and texts without words, have the
fingerprint zero and are linked like any other; texts with fewer than n words
are one shingle; repeated rows share a class; a row with a null id takes the
smallest other id of its component, or null; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.graph import components, smallest_ids
from basketlens.llm.text import LOWER
from basketlens.session import written

SEED = 42                  # fixed: of the shingle hash
KEY_ROWS = 512             # classes a key should have at most, when keys are evenly filled
PART_ROWS = 4_096          # fingerprints of one key on one side of a comparison
PAIR_BLOCKS = 1 << 16      # (fingerprint, block) comparisons made at a time
CHECK_BITS = 8             # planes between two looks at which blocks can be abandoned
FANOUT = 64                # links a member passes down in a spanning tree
BATCH_SHINGLES = 1 << 15   # hashes turned into bits at a time
BATCH_ROWS = 512
ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints -------------------------------------------------------------

def shingle_hashes(text: bytes, n: int) -> list[int]:
    """XXH64 of the n-word shingles in text order; fewer words are one shingle, none have none."""
    words = text.translate(LOWER).split()      # bytes: between ASCII white space
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-n]]
    return [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1:])]


def majorities(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for every list of hashes: the bits set in over half of them."""
    out = np.zeros(len(hashes), np.uint64)
    weights = ONE << np.arange(64, dtype=np.uint64)
    counts = np.array([len(h) for h in hashes])
    filled = np.flatnonzero(counts)
    if len(filled):
        flat = np.fromiter((h for some in hashes for h in some), np.uint64, counts.sum())
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[filled]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        out[filled] = ((2 * sums > counts[filled, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(start, BATCH_ROWS)
                found, waiting, held = [], [], 0
                for text in piece.column("text"):
                    waiting.append(shingle_hashes(text.as_py() or b"", n))
                    held += len(waiting[-1])
                    if held >= BATCH_SHINGLES:
                        found.append(majorities(waiting))
                        waiting, held = [], 0
                found.append(majorities(waiting))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# -- bit-sliced comparison ------------------------------------------------------

def planes_of(fps: np.ndarray) -> np.ndarray:
    """[bit, block]: bit planes of blocks of 64 fingerprints (a multiple of 64 of them)."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def exceeding(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counted distance is above ``radius`` (``over``: those that left the counters)."""
    above, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def near_lanes(queries: np.ndarray, planes: np.ndarray, valid: np.ndarray, bits: list[int], radius: int):
    """Which of the 64 lanes are within ``radius`` of a fingerprint, for many comparisons at a time.

    ``queries[k]`` is compared with the block ``planes[:, k]``, of which the
    lanes ``valid[k]`` count, on the given bits.  Returns (k, lanes) of the
    comparisons that have near lanes.
    """
    width = radius.bit_length()
    at = np.arange(len(queries))
    counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
    over = ~valid                                     # lanes that don't count are out from the start

    def add(digit: np.ndarray, k: int) -> None:       # adds 2**k to the lanes in digit
        nonlocal over
        for j in range(k, width):
            counters[j], digit = counters[j] ^ digit, counters[j] & digit
        over = over | digit

    for done in range(0, len(bits), 2):
        if done and done % CHECK_BITS == 0:
            going = exceeding(counters, over, radius) != ALL
            if not going.all():
                at, over = at[going], over[going]
                counters = [c[going] for c in counters]
            if not len(at):
                break
        pair = bits[done:done + 2]
        differ = [planes[b, at] ^ (~((queries[at] >> np.uint64(b)) & ONE) + ONE) for b in pair]
        if len(pair) == 2 and width:
            x, y = differ
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)
            counters[0] = half ^ y
            add(carry, 1)
        else:
            for x in differ:
                add(x, 0)
    lanes = ~exceeding(counters, over, radius)
    some = lanes != 0
    return at[some], lanes[some]


class Forest:
    """Components of numbered members, joined in vectorized steps."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def find(self, k: int) -> int:
        while self.label[k] != k:
            self.label[k] = self.label[self.label[k]]
            k = self.label[k]
        return k

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for start in range(0, len(a), 1 << 14):
            x, y = self.label[a[start:start + (1 << 14)]], self.label[b[start:start + (1 << 14)]]
            for p, q in set(zip(x[x != y].tolist(), y[x != y].tolist())):
                p, q = self.find(p), self.find(q)
                if p != q:
                    self.label[max(p, q)] = min(p, q)
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def trees(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, its parent) in every component: members in order, each linked to an earlier one."""
        order = np.argsort(self.label, kind="stable")
        labels = self.label[order]
        first = np.searchsorted(labels, labels)                 # where the component begins
        place = np.arange(len(order)) - first
        below = np.flatnonzero(place > 0)
        return order[below], order[first[below] + (place[below] - 1) // FANOUT]


def forests(groups: list[tuple[np.ndarray, np.ndarray | None]], bits: list[int], radius: int):
    """Links (a, b) that join what is near, for several keys of one table together.

    A group is (fingerprints, None), compared among each other, or two sides
    that are compared with each other.
    """
    members, lane_fps, lane_ids, queries, query_ids, blocks, valid = [], [], [], [], [], [], []
    total = n_blocks = 0
    for left, right in groups:
        size = -(-len(left) // 64)
        padded = np.zeros(size * 64, np.uint64)
        padded[:len(left)] = left
        lane_fps.append(padded)
        lane_ids.append(np.minimum(np.arange(size * 64), len(left) - 1) + total)
        full = np.full(size, ALL)
        if len(left) % 64:
            full[-1] = (ONE << np.uint64(len(left) % 64)) - ONE
        if right is None:
            # a fingerprint meets the ones before it: whole blocks, and of its own the lanes before
            own = np.arange(len(left))
            upto = own // 64
            q, b = np.repeat(own, upto + 1), np.arange((upto + 1).sum()) - np.repeat(np.cumsum(upto + 1) - upto - 1, upto + 1)
            lanes = np.where(b < q // 64, ALL, (ONE << (q % 64).astype(np.uint64)) - ONE)
            some = lanes != 0
            q, b, lanes = q[some], b[some], lanes[some]
            queries.append(left[q])
            query_ids.append(q + total)
            members.append(left)
        else:
            q, b = np.repeat(np.arange(len(right)), size), np.tile(np.arange(size), len(right))
            lanes = full[b]
            queries.append(right[q])
            query_ids.append(q + total + len(left))
            members.append(np.concatenate([left, right]))
        blocks.append(b + n_blocks)
        valid.append(lanes)
        total += len(members[-1])
        n_blocks += size
    members, queries, query_ids, blocks, valid, lane_ids = map(
        np.concatenate, (members, queries, query_ids, blocks, valid, lane_ids))
    planes, forest = planes_of(np.concatenate(lane_fps)), Forest(total)
    for start in range(0, len(queries), PAIR_BLOCKS):
        some = slice(start, start + PAIR_BLOCKS)
        at, lanes = near_lanes(queries[some], planes[:, blocks[some]], valid[some], bits, radius)
        for k in range(0, len(at), 1 << 12):
            row, lane = np.nonzero(np.unpackbits(
                lanes[k:k + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            where = start + at[k:k + (1 << 12)][row]
            forest.join(query_ids[where], lane_ids[blocks[where] * 64 + lane])
    child, parent = forest.trees()
    return members[child], members[parent]


# -- tables -----------------------------------------------------------------------

def tables(classes: int, radius: int) -> list[int]:
    """Masks of the key bits: every choice of e out of radius + e blocks, e the least that keeps keys selective."""
    equal = 1
    while True:
        cuts = [64 * k // (radius + equal) for k in range(radius + equal + 1)]
        blocks = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(radius + equal)]
        masks = [sum(some) for some in combinations(blocks, equal)]
        if classes <= KEY_ROWS << min(m.bit_count() for m in masks) or radius + equal == 64:
            return masks
        equal += 1


def links(classes: DataFrame, radius: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(a, b): links between fingerprints (``fp``, distinct, a written table) whose closure joins all within ``radius``."""
    masks = tables(classes.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    index = classes.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("t", "mask"))
    index = index.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    # only keys with many fingerprints are listed; the planner broadcasts that list by its size
    hot = written(index.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
                  .where("parts > 1"), "hot")
    group = ["t", "key", "i", "j"]
    dealt = (index.join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("t", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                     "part", "fp")
             .repartition(*group).sortWithinPartitions(*group, "part", "fp"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, table = [], 0, None

        def flush():
            bits = [b for b in range(64) if not masks[table] >> b & 1]
            a, b = forests(waiting, bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for (t, _, i, j), parts, fps in _groups(batches):
            if i != j:
                cut = int(np.searchsorted(parts, j))
                sides = (fps[:cut], fps[cut:])
                if not len(sides[0]) or not len(sides[1]):
                    continue
            elif len(fps) > 1:
                sides = (fps, None)
            else:
                continue
            if waiting and (t != table or held >= PAIR_BLOCKS):
                yield flush()
                waiting, held = [], 0
            table = t
            waiting.append(sides)
            held += len(fps) * -(-len(fps) // 64)
        if waiting:
            yield flush()

    return dealt.mapInArrow(run, "a long, b long")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((t, key, i, j), parts, fingerprints) of every group in sorted batches."""
    name, parts, fps = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        part, fp = batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        fresh = np.zeros(batch.num_rows, bool)
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
        for start, stop in zip(bounds, bounds[1:]):
            here = tuple(int(c[start]) for c in columns)
            if here != name:
                if name is not None:
                    yield name, np.concatenate(parts), np.concatenate(fps)
                name, parts, fps = here, [], []
            parts.append(part[start:stop])
            fps.append(fp[start:stop])
    if name is not None:
        yield name, np.concatenate(parts), np.concatenate(fps)


def near_duplicates(docs: DataFrame, n: int = 5, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document.

    ``fingerprint`` has 16 hexadecimal digits; ``component_id`` is the smallest
    id reachable over fingerprints that differ in ``radius`` bits at most,
    itself included.

    Scale: texts are read once and never shuffled.  Copies cost one row in the
    comparison, however many there are; a fingerprint is shuffled once per
    table, as 20 bytes or so.
    """
    rows = written(fingerprints(docs, n, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    labels = components(written(links(classes.select("fp"), radius), "links"))
    return smallest_ids(rows, classes, labels).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
