"""Periodic runs, SimHash and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basketlens.llm import graph, lexical_search, periodic_runs, simhash
from basketlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
CLASH = ["fp", "m", "n", "t", "key", "part", "item", "block", "best", "runs", "start", "terms", "docs", "label", "component",
         "rank", "score", "item_id", "words", "_part"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


# -- 11 periodic runs -------------------------------------------------------------

def plain_runs(words, least=24, repeats=3):
    """(start, length, period) by extending every place of every period; the smallest period of a stretch stays."""
    found, n = {}, len(words)
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, repeats * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *best,
            hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_cover_has_every_difference():
    assert (periodic_runs.SYNC < periodic_runs.PERIOD).all()
    for i in range(periodic_runs.PERIOD):
        for j in range(periodic_runs.PERIOD):
            d = periodic_runs.SYNC[i, j]
            assert {(i + d) % periodic_runs.PERIOD, (j + d) % periodic_runs.PERIOD} <= set(periodic_runs.COVER)


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_texts_laid_end_to_end(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randrange(1, 6)):
        size, letters = rng.choice([0, 1, 23, 24, 80, 300]), rng.choice([1, 2, 3, 50])
        words = [rng.randrange(letters) for _ in range(size)]
        if size > 40:
            q, s = rng.randrange(1, size // 4 + 1), rng.randrange(size // 3)
            for i in range(s + q, min(size, s + q * rng.randrange(2, 9))):
                words[i] = words[i - q]
        texts.append(words)
    numbers, known, expected, at = [], 0, [], 0
    for words in texts:
        numbers.append(np.array(words, np.int64) + known + 1)
        known += max(words, default=0) + 1
        expected += [(s + at, length, p) for s, length, p in plain_runs(words)]
        at += len(words)
    found = periodic_runs.find_runs(np.concatenate(numbers), [len(t) for t in texts])
    assert [tuple(r) for r in found.tolist()] == sorted(expected, key=lambda r: (r[0], r[2]))


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(1, 4, 400), np.tile(rng.integers(1, 9, 37), 9)])
    lce = periodic_runs.CommonExtension(words)
    i, j = rng.integers(0, len(words), 3000), rng.integers(0, len(words), 3000)
    i, j = i[i != j], j[i != j]
    for a, b, found in zip(i.tolist(), j.tolist(), lce.extend(i, j).tolist()):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert found == k


def test_grid_in_pieces_is_the_same():
    whole = [np.concatenate(c) for c in zip(*periodic_runs.grid(5000, 24, 3))]
    pieces = [np.concatenate(c) for c in zip(*periodic_runs.grid(5000, 24, 3, points=100))]
    assert all((a == b).all() for a, b in zip(whole, pieces))


def test_periodic_runs_query(spark):
    """The whole table against brute force."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(plain_digest(r.doc_id, r.text) for r in rows)
    got = sorted(tuple(r) for r in Q.op11_periodic_runs(spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    assert got == expected
    assert sum(r[1] > 0 for r in got) >= 15


def test_periodic_runs_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(40_000))
    texts = [None, "", " \n\t", "a", " ".join("a" * 23), " ".join("a" * 24), "a b " * 12, long, long, "é " * 30 + "x y " * 24]
    frame = docs(spark, texts).withColumns({c: F.lit("clash") for c in CLASH})
    frame = frame.unionByName(frame.limit(0)).withColumn("doc_id", F.when(F.col("doc_id") != 6, F.col("doc_id")))
    rows = periodic_runs.periodic_runs(frame).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    assert [[tuple(x) for x in by[k].runs] for k in (0, 1, 2, 3, 4)] == [[]] * 5
    assert [tuple(x) for x in by[5].runs] == [(0, 24, 1)] and by[5].collapsed == "a"
    assert [tuple(x) for x in by[None].runs] == [(0, 24, 2)] and by[None].collapsed == "a b"
    assert [tuple(x) for x in by[7].runs] == [(0, 40_000, 5000)] and by[8].runs == by[7].runs
    assert [tuple(x) for x in by[9].runs] == [(0, 30, 1), (30, 24, 1)] and by[9].collapsed == "é x y"
    assert by[0].collapsed == "" and by[2].n_words == 0
    digest = periodic_runs.digest(periodic_runs.with_planted_runs(frame))
    assert {r.doc_id for r in digest.collect()} == set(by)
    assert periodic_runs.digest(frame.limit(0)).collect() == []


def test_strongest_run_breaks_ties_exactly(spark):
    rows = [(0, [(0, 300, 100), (5, 30, 10), (2, 30, 10)]), (1, [(0, 24, 7), (0, 25, 7), (9, 24, 6)]), (2, [])]
    frame = spark.createDataFrame(rows, f"doc_id long, runs {periodic_runs.RUNS}")
    found = {r.doc_id: r.best for r in frame.select("doc_id", periodic_runs.strongest(F.col("runs")).alias("best")).collect()}
    assert tuple(found[0]) == (0, 300, 100) and tuple(found[1]) == (9, 24, 6) and found[2] is None


# -- 12 SimHash ---------------------------------------------------------------------

def plain_fingerprint(text, n):
    lowered = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words)] if 0 < len(words) < n else [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, pairs):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_pairs(prints, radius):
    ids = list(prints)
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= radius]


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text, 4) for r in rows}
    label = plain_components(prints, near_pairs(prints, 4))
    got = Q.op12_simhash(spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", label[d]) for d, f in prints.items()}
    assert len(got) == len(rows) and len(set(label.values())) < len(set(prints.values()))


@pytest.mark.parametrize("seed", range(25))
def test_bit_sliced_links_join_what_is_near(seed):
    rng = random.Random(seed)
    radius, groups, near, ids = rng.choice([0, 1, 3, 4, 7]), [], [], set()
    for _ in range(rng.randrange(1, 5)):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(1, 6))]
        prints = set()
        for _ in range(rng.randrange(2, 200)):
            f = rng.choice(base)
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
        prints = sorted(prints)
        ids |= set(prints)
        cut = rng.randrange(1, len(prints)) if len(prints) > 2 and rng.random() < 0.5 else None
        if cut:
            groups.append((np.array(prints[:cut], np.uint64), np.array(prints[cut:], np.uint64)))
            near += [(a, b) for a in prints[:cut] for b in prints[cut:] if (a ^ b).bit_count() <= radius]
        else:
            groups.append((np.array(prints, np.uint64), None))
            near += near_pairs({p: p for p in prints}, radius)
    a, b = simhash.forests(groups, list(range(64)), radius)
    assert plain_components(ids, list(zip(a.tolist(), b.tolist()))) == plain_components(ids, near)
    assert len(a) < sum(len(x) + (0 if y is None else len(y)) for x, y in groups)


@pytest.mark.parametrize("classes", [0, 10 ** 5, 10 ** 7, 10 ** 10, 10 ** 13])
def test_tables_find_every_near_pair(classes):
    masks, rng = simhash.tables(classes, 4), random.Random(classes)
    assert min(m.bit_count() for m in masks) >= min(32, math.log2(max(1, classes)) - 10)
    for _ in range(200):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not differ & m for m in masks)


def test_simhash_hot_key_is_cut(spark):
    """One key with hundreds of classes, parts of 32: the same components as by brute force."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) for _ in range(500)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {(r.fp % (1 << 64), r.component % (1 << 64)) for r in
             graph.components(simhash.links(frame, 2, part_rows=32)).collect()}
    label = plain_components(prints, near_pairs({p: p for p in prints}, 2))
    of = dict(found)
    for a in prints:
        for b in prints:
            assert (label[a] == label[b]) == (of.get(a, a) == of.get(b, b))


def test_simhash_odd_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    texts = [None, "", " \n", "Word", "word", "a b c", "A b\tc", long, long, long.upper(), "other words that stand here alone"]
    frame = docs(spark, texts).withColumns({c: F.lit("clash") for c in CLASH})
    frame = frame.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    rows = {r.doc_id: r for r in simhash.near_duplicates(frame).collect()}
    assert len(rows) == len(texts)
    assert {rows[k].component_id for k in (0, 1, 2)} == {0} and rows[1].fingerprint == "0" * 16
    assert rows[4].component_id == 3 and rows[None].component_id == 6 == rows[6].component_id
    assert {rows[k].component_id for k in (7, 8, 9)} == {7} and rows[10].component_id == 10
    assert simhash.near_duplicates(frame.limit(0)).collect() == []


def test_hot_joins_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT_ROWS", 10)
    chain = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    labels = {r.fp: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert labels == {**{i: 100 for i in range(100, 181)}, **{i: 500 for i in range(500, 560)}}
    rows = spark.createDataFrame([(k % 3 if k % 5 else None, k) for k in range(200)], "k int, v int")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k int, name string")
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, graph.join_hot(rows, table, "k", how).collect())) == plain


# -- 13 ranked lexical search -----------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c.group().lower(), text or ""))


def plain_search(texts, items, k=10):
    """{item: [(doc_id, score)]} over all documents."""
    counts = {d: Counter(plain_terms(t)) for d, t in texts}
    counts = {d: c for d, c in counts.items() if c}
    total, words = len(counts), sum(sum(c.values()) for c in counts.values())
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for item, text in items:
        scores = Counter()
        for term in plain_terms(text):
            if df[term]:
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1)))
                for d, c in counts.items():
                    if c[term]:
                        m = 25 + 75 * sum(c.values()) * total // words
                        scores[d] += w * (10 ** 9 * c[term] // (1000 * c[term] + 8 * m))
        best = sorted(((-s, d) for d, s in scores.items() if s > 0))[:k]
        out[item] = [(d, -s) for s, d in best]
    return out


@pytest.mark.parametrize("blocks", [(1 << 19, 32, 4), (300, 2, 1)])
def test_search_equals_brute_force(spark, monkeypatch, blocks):
    """Many small blocks, ties, items that no document fits; visits in several groups."""
    for name, value in zip(("BLOCK_WORDS", "ORDERED_BLOCKS", "SEED_BLOCKS"), blocks):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(4)
    texts = [(d, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.choice([1, 8, 8, 8, 40, 200]))))
             for d in range(400)]
    texts += [(400 + k, texts[3][1]) for k in range(40)] + [(500, None), (501, "--- ...")]
    items = [(i, " ".join(f"W{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.choice([1, 3, 20])))) for i in range(30)]
    items += [(40, texts[3][1]), (41, "nothing-known"), (42, ""), (43, None)]
    frame = spark.createDataFrame(texts, DOC).repartition(5)
    got = {}
    for r in lexical_search.ranked(frame, spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    expected = {i: [(n + 1, d, s) for n, (d, s) in enumerate(rows)] for i, rows in plain_search(texts, items).items() if rows}
    assert {i: sorted(rows) for i, rows in got.items()} == expected


def test_search_in_parts_is_the_same(spark, monkeypatch):
    docs_frame = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = lexical_search.build(docs_frame)
    whole = sorted(map(tuple, lexical_search.search(index, items).collect()))
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 300)
    assert sorted(map(tuple, lexical_search.search(index, items).collect())) == whole


def test_index_holds_every_posting_by_stratum(spark):
    frame = docs(spark, ["a b a", "b c", "c a", None, "d " * 50, "a a a b"])
    index = lexical_search.build(frame)
    assert (index.documents, index.words) == (5, 61)
    rows = index.blocks.collect()
    assert sorted(r.m for r in rows) == sorted({25 + 75 * n * 5 // 61 for n in (3, 2, 50, 4)})
    found = set()
    for r in rows:
        tf, size, place = lexical_search.unpacked(r.groups, r.postings)
        term, impacts = np.repeat(np.arange(len(r.df)), r.df), np.repeat(tf, size)
        assert (np.diff(impacts)[np.diff(term) == 0] <= 0).all()
        found |= {(r.docs[p], bytes(r.terms[t]).decode(), int(f)) for p, t, f in zip(place, term, impacts)}
    assert found == {(0, "a", 2), (0, "b", 1), (1, "b", 1), (1, "c", 1), (2, "c", 1), (2, "a", 1), (4, "d", 50),
                     (5, "a", 3), (5, "b", 1)}


def test_low_bounds_are_not_visited(monkeypatch):
    """Blocks whose bound is below the last rank are left out, equal ones are not."""
    best = lexical_search.Best(2, np.zeros(1, np.int64))
    import pyarrow as pa
    best.add(0, np.array([5, 9, 9, 0]), pa.array([4, 7, 3, 1]))
    assert sorted(best.rows()) == [(0, 3, 9), (0, 7, 9)] and best.least[0] == 9
    best.add(0, np.array([8]), pa.array([0]))
    best.add(0, np.array([9, 9]), pa.array([5, None]))
    assert sorted(best.rows()) == [(0, 3, 9), (0, 5, 9)]


def test_search_odd_rows(spark):
    long = " ".join(f"w{i % 3000}" for i in range(30_000))
    rows = [(1, long), (1, long), (None, "rare words"), (2, "rare words"), (2, "rare words"), (3, None), (4, "!!!"), (5, "É é")]
    frame = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in CLASH if c != "text"})
    items = spark.createDataFrame([(0, "RARE"), (0, "RARE"), (None, "w7 w8"), (2, None), (3, "é")], "item_id long, text string")
    items = items.withColumns({c: F.lit(0) for c in CLASH if c != "item_id"})
    got = [tuple(r)[:3] for r in lexical_search.ranked(frame, items).collect()]
    assert sorted(got, key=str) == sorted(
        2 * [(0, 1, 2), (0, 2, 2), (0, 3, None)] + [(None, 1, 1), (None, 2, 1), (3, 1, 5)], key=str)
    assert lexical_search.ranked(frame.limit(0), items).collect() == []
    assert lexical_search.ranked(frame, items.limit(0)).collect() == []
