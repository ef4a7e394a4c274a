"""Corpus operators against brute force, on small tables made here."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import (decontaminate, licenses, mixing, ngram_join, quality_rules,
                            secrets, toxicity, url_filter, warc)
from basketlens.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None) for i, (t, s) in enumerate(zip(texts, sources))], DOC)


def random_words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# -- 1 decontamination ----------------------------------------------------------

def grams(text, n):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("shipped", [10 ** 9, 0])
def test_decontamination_finds_planted_items(spark, shipped):
    rng = random.Random(3)
    items = [" ".join(random_words(rng, n)) for n in (3, 5, 6, 12, 30, 60, 200, 700)] + ["", None]
    texts = [" ".join(random_words(rng, 900)) for _ in range(12)]
    for k, item in enumerate(items[1:8]):
        words = item.split()
        if k % 2:
            words[len(words) // 2] = "changed"       # enough of a long item is left
        texts[k] = " ".join(texts[k].split()[:300]) + " " + " ".join(words).upper() + "! " + texts[k]
    texts += [items[0], "", None, items[4]]
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_common) for r in decontaminate.contaminated(
        docs(spark, texts), table, shipped_shingles=shipped).collect()}
    expected = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            g = grams(item, 5)
            common = len(g & grams(t, 5))
            if g and 100 * common >= 80 * len(g):
                expected.add((i, j, common))
    assert found == expected
    assert len(expected) >= 7


def test_decontamination_splits_shingles_of_many_texts(spark, monkeypatch):
    """A passage of 400 texts is an item: its shingles are hot keys of the shuffled search; the pairs are the same."""
    from basketlens.llm import graph
    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    rng = random.Random(45)
    passage = " ".join(random_words(rng, 30))
    texts = [f"{' '.join(random_words(rng, rng.randrange(40)))} {passage if k % 4 else ''} w" for k in range(500)]
    items = spark.createDataFrame([(0, passage), (1, passage + " one more"), (2, " ".join(random_words(rng, 12)))],
                                  "item_id long, text string")
    pairs = [sorted((r.doc_id, r.item_id, r.n_common) for r in decontaminate.contaminated(
        docs(spark, texts), items, shipped_shingles=n).collect()) for n in (10 ** 9, 0)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 750


def test_decontamination_of_long_items_and_memory_of_the_search(spark):
    """Items of 300 and 5,000 shingles, whole, edited and cut; two million shingles fit into 150 MB of arrays."""
    import tracemalloc
    rng = random.Random(44)
    items = [" ".join(random_words(rng, n, 10 ** 6)) for n in (304, 5004, 304, 5004)]
    texts = []
    for item in items:
        words = item.split()
        edited = [w if i % 40 else "edit" for i, w in enumerate(words)]          # 7 of 8 shingles are left
        cut = words[: int(len(words) * 0.83)]
        for part in (words, edited, cut, words[: len(words) // 2]):
            around = random_words(rng, rng.randrange(20_000), 10 ** 6)
            at = rng.randrange(len(around) + 1)
            texts.append(" ".join(around[:at] + part + around[at:]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items)
                if 100 * len(grams(item, 5) & grams(t, 5)) >= 80 * len(grams(item, 5))}
    assert len(expected) == 12
    for shipped in (10 ** 9, 0):
        found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), table, shipped_shingles=shipped).collect()}
        assert found == expected
    hashes = np.random.default_rng(1).integers(0, 2 ** 63, 2_000_000).astype(np.uint64)
    tracemalloc.start()
    search = decontaminate.Search(list(range(40_000)), np.full(40_000, 50), hashes)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 150e6 and len(search.hashes) == len(search.items) > 1_000_000


# -- 2 n-gram join ----------------------------------------------------------------

def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        words = SPACED.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words)} if 0 < len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n,percent,block", [(4, 85, 2000), (5, 80, 3), (2, 60, 2)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)     # small blocks: the split path
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 4 * block)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 3 * block)
    rng = random.Random(n)
    shared = random_words(rng, 40)                           # a passage in unrelated documents
    texts = [" ".join(random_words(rng, rng.randrange(1, 90)) + shared) for _ in range(25)]
    texts += near_copies(rng, random_words(rng, 150), 40, 6)  # many lie close to the limit
    texts += near_copies(rng, random_words(rng, 30), 15, 2)
    texts += ["a b c", "A b c", "a b", "", None, "one", "one", " ".join(shared), " ".join(shared + ["x"])]
    rng.shuffle(texts)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(docs(spark, texts), n=n, percent=percent).collect())
    assert got == brute_components(texts, n, percent)


def test_trie_walk_prunes_but_loses_nothing():
    rng = random.Random(5)
    percent, members = 80, []
    for k in range(60):
        full = sorted(rng.sample(range(60), 30)) if k % 3 else sorted(range(k % 7, 32 + k % 7))
        members.append((full, (k, len(full), len(full) - ngram_join.prefix_length(len(full), percent), k)))
    prefix = lambda m: m[0][:ngram_join.prefix_length(len(m[0]), percent)]
    pairs = set()
    for w in range(70):
        run = [m for m in members if w in prefix(m)]
        rows = [(w, 0, 0, 0, m[1][0], m[1][1], m[1][3], prefix(m).index(w),
                 len(prefix(m)) - prefix(m).index(w)) for m in run]
        fits = ngram_join._feasible(rows, percent) if rows else []
        root = ngram_join._Node(0)
        for m in (m for m, ok in zip(run, fits) if ok):
            tail = [g for g in prefix(m) if g >= w]
            pairs |= {(other, m[1][0]) for other in ngram_join._probe(root, tail, m[1], percent)}
            ngram_join._insert(root, tail, m[1])
    for i, a in enumerate(members):
        for j, b in enumerate(members[:i]):
            common = len(set(a[0]) & set(b[0]))
            if 100 * common >= percent * (len(a[0]) + len(b[0]) - common):
                assert (j, i) in pairs
    assert len(pairs) < 60 * 59 / 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.fp: r.component for r in ngram_join.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# -- 3 licenses ---------------------------------------------------------------------

def test_license_base_equals_brute_force(spark):
    texts = ["CC BY, cc-by cc by", "all rights reserved all RIGHTS reserved.", "the GNU General Public License v3",
             "licence plates", "ccc by", "écc by", None, "", "x " * 5000 + "cc by " + "y " * 10,
             "SPDX-License-Identifier: MIT", "general public licenses", "all rights, reserved", "_cc_by", "x\x00cc\tby"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
                        if words[k:k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[9].labels == "mit" and got[3].labels == "" and got[2].labels == "gpl,gpl-3.0"


def test_license_suppression():
    labels = lambda text: sorted({d[3] for d in licenses.detections(" ".join(
        licenses.LICENSE_WORDS.findall(text.lower())))})
    assert labels("Licensed under the Apache License, Version 2.0") == ["apache-2.0"]      # the plain name lies inside
    assert labels("GNU Lesser General Public License version 2.1") == ["lgpl-2.1"]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0"]
    assert labels("Released under the MIT License. Parts: BSD-3-Clause license.") == ["bsd-3-clause", "mit"]


def test_license_gate_lets_every_rule_through(spark):
    from basketlens.llm.license_rules import TAGS
    samples = [f"SPDX-License-Identifier: {t}" for t in TAGS] + [
        "EPL 2.0", "AFL 3.0", "CC0 1.0", "EUPL 1.2", "GNU GPL", "lgpl v3", "WTFPL", "CeCILL 2.1", "GFDL 1.3",
        "Neither the name of X may be used to endorse or promote products derived from this software",
        "origin of this software must not be misrepresented", "the Unlicense", "apache v2", "apache 2 license",
        "historical permission notice and disclaimer", "Independent JPEG Group", "Proprietary and Confidential",
        "distributed on an as is basis without warranties or conditions of any kind",
        "to any person or organization obtaining a copy of the software and accompanying documentation",
        "all advertising materials mentioning features or use of this software must display",
        "distributed in the hope that it will be useful but without any warranty",
        "free and unencumbered software released into the public domain", "affero gpl v3", "simplified bsd"]
    for s in samples:
        found = licenses.detections(" ".join(licenses.LICENSE_WORDS.findall(s.lower())))
        assert found, s
    passed = docs(spark, samples + ["cc/by", "CC  BY"]).where(licenses.gated(F.col("text"))).count()
    assert passed == len(samples) + 2


def sample(nodes, rng):
    """A text that a parsed regex matches, with choices by ``rng``."""
    out = ""
    for op, arg in nodes:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            name, value = rng.choice(arg)
            out += chr(value) if str(name) == "LITERAL" else {"CATEGORY_DIGIT": "9", "CATEGORY_WORD": "x"}[str(value)]
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        elif op == "ANY":
            out += "x"
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_license_gate_holds_for_generated_samples_of_all_rules(spark):
    from basketlens.llm.license_rules import rules
    rng, texts = random.Random(37), ["CC Zero 1.0", "Mulan PSL v2", "MIT No Attribution"]
    for rule in rules():
        nodes = re._parser.parse(rule.regex.pattern)
        for text in sorted({sample(nodes, rng) for _ in range(30)}):
            assert rule.regex.search(text), text
            texts.append(rng.choice((str, str.upper, str.title))(text.replace(" ", rng.choice((" ", "-", ", ", "_")))))
    missed = docs(spark, texts).where(~licenses.gated(F.col("text"))).select("text").distinct()
    assert [r.text for r in missed.collect()] == []
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts[:3])).collect()}
    assert [got[i].labels for i in range(3)] == ["cc0-1.0", "mulanpsl-2.0", "mit-0"] and all(got[i].score > 0 for i in range(3))


def test_license_keywords_stand_in_every_match():
    from basketlens.llm.license_rules import rules
    rng = random.Random(38)
    for rule in rules():
        nodes = re._parser.parse(rule.regex.pattern)
        for _ in range(60):
            assert rule.keyword in sample(nodes, rng), (rule.keyword, rule.regex.pattern)


def plain_labels(text):
    """Labels without any gate: every rule on the whole text, every pair of intervals compared."""
    from basketlens.llm.license_rules import rules
    joined = " ".join(licenses.LICENSE_WORDS.findall(licenses.lower_ascii(text)))
    found = [(m.start(), m.end(), r.priority, r.label, k) for k, r in enumerate(rules()) for m in r.regex.finditer(joined)]

    def inside(a, b):
        """``a`` goes because of ``b``"""
        if not (b[0] <= a[0] and a[1] <= b[1]):
            return False
        if a[2] != b[2]:
            return a[2] < b[2]
        return a[:2] != b[:2] or b[4] < a[4]

    kept = {label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {joined} "}
    order, stay = sorted(found, key=lambda d: (-d[2], d[0], -d[1], d[4])), []
    for d in order:
        if not any(inside(d, other) for other in stay):
            stay.append(d)
            kept.add(d[3])
    return ",".join(sorted(kept))


def test_license_labels_equal_an_ungated_matcher(spark):
    from basketlens.llm.license_rules import rules
    rng, texts = random.Random(39), []
    for rule in rules():
        nodes = re._parser.parse(rule.regex.pattern)
        some = rng.choice(rules())
        other = re._parser.parse(some.regex.pattern)
        texts.append(f"{' '.join(random_words(rng, 5))}. {sample(nodes, rng)}; {sample(other, rng)} {' '.join(random_words(rng, 3))}")
        assert rule.label in plain_labels(sample(nodes, rng)).split(",") or rule.priority < 4
    texts += ["Licensed under Apache-2.0", "License: MIT", "No part of this book may be reproduced.", "no part of it", "cc by", "", None]
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_labels(t or "") for t in texts]
    assert [got[len(texts) - k] for k in (7, 6, 5)] == ["apache-2.0", "mit", "proprietary"]


def test_secrets_of_a_text_full_of_matches(spark):
    """200,000 matches in one text: their places and the redaction, in seconds."""
    import time
    lines = [f"é token={'k' * (5 + i % 3)}{i % 10} AKIA{'Z' * (15 + i % 3)} \n" for i in range(100_000)]
    text = "".join(lines)
    frame = docs(spark, [text, "no secret", None]).cache()
    frame.count()
    start = time.time()
    row = secrets.scan(frame).where("doc_id = 0").first()
    expected = {"assign": [], "access": []}
    for kind, pattern, group, least in (("assign", secrets.BASE_RULES[0].pattern, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20)):
        for m in re.finditer(pattern.replace("(?i:", "(?:"), text):
            if len(m.group(group)) >= least:
                expected[kind].append((m.start(), m.end()))
    assert {k: [(s.start, s.end) for s in row[k]] for k in expected} == expected
    assert len(expected["assign"]) == 100_000 and len(expected["access"]) > 60_000
    clean = {r.doc_id: r.text for r in secrets.redacted(frame).collect()}
    plain, at = [], 0
    for start_, end in sorted(expected["assign"] + expected["access"]):
        plain += [text[at:start_], "[SECRET]"]
        at = end
    assert clean == {0: "".join(plain) + text[at:], 1: "no secret", 2: None}
    assert time.time() - start < 120


@pytest.mark.parametrize("block", [1, 2, 3, 512])
def test_running_sums_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(secrets, "BLOCK", block)
    frame = spark.createDataFrame([([],), ([5],), (list(range(1, 12)),)], "v array<int>")
    found = [r[0] for r in frame.select(secrets.prefix_sums(F.col("v"))).collect()]
    assert found == [[], [5], [sum(range(1, k + 1)) for k in range(1, 12)]]
    texts = ["token=abcdef AKIA" + "A" * 20 + " token=" + "0" * 30 + " x" * 3 + " secret: AKIA" + "B" * 18 + "f" * 24]
    spans = sorted((m, e) for row in secrets.scan(docs(spark, texts)).collect() for kind in
                   [r.kind for r in secrets.BASE_RULES + secrets.OWN_RULES] for m, e in [(s.start, s.end) for s in row[kind]])
    out, at = "", 0
    for a, e in spans:
        if a >= at:
            out += texts[0][at:a] + "[SECRET]"
        at = max(at, e)
    assert secrets.redacted(docs(spark, texts)).first().text == out + texts[0][at:]


# -- 4 toxicity, 6 quality: held-out accuracy -----------------------------------------

def test_toxicity_held_out(spark):
    table = lambda n: Q.table(spark, "/root/testdata/sf0.1", n)
    labels = table("labels").select("doc_id", "toxic")
    fitted = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 0)
    got = toxicity.grades(table("documents"), fitted).withColumnRenamed("toxic", "rejected")
    rows = got.join(labels.join(fitted, "doc_id", "left_anti"), "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([r.rejected for r in rows if not r.toxic]) <= 0.004
    assert np.mean([r.rejected for r in rows if r.toxic]) >= 0.88   # some labelled ones hold no toxic word
    assert np.mean([r.severity for r in rows if r.toxic]) > 1 > np.mean([r.severity for r in rows if not r.toxic])
    assert all(0 <= r.severity <= 3 and r.grade in (0, 1, 2, 3) for r in rows)


def test_toxicity_grades_follow_the_marks(spark):
    rng = random.Random(1)
    texts = [" ".join(random_words(rng, 60) + ["vile"] * (k % 7)) for k in range(280)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 7 > 0)) for k in range(280)], "doc_id long, toxic int")
    got = {r.doc_id: r.severity for r in toxicity.grades(table, labels).collect()}
    means = [np.mean([got[k] for k in range(280) if k % 7 == c]) for c in range(7)]
    assert means == sorted(means) and means[0] < 0.5 < 2 < means[6]


def plain_loss(x, grade, beta, ridge):
    width, total = x.shape[1], 0.0
    t = [-math.inf, *beta[width:], math.inf]
    if sorted(t) != t:
        return math.inf
    sig = lambda v: 1.0 if v == math.inf else 0.0 if v == -math.inf else 1 / (1 + math.exp(-v))
    for row, g in zip(x, grade):
        eta = float(row @ beta[:width])
        total -= math.log(sig(t[g + 1] - eta) - sig(t[g] - eta))
    return total + 0.5 * float((ridge * beta ** 2).sum())


def graded(spark, n=150, empty=None):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(n, 2)) * [1.0, 2.0]
    eta = x @ [1.5, -0.7] + rng.logistic(size=n)
    grade = (eta[:, None] > np.array([-0.5, 0.8, 2.0])[None, :]).sum(axis=1)
    if empty is not None:
        grade[grade == empty] = 0
    rows = [(int(g), r.tobytes()) for g, r in zip(grade, x)]
    return x, grade, spark.createDataFrame(rows, "grade int, x binary").repartition(3)


@pytest.mark.parametrize("empty", [None, 2])
def test_toxicity_fit_is_the_maximum_of_the_likelihood(spark, empty):
    """Equal to a plain descent with numeric gradients, and no direction is better; thresholds stay in order."""
    x, grade, data = graded(spark, empty=empty)
    beta = toxicity.maximized(data, 2)
    ridge = np.array([toxicity.RIDGE] * 2 + [1e-3] * 3)
    assert (np.diff(beta[2:]) > 0).all()
    least = plain_loss(x, grade, beta, ridge)
    slope = lambda b: np.array([(plain_loss(x, grade, b + h, ridge) - plain_loss(x, grade, b - h, ridge)) / 2e-5
                                for h in 1e-5 * np.eye(5)])
    if empty is None:
        assert np.abs(slope(beta)).max() < 1e-2
        other, rate = np.array([0.0, 0.0, -1.0, 0.0, 1.0]), 0.01
        for _ in range(600):
            g = slope(other)
            while plain_loss(x, grade, other - rate * g, ridge) > plain_loss(x, grade, other, ridge):
                rate /= 2
            other, rate = other - rate * g, rate * 1.3
        assert np.abs(other - beta).max() < 0.02 and abs(plain_loss(x, grade, other, ridge) - least) < 1e-3
    rng = np.random.default_rng(3)
    assert all(plain_loss(x, grade, beta + 0.05 * rng.normal(size=5), ridge) >= least - 0.05 for _ in range(100))


def test_toxicity_gradient_and_step_control():
    """The sums equal differences of the loss; parameters out of order have no likelihood."""
    rng = np.random.default_rng(4)
    x, grade, beta = rng.normal(size=(40, 3)), rng.integers(0, 4, 40), np.array([0.3, -1.0, 0.5, -1.0, 0.2, 1.5])
    gradient, curvature = toxicity.scoring_sums(x, grade, beta)
    for k, h in enumerate(1e-6 * np.eye(6)):
        up, down = toxicity.losses(x, grade, np.stack([beta + h, beta - h]))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-4
    assert np.allclose(curvature, curvature.T) and np.linalg.eigvalsh(curvature).min() > 0
    assert toxicity.losses(x, grade, np.array([[0, 0, 0, 1.0, 0.5, 2.0]])) == [np.inf]


def test_toxicity_ties_in_the_choice_of_features(spark, monkeypatch):
    """Features that mark equally well are chosen by name; a rerun chooses the same."""
    monkeypatch.setattr(toxicity, "MAX_FEATURES", 3)
    texts = [("aa bb cc dd ee" if k % 2 else "good day") + f" w{k}" for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int")
    table = docs(spark, texts).select("doc_id", "text")
    models = [toxicity.fit(table.repartition(n), labels) for n in (1, 5)]
    assert [list(m.features) for m in models] == [["aa", "bb", "cc"]] * 2
    assert np.allclose(models[0].weights, models[1].weights) and np.isfinite(models[0].weights).all()


def random_features(M, x):
    rng = np.random.default_rng(22)
    return M.Model(x.mean(axis=0), x.std(axis=0), rng.normal(0, 1 / M.BANDWIDTH, (x.shape[1], M.FEATURES)),
                   rng.uniform(0, 2 * np.pi, M.FEATURES), np.zeros(M.FEATURES + 1), np.array([0.0]), np.array([0.5]))


def test_quality_fit_is_a_kernel_ridge(monkeypatch, spark):
    """The partition-summed normal equations are the plain ones; many random features give the scores of the kernel itself."""
    from basketlens.llm import quality_model as M
    rng = np.random.default_rng(21)
    x = rng.normal(size=(240, len(M.STATISTICS)))
    y = ((x[:, 0] * x[:, 1] + np.sin(2 * x[:, 2]) + 0.3 * rng.normal(size=240)) > 0).astype(int)
    frame = spark.createDataFrame([(int(q), *map(float, row)) for q, row in zip(y, x)],
                                  "quality int, " + ", ".join(f"{c} double" for c in M.STATISTICS)).repartition(5)
    model = random_features(M, x)
    zz, zy = M._normal_equations(frame, model)
    z = model.mapped(x)
    assert np.allclose(zz, z.T @ z) and np.allclose(zy, z.T @ y)

    monkeypatch.setattr(M, "FEATURES", 8192)
    model = random_features(M, x)
    z = model.mapped(x)
    penalty = M.RIDGE * np.eye(M.FEATURES + 1)
    penalty[-1, -1] = 1e-6
    # (Z'Z + P)^-1 Z'y with fewer unknowns than features
    inverse = z / np.diag(penalty)
    model.weights = inverse.T @ np.linalg.solve(np.eye(240) + z @ inverse.T, y)
    scaled = (x - model.mean) / model.scale
    far = ((scaled[:, None, :] - scaled[None, :, :]) ** 2).sum(axis=2)
    kernel = np.exp(-far / (2 * M.BANDWIDTH ** 2))
    system = np.block([[kernel + M.RIDGE * np.eye(240), np.ones((240, 1))], [np.ones((1, 240)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.append(y, 0.0))
    direct = kernel @ solved[:-1] + solved[-1]
    assert np.abs(model.raw(x) - direct).max() < 0.08 and np.corrcoef(model.raw(x), direct)[0, 1] > 0.99


def test_quality_held_out(spark):
    got = Q.op6_quality_model(spark, "/root/testdata/sf0.01")
    rows = got.join(Q.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


# -- 5 secrets ----------------------------------------------------------------------

def brute_spans(text):
    rules = [(r.kind, re.compile(r.pattern), r.group, r.least) for r in secrets.BASE_RULES + secrets.OWN_RULES]
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p, g, least) in enumerate(rules)
             for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return sorted(spans)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(2)
    parts = ["password=hunter22", "API_KEY: 'abc.def/gh'", "secret=token:abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 14,
             "AKIA123", "deadbeef" * 4, "a" * 23, "ghp_" + "x9" * 20, "é€𝒳", "xoxb-" + "1a" * 8, "AIza" + "q" * 35,
             "sk_live_" + "k" * 20, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c", "-----BEGIN RSA PRIVATE KEY-----", "token= \"",
             "apikey==12345678", "Passwd : x", "\n", " the "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    texts += ["", None, "plain text"] + parts
    for row in secrets.digest(docs(spark, texts)).collect():
        spans = brute_spans(texts[row.doc_id])
        show = lambda keep: ",".join(f"{kind}:{a}:{b}" for a, k, kind, b in spans if keep(k))
        assert row.spans == show(lambda k: True), texts[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(show(lambda k: k < 3).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_trigram_queries_hold_for_every_match():
    for rule in secrets.BASE_RULES + secrets.OWN_RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
    for text in ("PassWd= abcdef", "my api_key:zzzzzz", "APIKEY=000000", "Secret = 'x'", "AKIA0", "ghs_" + "a" * 36):
        low = text.lower()
        for rule in secrets.BASE_RULES + secrets.OWN_RULES:
            query = secrets.trigram_query(rule.pattern)
            if query and re.search(rule.pattern, text):
                assert any(all(g in low for g in q) for q in query), (rule.kind, text)


def test_redaction(spark):
    texts = ["a password=hunter22 b", "AKIA" + "A" * 20 + "!", None, "", "clean", "token=" + "abcdef01" * 4]
    got = [r.text for r in secrets.redacted(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["a [SECRET] b", "[SECRET]!", None, "", "clean", "[SECRET]"]


# -- 7 quality rules -------------------------------------------------------------------

def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(random_words(rng, rng.randrange(0, 60), 5)) for _ in range(60)]
    texts += ["a a a a", "x y z", "l1 a\nl1 a\n\n \nl2\nl1 a", "# * é€ $%", "", None, "𝒳 " * 30, "\t\n\x0b\x0c\r ", "a\x1cb c d"]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = SPACED.findall(t)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        hit = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
        lines = [line for line in t.split("\n") if SPACED.search(line)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(hit)), t
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_thresholds_adapt(spark):
    rng = random.Random(6)
    clean = [" ".join(random_words(rng, 80)) for _ in range(60)]
    tables = [" | ".join(random_words(rng, 80)) for _ in range(30)]       # usual in their own source
    odd = ["### ".join(random_words(rng, 80))]                            # unusual among clean texts
    table = docs(spark, clean + tables + odd, ["web"] * 60 + ["tables"] * 30 + ["web"])
    kept = {r.doc_id: r.kept for r in quality_rules.judge(table).collect()}
    assert [i for i in range(91) if not kept[i]] == [90]


def test_quality_limits_come_from_the_sketches(spark):
    """A junk-heavy source keeps its clean texts only; a clean source loses what is odd there, below
    the old fixed cutoff of 0.35 too; a tiny source is judged by the others of its language."""
    rng = random.Random(16)
    with_marks = lambda n: " ".join(random_words(rng, 100)) + "#" * n  # noqa: E731   symbol_ratio n / 100
    texts, sources = [], []
    for source, marks in (("heavy", [0] * 700 + [30 + k % 270 for k in range(300)]), ("clean", [0] * 200 + [20]),
                          ("symbols", [40 + k % 5 for k in range(60)]), ("tiny", [0, 250])):
        texts += [with_marks(n) for n in marks]
        sources += [source] * len(marks)
    rows = quality_rules.judge(docs(spark, texts, sources)).collect()
    kept = {name: [r.symbol_ratio for r in rows if sources[r.doc_id] == name and r.kept] for name in set(sources)}
    assert kept == {"heavy": [0.0] * 700, "clean": [0.0] * 200, "symbols": kept["symbols"], "tiny": [0.0]}
    assert len(kept["symbols"]) == 60


def plain_limits(rows, floors):
    """{(lang, source): limits} by sorting: the rule of the module docstring over whole groups."""
    def quantiles(values):
        ordered = sorted(values)
        return [ordered[max(0, math.ceil(rank * len(ordered)) - 1)] for rank in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)]

    def body_end(values, floor):
        end = quantiles(values)[0]
        for v in quantiles(values):
            end = v if v - end <= floor / 2 else end
        return end

    def fence(values, floor):
        end = body_end(values, floor)
        return end + max(floor, end - quantiles(values)[0])

    def limit(values, floor, pools):
        """``pools``: (values above zero, least number) from the group to the whole."""
        if body_end(values, floor) > 0:
            return fence(values, floor)
        for pool, least in pools:
            if len(pool) >= least:
                low = quantiles(pool)[0]
                return low / 3 if low > floor else fence(pool, floor)
        return floor

    out = {}
    for group in {(lang, source) for lang, source, _, _ in rows}:
        out[group] = []
        for k, floor in enumerate(floors):
            mine = [v[k] for lang, source, failed, v in rows if (lang, source) == group and not failed]
            lang_values = [v[k] for lang, _, failed, v in rows if lang == group[0] and not failed]
            every = [v[k] for _, _, failed, v in rows if not failed]
            above = [([x for x in values if x > 0], least) for values, least in ((mine, 20), (lang_values, 20), (every, 1))]
            usual = (limit(lang_values, floor, above[1:]) if len(lang_values) >= 20
                     else limit(every, floor, above[2:]) if every else None)
            if len(mine) < 20:
                out[group].append(usual)
                continue
            own, at = limit(mine, floor, above), quantiles(mine)
            out[group].append(min(own, usual) if at[0] <= usual < at[3] else own)
    return out


def test_quality_verdicts_equal_brute_force(spark):
    """Groups of all kinds: no symbols, a natural few, junk beyond a gap, repeated lines, too small, none sound."""
    rng = random.Random(33)
    texts, sources, langs = [], [], []

    def add(lang, source, count, marks, repeats=lambda: 0, size=lambda: 100):
        for _ in range(count):
            lines = [" ".join(random_words(rng, 10)) for _ in range(max(1, size() // 10))]
            lines += [lines[0]] * repeats()
            texts.append("\n".join(lines) + "#" * marks())
            sources.append(source)
            langs.append(lang)

    add("en", "none", 60, lambda: 0)
    add("en", "few", 80, lambda: rng.choice([0, 0, 0, 0, 1, 2, 3, 25]))
    add("en", "gap", 90, lambda: rng.choice([0, 0, 0, 0, 45, 60, 200, 11, 16]))
    add("en", "lines", 50, lambda: 0, lambda: rng.randrange(5))
    add("de", "table", 40, lambda: rng.randrange(30, 60))
    add("de", "small", 6, lambda: rng.choice([0, 5, 90]))
    add("fr", "small", 3, lambda: rng.choice([0, 50]))
    add("fr", None, 12, lambda: 0, size=lambda: 20)
    add(None, "few", 25, lambda: rng.choice([0, 1, 150]))
    frame = spark.createDataFrame([(i, t, l, s, None) for i, (t, l, s) in enumerate(zip(texts, langs, sources))], DOC)
    got = quality_rules.judge(frame).collect()
    ratios = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
    rows = [(langs[r.doc_id], sources[r.doc_id], r.base_failed, [r[c] for c in ratios]) for r in got]
    limits = plain_limits(rows, [quality_rules.FLOORS[c] for c in ratios])
    for r, (lang, source, failed, values) in zip(got, rows):
        assert r.kept == (not failed and all(v <= most for v, most in zip(values, limits[lang, source])))
    assert {False, True} == {r.kept for r in got if sources[r.doc_id] == "gap"}
    assert limits["en", "none"][0] not in (0.1, None)       # not the bare floor: from the language's sketch



# -- 8 mixing ------------------------------------------------------------------------------

def test_mix_fit_of_long_documents():
    """Only documents beyond FIT_BUDGET left: the fit is the best subset, as tried one by one."""
    fit = lambda lengths, budget: mixing.fit_lengths(np.array(lengths), np.ones(len(lengths), dtype=np.int64), budget)
    assert fit([300000, 201000, 200000], 401000).tolist() == [0, 1, 1]
    rng = random.Random(8)
    for _ in range(40):
        lengths = rng.sample(range(70_000, 900_000), 8)
        sums = {sum(w for k, w in enumerate(lengths) if bits >> k & 1) for bits in range(256)}
        budget = rng.randrange(sum(lengths))
        take = fit(lengths, budget)
        assert set(take.tolist()) <= {0, 1}
        got = int((take * np.array(lengths)).sum())
        assert got <= budget
        if budget - got > mixing.FIT_BUDGET:
            assert got == max(s for s in sums if s <= budget)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        over = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else left * w[s] / sum(w[x] for x in open_) for s in names}
        full |= over


def test_mix_meets_targets(spark):
    rng = random.Random(7)
    texts, sources = [], []
    for k in range(400):
        sources.append(rng.choice(["a", "b", "B", "é", None, "c", "a", "a"]))
        texts.append(" ".join(random_words(rng, rng.choice([0, 1, 2, 7, 30, 31, 200]))))
    texts[5] = None
    table = docs(spark, texts, sources)
    got = {r.doc_id: r for r in mixing.mix(table).collect()}
    size = lambda t: len(SPACED.findall(t or ""))
    totals = {s: sum(size(t) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    targets = brute_targets(totals)
    taken = dict.fromkeys(totals, 0)
    for i, t in enumerate(texts):
        r = got[i]
        assert r.size == size(t) and r.source_size == totals[sources[i]]
        assert math.isclose(r.target, targets[sources[i]], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[sources[i]] += r.taken
    for s in totals:
        assert abs(taken[s] - targets[s]) <= 2
    again = {r.doc_id: r.taken for r in mixing.mix(table.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_equals_brute_force(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(2, 30), 4)), dtype=np.int64)
    counts = np.array([rng.randrange(1, 4) for _ in lengths], dtype=np.int64)
    budget = rng.randrange(1, int((lengths * counts).sum()))
    sums = {0}
    for size, c in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * size for s in sums for k in range(c + 1)}
    take = mixing._knapsack(lengths, counts, budget)
    assert (take <= counts).all()
    assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_of_long_documents_stays_exact_beyond_the_program():
    lengths = np.array([0, 1, 3, 70_000, 500_000], dtype=np.int64)
    counts = np.array([9, 100_000, 10, 40, 7], dtype=np.int64)
    budget = 3_333_333
    take = mixing.fit_lengths(lengths, counts, budget)
    assert (0 <= take).all() and (take <= counts).all() and take[0] == 0
    assert int((take * lengths).sum()) == budget


# -- 9 url filter --------------------------------------------------------------------------------

def test_url_filter_equals_brute_force(spark):
    rng = random.Random(8)
    names = ["a", "b", "ab", "net", "example", "x-y", "é"]
    host = lambda: ".".join(rng.choice(names) for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice(["en/", "e", "fr/", "x"]) for _ in range(rng.randrange(0, 4)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice([host(), host().upper()])}{path()}{rng.choice(['', '?q=/en/', '#x', ''])}"
            for _ in range(300)] + [None, "", "no scheme", "x://", "x://a", "x://A.net?x", "a://b://c/en/", "h://a\n/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame([(h, p, v) for (h, p), v in rules], url_filter.RULES_SCHEMA)
    got = {r.page_id: r for r in url_filter.judge(pages, frame).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2]
        h = re.split(r"[/?#]", rest)[0]
        p = re.split(r"[?#]", rest[len(h):])[0]
        h = h.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(rh + rp), rp, rh + rp, v) for (rh, rp), v in rules
                if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)
        r = got[i]
        assert (r.host, r.path) == (h, p)
        assert (r.rule, r.verdict) == ((best[2], best[3]) if best else (None, "allow")), url


# -- 10 WARC -------------------------------------------------------------------------------------

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 37)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")       # records cross the splits
    try:
        rng = random.Random(9)
        html = [" ".join(random_words(rng, rng.randrange(0, 400))) for _ in range(120)]
        html += [FAKE, "x" * 50 + FAKE * 30 + "y", "WARC/1.1\r\n", "\r\n\r\n", "é€𝒳" * 400, "", None,
                 "q" * 1000, "q" * 1000, "q" * 999, "q" * 999, FAKE * 20, FAKE * 20]
        pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)] + [(None, "z" * 2000)], "page_id long, html string")
        got = warc.round_trip(pages).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(html) + 1
    rows = {r.page_id: r for r in got}
    for i, h in enumerate(html):
        body = (h or "").encode()
        same = [j for j, x in enumerate(html) if (x or "") == (h or "")] if len(body) >= 1000 else [i]
        revisit = i != max(same)
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (rows[i].record_type, rows[i].refers_to) == (("revisit", max(same)) if revisit else ("response", None))
    assert rows[None].payload_bytes == 2000


def test_warc_damage_ends_the_chain(spark, tmp_path):
    record = lambda n, body: (f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n"  # noqa: E731
                              f"{body}\r\n\r\n")
    (tmp_path / "good.warc").write_bytes((record(1, "a") + record(2, FAKE) + record(3, "c")).encode())
    (tmp_path / "bad.warc").write_bytes((record(4, "a") + "junk" + record(5, "b")).encode())
    (tmp_path / "late.warc").write_bytes(("x" + record(6, "a")).encode())
    got = sorted(re.search(r"page:(\d)", r.header)[1] for r in warc.read(spark, f"file://{tmp_path}").collect())
    assert got == ["1", "2", "3", "4"]


def test_reachable_doubles(spark):
    links = spark.createDataFrame([("f", i, i + 1) for i in range(100)] + [("f", 500, 501), ("g", 1, 2)],
                                  "file string, at long, successor long")
    assert sorted(r.at for r in warc.reachable(links).collect()) == list(range(100))
