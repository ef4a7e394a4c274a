"""License scans: ordered signature rules with keyword gates and suppression.

Texts are read as words (A-Z lower-cased; letters, digits and everything
beyond ASCII).  A text without any gate keyword is done at once.  The others
run the rules whose keyword they hold.  Detections are intervals of words with
a priority; one that lies inside a detection of higher priority, or inside a
longer one of its own, is dropped.

The base phrases are found in every text and their labels always stay.

Defined cases: null text is empty; texts without words have n_words 0, no
labels and score 0; of two equal intervals with equal priority the rule written
first stays; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.license_rules import NAME, NOTICE, TAG, TEXT, rules
from basketlens.llm.text import lower_ascii, texts

# Fixed by the contract of the query: words, phrases and their labels.
LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY_CASE_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"   # the same words before lower-casing
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Parts of words that most phrases hold; ``gate`` adds what the other phrases of the rules need.
GATE = ("licens", "licenc", "rights", "copyright", "spdx", "commons", "public", "gpl", "epl", "eupl", "afl", "gfdl", "cecill",
        "cc0", "wtfpl", "bsd", "apache", "redistribut", "permission", "confidential", "unauthorized", "warrant", "endorse",
        "jpeg", "misrepresented", "software", "portions", "consent", "secrets", "altered")
GATE_PART = 5   # letters of a word that can be a gate part by itself; shorter ones need the next word, as "cc by"

CONFIDENCE = {NAME: 0.4, NOTICE: 0.75, TEXT: 0.85, TAG: 0.95}   # of one label; a base phrase counts as a name


def base_starts(joined: str) -> list[tuple[int, str]]:
    """Every place (character offset, label) of a base phrase in the joined words."""
    padded, found = f" {joined} ", []
    for phrase, label in BASE.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return found


def detections(joined: str) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of the detections that stay, as character offsets."""
    gates: dict[str, bool] = {}
    by_priority: dict[int, list] = {}
    for rule in rules():
        if rule.keyword not in gates:
            gates[rule.keyword] = rule.keyword in joined
        if gates[rule.keyword]:
            by_priority.setdefault(rule.priority, []).extend(
                (m.start(), m.end(), rule.priority, rule.label) for m in rule.regex.finditer(joined))
    kept: list[tuple[int, int, int, str]] = []
    for priority in sorted(by_priority, reverse=True):
        above = sorted(kept)                       # of higher priority
        starts = [d[0] for d in above]
        reach = list(accumulate((d[1] for d in above), max))
        furthest = -1
        for d in sorted(by_priority[priority], key=lambda d: (d[0], -d[1])):   # stable: rules as written
            k = bisect_right(starts, d[0])
            if d[1] > furthest and not (k and reach[k - 1] >= d[1]):
                kept.append(d)
                furthest = d[1]
    return sorted(kept)


def scan_text(text: str) -> tuple:
    words = LICENSE_WORDS.findall(lower_ascii(text))
    joined = " ".join(words)
    base, found = base_starts(joined), detections(joined)
    places = [at for at, _ in base]
    first = last = None
    if places:
        offsets = np.cumsum([0] + [len(w) + 1 for w in words])   # where each word starts
        first, last = (int(np.searchsorted(offsets, at)) for at in (min(places), max(places)))
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(d[3] for d in found)})
    best: dict[str, float] = dict.fromkeys(base_labels, CONFIDENCE[NAME])
    for _, _, priority, label in found:
        best[label] = max(best.get(label, 0.0), CONFIDENCE[priority])
    score = 1 - float(np.prod([1 - c for c in best.values()]))
    return len(places), first, last, ",".join(base_labels), ",".join(labels), score


def phrases(nodes) -> set[str]:
    """What a parsed regex can match, with NUL for what is not fixed."""
    out = {""}
    for op, arg in nodes:
        op = str(op)
        if op == "LITERAL":
            more = {chr(arg)}
        elif op == "IN" and all(str(name) == "LITERAL" for name, _ in arg):
            more = {chr(value) for _, value in arg}
        elif op == "SUBPATTERN":
            more = phrases(arg[-1])
        elif op == "BRANCH":
            more = set().union(*(phrases(branch) for branch in arg[1]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            more = {x if high == 1 else f"\0{x}\0" for x in phrases(inner)} | ({""} if low == 0 else set())
        else:
            more = {""} if op.startswith("ASSERT") else {"\0"}
        out = {x + y for x in out for y in more}
    return out


@lru_cache(maxsize=1)
def gate() -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """Parts of words and pairs of words, one of which every base phrase and every match of a rule holds.

    Notices hold a name pattern, which is a rule too.
    """
    parts, pairs = list(GATE), set()
    held = {x for rule in rules() if rule.priority != NOTICE for x in phrases(re._parser.parse(rule.regex.pattern))}
    for phrase in sorted(held | set(BASE)):
        runs = re.findall("[a-z0-9]+", phrase)
        if any(part in run for part in parts for run in runs):
            continue
        longest = max(runs, key=len)
        if len(longest) >= GATE_PART:
            parts.append(longest)
        else:
            pairs.add(re.match("([a-z0-9]+) ([a-z0-9]+)(?![^ ])", phrase).groups())   # fails where there is no such pair
    return tuple(parts), tuple(sorted(pairs))


def gated(text: Column) -> Column:
    """Whether a text has a part or pair of the gate; the lower-cased text is made once."""
    parts, pairs = gate()

    def any_of(low: Column) -> Column:
        found = F.exists(F.array(*[F.lit(k) for k in parts]), lambda k: F.contains(low, k))
        for first in sorted({pair[0] for pair in pairs}):
            seconds = "|".join(pair[1] for pair in pairs if pair[0] == first)
            found = found | (F.contains(low, F.lit(first)) & low.rlike(rf"(?<![a-z0-9]){first}[^a-z0-9]+(?:{seconds})"))
        return found

    return F.get(F.transform(F.array(F.lower(text)), any_of), F.lit(0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``,
    one row per document.

    No shuffle.  Words are counted in the JVM; only gated texts go to Python.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.regexp_count(text, F.lit(ANY_CASE_WORDS)).cast("long").alias("n_words"),
                       F.when(gated(text), text).alias("text"))
    empty = (0, None, None, "", "", 0.0)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, "text"):
            found = [scan_text(t) if t else empty for t in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"),
                 *[pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]],
                ["doc_id", "n_words", *names])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double")
