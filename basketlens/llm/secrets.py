"""Secret scans through a trigram inverted index.

From every rule's regex a Boolean trigram query is derived: any match must
hold all trigrams of at least one conjunction.  An index over the texts, with
the trigrams that some query asks for, is intersected with the queries; only
the documents left are verified with the regex itself.  A rule whose regex has
no mandatory trigram is run on every text.  Built-in functions only on the
data path; the queries are derived when the plan is built.

Defined cases: null text is empty and has no spans; a null id or an id that
several rows share is fine (the index may then propose more, never fewer, and
verification is by row); an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.session import written

# Engineering limits of the derivation: character classes and string sets wider
# than this count as "anything".
MAX_CLASS, MAX_STRINGS = 8, 32
BLOCK = 512   # matches of a text that are folded one by one; a text's work grows with its matches, not their square


@dataclass(frozen=True)
class Rule:
    """``pattern`` must mean the same to Java and Python; a match counts when its
    ``group`` has at least ``least`` characters, and is consumed either way."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed by the contract of the query: kinds, patterns and least lengths.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),   # runs of 24+ are the runs `[0-9a-f]+` that are long enough
)
# Rules of the method itself.
OWN_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)


# -- Boolean trigram queries -------------------------------------------------

def _strings(op: str, arg) -> Optional[set[str]]:
    """The finite set of strings one regex node can match, or None."""
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out: set[str] = set()
        for name, value in arg:
            if str(name) == "LITERAL":
                out.add(chr(value).lower())
            elif str(name) == "RANGE" and value[1] - value[0] < MAX_CLASS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MAX_CLASS else None
    if op == "SUBPATTERN":
        return _concat(arg[-1])
    if op == "BRANCH":
        parts = [_concat(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in ("MAX_REPEAT", "POSSESSIVE_REPEAT") and arg[:2] == (0, 1):
        inner = _concat(arg[2])
        return None if inner is None else inner | {""}
    return None


def _concat(nodes) -> Optional[set[str]]:
    out = {""}
    for op, arg in nodes:
        more = _strings(str(op), arg)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _clause(strings: set[str]) -> Optional[frozenset[frozenset[str]]]:
    """Alternatives, each a set of trigrams that must all occur; None if some
    string is too short to have one."""
    grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in grams else frozenset(grams)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Disjunction of trigram conjunctions over the lower-cased text that every
    match of ``pattern`` satisfies; empty if the regex has no mandatory trigram."""
    clauses, run = [], {""}
    for op, arg in [*re._parser.parse(pattern), ("END", None)]:
        more = _strings(str(op), arg)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        clauses.append(_clause(run))
        run = more or {""}
        if str(op) == "SUBPATTERN" and more is None:
            clauses.append(frozenset(trigram_query_nodes(arg[-1])) or None)
    clauses = [c for c in clauses if c]
    out = {frozenset()}
    for clause in clauses:
        if len(out) * len(clause) <= MAX_STRINGS:
            out = {a | b for a in out for b in clause}
    out -= {frozenset()}
    return sorted((q for q in out if not any(other < q for other in out)), key=sorted)   # a superset adds nothing


def trigram_query_nodes(nodes) -> list[frozenset[str]]:
    strings = _concat(nodes)
    return list(_clause(strings) or ()) if strings else []


# -- index, candidates, verification ------------------------------------------

def postings(docs: DataFrame, grams: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index ``(trigram, doc_id)`` for the trigrams some query needs."""
    present = F.get(F.transform(   # the lower-cased text gets a name, so that it is made once
        F.array(F.lower(F.col(text_col))),
        lambda low: F.filter(F.array(*[F.lit(g) for g in grams]), lambda g: F.contains(low, g))), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: Sequence[Rule], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, kinds)``: the documents whose postings satisfy a rule's query.

    A posting sets its bit in every conjunction that asks for the trigram; a
    document with all bits of one is a candidate.  Postings are intersected by
    document, never gathered by trigram, so a trigram of any frequency spreads
    over all tasks and is combined before the shuffle.
    """
    terms = [(gram, rule.kind, nth, 1 << bit, (1 << len(query)) - 1)
             for rule in rules for nth, query in enumerate(trigram_query(rule.pattern))
             for bit, gram in enumerate(sorted(query))]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(terms, "trigram string, kind string, nth int, bit long, all_bits long")
    return (postings(docs, sorted({t[0] for t in terms}), id_col, text_col)
            .join(F.broadcast(wanted), "trigram")       # the rule list: as long as the regexes, not the data
            .groupBy("doc_id", "kind", "nth", "all_bits").agg(F.bit_or("bit").alias("bits"))
            .where(F.col("bits") == F.col("all_bits"))
            .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """``[add(0, v1), add(add(0, v1), v2), ...]`` of an array of ints, which appends to the array so far."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(values, start, lambda acc, v: F.struct(
        add(acc["at"], v).alias("at"), F.concat(acc["sums"], F.array(add(acc["at"], v))).alias("sums")),
        lambda acc: acc["sums"])


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of ints: within blocks, then over the blocks' sums."""
    plus = lambda a, b: a + b

    def joined(inner: Column) -> Column:
        before = running(F.transform(inner, lambda sums: F.element_at(sums, -1)), plus)
        return named(before, lambda total: F.flatten(F.transform(inner, lambda sums, k: F.transform(
            sums, lambda x: x + F.when(k > 0, F.get(total, k - 1)).otherwise(F.lit(0))))))

    return F.when(F.size(values) > 0, named(
        F.transform(F.sequence(F.lit(1), F.size(values), F.lit(BLOCK)),
                    lambda first: running(F.slice(values, first, F.lit(BLOCK)), plus)), joined)).otherwise(
        F.array().cast("array<int>"))


def matches(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule as (start, order, kind, end) in code points, leftmost first.

    ``split`` gives what stands between the matches and ``regexp_extract_all``
    the matches; running sums of both lengths give the places.
    """
    pattern = F.lit(rule.pattern)

    def placed(found: Column) -> Column:
        values = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
        both = F.arrays_zip(found.alias("m"), F.split(text, rule.pattern, -1).alias("g"), values.alias("v"))
        return named(F.slice(both, 1, F.size(found)), located)

    def located(parts: Column) -> Column:
        ends = prefix_sums(F.transform(parts, lambda x: F.length(x["g"]) + F.length(x["m"])))
        spans = F.zip_with(parts, ends, lambda x, end: F.when(F.length(x["v"]) >= rule.least, F.struct(
            (end - F.length(x["m"])).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
            end.alias("end"))))
        return F.filter(spans, lambda span: span.isNotNull())

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return named(found, lambda m: F.when(F.size(m) > 0, placed(m)))


def _scanned(docs: DataFrame, id_col: str, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """(row, text, spans): every row of ``docs``, and per rule its array of spans.

    Index and verification each read the texts once.  The candidates are
    written, so the planner knows their size: below its threshold they are
    broadcast and no text is shuffled, else they meet the texts in a join.
    """
    indexed = [r for r in rules if trigram_query(r.pattern)]
    proposed = written(candidates(docs, indexed, id_col, text_col), "candidates").withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(proposed, rows["id"].eqNullSafe(proposed["_id"]), "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    spans = []
    for order, rule in enumerate(rules):
        found = matches(F.col("text"), rule, order)
        if rule in indexed:
            found = F.when(F.array_contains("kinds", rule.kind), found)
        spans.append(F.coalesce(found, none).alias(rule.kind))
    return rows.select("row", "id", "text", F.struct(*spans).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         rules: Sequence[Rule] = BASE_RULES + OWN_RULES) -> DataFrame:
    """``(doc_id, <kind>...)``: per document one array of spans (start, order, kind, end) for every rule."""
    return _scanned(docs, id_col, text_col, rules).select(F.col("id").alias("doc_id"), "spans.*")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rules: Sequence[Rule] = BASE_RULES + OWN_RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, all columns and rows, with every secret in the text replaced by ``mark``.

    Spans that overlap become one mark; a null text stays null.
    """
    found = _scanned(docs, id_col, text_col, rules)
    text = F.col("text")

    def cleaned(spans: Column) -> Column:
        """Spans by start, in blocks; a block looks only at its own part of the text."""
        blocks = F.transform(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)),
                             lambda first: F.slice(spans, first, F.lit(BLOCK)))
        return named(blocks, lambda some: named(
            running(F.transform(some, lambda block: F.array_max(F.transform(block, lambda s: s["end"]))), F.greatest),
            lambda ends: F.concat(
                F.array_join(F.transform(some, lambda block, k: replaced(
                    block, F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0)), F.get(ends, k))), ""),
                text.substr(F.element_at(ends, -1) + 1, F.length(text)))))

    def replaced(block: Column, begin: Column, end: Column) -> Column:
        def step(part: Column, acc: Column, s: Column) -> Column:
            before = F.concat(acc["out"], part.substr(acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                            F.when(s["start"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

        return named(text.substr(begin + 1, end - begin), lambda part: F.aggregate(
            block, F.struct(begin.alias("at"), F.lit("").alias("out")), lambda acc, s: step(part, acc, s),
            lambda acc: acc["out"]))

    spans = F.sort_array(F.concat(*[F.col(f"spans.{r.kind}") for r in rules]))
    clean = F.when(F.size(spans) > 0, named(spans, cleaned)).otherwise(F.col(f"row.{text_col}"))
    return found.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def listed(*spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(F.concat(*spans)), lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` summed up: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [F.col(r.kind) for r in BASE_RULES]
    everything = [F.col(r.kind) for r in BASE_RULES + OWN_RULES]
    return scan(docs, id_col, text_col).select(
        "doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(listed(*base), 256).alias("base_sha256"), listed(*everything).alias("spans"))
