"""Quality rules with adaptive thresholds per language and source.

Fixed base rules mark broken documents.  For every (language, source) a
mergeable KLL quantile sketch per ratio, over the rows that pass the base
rules, gives the group's own limits.  A group's body reaches from its low side
up to the first gap between its quantiles; the limit is a fence above the body,
so a group used to tables or symbols is judged by its own spread and junk
beyond a gap does not raise the limit, however much there is.  Where the body
is nothing but zeros (most texts hold no symbol) it has no spread, and a second
sketch, of the ratios above zero, gives the limit: within the gap before them
if there is one, else above their own body.  The sketches
merged by language, or over all rows, judge groups that are too small, and
bound the limits of groups that are partly usual but hold much junk.  Documents
and limits are joined and filtered.  Built-in functions only.

Defined cases: null or empty text has no words and fails the base rules; null
language or source is a group of its own; repeated rows count and are judged
each by itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.session import written

SPACES = "\t\n\x0b\x0c\r "   # fixed: the white space that separates words
SYMBOLS = "#*$%&|<>"         # fixed: the characters counted as symbols

SKETCH_K = 1024              # size of a sketch: exact up to that many rows, beyond a rank error of about 0.3 per cent
RANKS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98)   # where a group's quantiles are read, low side first
FENCE = 1.0                  # spreads of the body (its end less its low side) beyond its end that are still usual
# The least distance of a limit from the end of the body; a step of half of it is a gap.
FLOORS = {"symbol_ratio": 0.1, "dup_line_ratio": 0.35, "repeat_ratio": 0.3}
GAP_SHARE = 1 / 3            # of the gap between a body of zeros and the ratios above zero: where the limit stands
GROUP_ROWS = 20              # with fewer rows (or ratios above zero) a group has no limits of its own
MIXED = (0.1, 0.75)          # quantiles below and above its language's limit: the group is part usual, part junk


def words(text: Column) -> Column:
    """The runs without ASCII white space, in order; null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(ws: Column) -> Column:
    """How many words stand in a 3-word window found twice or more in the text.

    Windows are hashed (64 bits), sorted with their position, and kept where a neighbour
    has the same hash; the kept positions, in order, cover 3 words each less
    what the next one covers too.
    """
    def positions(s: Column) -> Column:
        n = F.size(s)
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"]))
            | ((k < n - 1) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"])), F.get(s, k)["i"]))
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        total = F.aggregate(
            p, F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["words"] + F.least(F.lit(3), i - acc["last"])).alias("words"), i.alias("last")))
        return total["words"]

    def let(value: Column, body) -> Column:   # names a value once, so that lambdas don't compute it again
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def chained(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                              lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))
        return covered(let(F.sort_array(windows), positions))

    return F.when(F.size(ws) >= 4, let(ws, chained)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(without(line, SPACES)) > 0)
    return (docs.withColumn("_words", words(F.col(text_col))).withColumn("_lines", lines)
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(without(text, SPACES)).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"))
            .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(F.col("_words")))
            .withColumn("_n_lines", F.size("_lines")).drop("_words", "_lines"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", fence: float = FENCE, floors: dict[str, float] = FLOORS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept)`` and the ratios, one row per document.

    Texts are read once: the counts are written as a narrow table, which the
    sketches and the filter share.  Sketches are built per task and merged, so
    a hot source costs nothing, and merged again by language and over all; the
    thresholds table has one row per group and a measured size, and is broadcast only under the planner's threshold.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                       F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    counts = written(
        measured(rows).drop("text")
        .withColumn("symbol_ratio", F.col("n_symbols") / n)
        .withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)))
        .withColumn("repeat_ratio", F.col("n_repeat_words") / n).drop("_n_lines")
        .withColumn("base_failed", (F.col("n_words") < 50)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality")
    thresholds = written(_thresholds(counts, fence, floors), "thresholds")
    usual = F.lit(True)
    for ratio in floors:
        usual = usual & (F.col(ratio) <= F.col(f"{ratio}_limit"))
    group = counts["lang"].eqNullSafe(thresholds["_lang"]) & counts["source"].eqNullSafe(thresholds["_source"])
    return (counts.join(thresholds, group)
            .withColumn("kept", ~F.col("base_failed") & usual)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", *floors))


def _thresholds(counts: DataFrame, fence: float, floors: dict[str, float]) -> DataFrame:
    """(_lang, _source, {ratio}_limit): one row per group."""
    sound = ~F.col("base_failed")
    sketch = lambda r, rows: F.kll_sketch_agg_double(F.when(rows, F.col(r)), F.lit(SKETCH_K))
    own = written(counts.groupBy("lang", "source").agg(
        F.count_if(sound).alias("n"),
        *[sketch(r, sound).alias(r) for r in floors],
        *[F.count_if(sound & (F.col(r) > 0)).alias(f"{r}_n_pos") for r in floors],
        *[sketch(r, sound & (F.col(r) > 0)).alias(f"{r}_pos") for r in floors]), "sketches")
    merged = [F.sum("n").alias("n")]
    for r in floors:
        merged += [F.sum(f"{r}_n_pos").alias(f"{r}_n_pos"),
                   *[F.kll_merge_agg_double(c, F.lit(SKETCH_K)).alias(c) for c in (r, f"{r}_pos")]]
    above = lambda least: [F.when(F.col(f"{r}_n_pos") >= least, _above_zero(f"{r}_pos", fence, floor))
                           .alias(f"{r}_above") for r, floor in floors.items()]
    named = lambda to: [F.col(f"{r}_{c}").alias(f"{r}_{c}_{to}") for r in floors for c in ("above", "fence")]
    overall = own.agg(*merged).select("*", *above(1))
    overall = overall.select("*", *[F.when(F.col("n") > 0, _limit(r, fence, floor, [f"{r}_above"])).alias(f"{r}_fence")
                                    for r, floor in floors.items()]).select(*named("overall"))
    by_lang = own.groupBy("lang").agg(*merged).select("*", *above(GROUP_ROWS)).crossJoin(overall)
    by_lang = by_lang.select(
        F.col("lang").alias("_in"), *[f"{r}_above_overall" for r in floors], *[f"{r}_fence_overall" for r in floors],
        *[F.col(f"{r}_above").alias(f"{r}_above_lang") for r in floors],
        *[F.when(F.col("n") >= GROUP_ROWS, _limit(r, fence, floor, [f"{r}_above", f"{r}_above_overall"]))
          .alias(f"{r}_fence_lang") for r, floor in floors.items()])
    rows = own.select("*", *above(GROUP_ROWS)).join(by_lang, F.col("lang").eqNullSafe(F.col("_in")))
    limits = []
    for r, floor in floors.items():
        usual = F.coalesce(f"{r}_fence_lang", f"{r}_fence_overall")
        mine = _limit(r, fence, floor, [f"{r}_above", f"{r}_above_lang", f"{r}_above_overall"])
        limits.append(F.when(F.col("n") < GROUP_ROWS, usual)
                      .when((q(r, MIXED[0]) <= usual) & (q(r, MIXED[1]) > usual), F.least(mine, usual))
                      .otherwise(mine).alias(f"{r}_limit"))
    return rows.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *limits)


def _body(sketch: str, floor: float) -> tuple[Column, Column]:
    """The low side and the end of the body of a sketch that has rows."""
    at = F.array(*[q(sketch, rank) for rank in RANKS])
    low = F.get(at, F.lit(0))
    return low, F.aggregate(at, low, lambda end, value: F.when(value - end <= floor / 2, value).otherwise(end))


def _above_zero(sketch: str, fence: float, floor: float) -> Column:
    """The limit of a body of zeros, from the sketch of the ratios above zero."""
    low, end = _body(sketch, floor)
    return F.when(low > floor, low * GAP_SHARE).otherwise(end + F.greatest(F.lit(floor), F.lit(fence) * (end - low)))


def _limit(ratio: str, fence: float, floor: float, above: list[str]) -> Column:
    """The fence above the body of a sketch that has rows; for a body of zeros the first limit known in ``above``."""
    low, end = _body(ratio, floor)
    return F.when(end == 0, F.coalesce(*above, F.lit(floor))).otherwise(
        end + F.greatest(F.lit(floor), F.lit(fence) * (end - low)))


def q(ratio: str, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(ratio, F.lit(rank))
