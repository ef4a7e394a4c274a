"""The training-text pipeline: toxicity, near duplicates, benchmark leaks, secrets, mixture.

Every stage is ``f(spark, docs, sf_dir)`` over what its predecessor kept and
returns the columns of ``documents``; the last adds ``copies``, how often the
mixture reads a document.  Rows are recognized by their id and a hash of all
their columns, so null and repeated ids are no trouble; other columns, whatever
their names, come through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from basketlens.session import delete, scratch_path, scratch_scope, written

BITMAP_BITS = 1 << 25   # of the filter that goes to all tasks: 4 MB, whatever the input
PAGE_BITS = 1 << 15     # fixed: what bitmap_construct_agg holds


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with a number if ``docs`` has a column of that name (in any case)."""
    taken, number, found = {c.lower() for c in docs.columns}, 2, name
    while found.lower() in taken:
        number, found = number + 1, f"{name}_{number}"
    return found


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its rows, and the name of that column."""
    key = free_name(docs, "_row_key")
    return docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64(*_all(docs)).alias("hash"))), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in the written list ``gone`` (key).

    A bitmap of the hashes of the listed keys, bounded in size, tells which
    rows may be in the list; only those take part in the anti-join, so hardly a
    text that stays is shuffled, however long the list is.
    """
    spot = F.pmod(F.xxhash64("key"), F.lit(BITMAP_BITS))
    page, bits, listed = (free_name(docs, name) for name in ("_page", "_bits", "_listed"))
    pages = (gone.select(F.floor(spot / PAGE_BITS).cast("int").alias(page), (spot % PAGE_BITS).alias("bit"))
             .groupBy(page).agg(F.bitmap_construct_agg("bit").alias(bits)))
    spot = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    bit = spot % PAGE_BITS
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (docs.withColumn(page, F.floor(spot / PAGE_BITS).cast("int")).join(F.broadcast(pages), page, "left")
              .withColumn(listed, F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))))
    maybe = marked.where(F.col(listed)).select(*_all(docs)).join(gone.withColumnRenamed("key", key), key, "left_anti")
    return marked.where(~F.col(listed)).select(*_all(docs)).unionByName(maybe.select(*_all(docs)))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.accepted(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, similarity 0.8): the smallest id.

    Rows that are equal in all columns share a key; only those meet in a
    second step that keeps one of them.  Texts without words all stay.
    """
    keyed, key = _keyed(docs)
    groups = written(ngram_join.jaccard_components(keyed, n=5, percent=80, id_col=key)
                     .where("n_shingles > 0").groupBy(F.col("doc_id").alias("key"))
                     .agg(F.first("component_id").alias("kept"), F.count(F.lit(1)).alias("rows")), "groups")
    gone = written(groups.where("key <> kept").select("key"), "gone")
    equal = written(groups.where("key = kept and rows > 1").select("key"), "equal")
    single = _without(keyed, key, gone.unionByName(equal))
    merged = keyed.join(equal.withColumnRenamed("key", key), key, "left_semi").dropDuplicates([key])
    return single.unionByName(merged.select(*_all(keyed))).select(*_all(docs))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its 5-word shingles) go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, key = _keyed(docs)
    leaks = decontaminate.contaminated(keyed, items, id_col=key)
    return _without(keyed, key, written(leaks.select(F.col("doc_id").alias("key")).distinct(), "leaks")).select(*_all(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; ``n_chars`` follows the text."""
    keyed, key = _keyed(docs)
    clean = secrets.redacted(keyed, id_col=key).select(*_all(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                            .otherwise(F.col("n_chars"))).select(*_all(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their ``copies``; sources come to their target weights.

    If the documents have a column of that name, the added one is ``copies_2``.
    """
    return mixing.mix(docs, whole_rows=True, copies_col=free_name(docs, "copies"))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None   # SQL can't express the fitted model and the subset sums; tests/llm checks every stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Once a stage's result is written, its
    intermediate tables and the result before it are deleted; the last stage's stay."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
