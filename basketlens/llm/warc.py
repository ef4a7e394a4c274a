"""WARC archives: writing, and reading by boundary-chain verification.

Writing: one text row per record with the record separator as line separator,
so Spark's own writer produces plain WARC/1.1 files in any store.  Payloads
met before are written as ``revisit`` records without a body.

Reading: files are split at every occurrence of the version line, wherever it
stands -- also inside a payload.  Each piece is a candidate record: tasks emit
its offset and, from its Content-Length, the offset of its successor.  Pointer
jumping from the start of each file then keeps the candidates that the chain
reaches; magic inside a payload is never reached.  Built-in functions only.

Defined cases: a null or empty payload gives an empty body (0 bytes); a null
id is written as an empty record id and read back as null; repeated rows give
repeated records; an empty table gives no archive and no rows.  A file must start with a
record; from a damaged record on, the rest of its file is unreachable and so
not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.session import scratch_path, written

# Fixed values of the format.
VERSION_LINE = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
HEADER_END = "\r\n\r\n"

# Engineering limit: records of one file, so that a chain has a bounded number of doublings.
RECORDS_PER_FILE = 4096


def _binary(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def deduplicated(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                 least_bytes: int = 1000) -> DataFrame:
    """``(page_id, html, refers_to)``: of rows with equal payloads of at least
    ``least_bytes`` bytes all but the one with the largest id refer to that one.

    Only (id, digest) rows are shuffled to find the repeats; the written list
    of repeats meets the payloads in a broadcast when its file size is under
    the planner's threshold, else in a join on the id.  The digest counts are
    pre-aggregated, and one hot digest is split by the adaptive skew join.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(payload_col).cast("string").alias("html"))
    payload = _binary(F.col("html"))
    digests = (source.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
               .where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()))
    first = (digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
             .where(F.col("least") != F.col("refers_to")))
    repeats = written(digests.join(first, "digest").where(F.col("page_id") != F.col("refers_to"))
                      .select("page_id", "digest", "refers_to").distinct(), "revisits")
    repeats = repeats.withColumnRenamed("page_id", "repeat_id")
    same = (source["page_id"] == repeats["repeat_id"]) & (F.sha1(payload) == repeats["digest"])
    return source.join(repeats, same, "left").select("page_id", "html", "refers_to")


def record(page_id: Column, html: Column, refers_to: Column, url: Column | None = None) -> Column:
    """One record as text: version line, headers, blank line, body (none for a revisit)."""
    payload = _binary(html)
    revisit = refers_to.isNotNull()
    header = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    uri = lambda c: F.concat(F.lit("<urn:page:"), name(c), F.lit(">"))
    return F.concat(
        F.lit(VERSION_LINE),
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", uri(page_id)),
        F.when(revisit, header("WARC-Refers-To", uri(refers_to))).otherwise(F.lit("")),
        F.lit("") if url is None else F.when(url.isNotNull(), header(
            "WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", ""))).otherwise(F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload))),
        header("WARC-Payload-Length", F.octet_length(payload).cast("string")),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.octet_length(payload).cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.coalesce(html, F.lit(""))),
    )


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
          least_bytes: int = 1000) -> None:
    """Write the archives of ``pages`` into the folder ``path``."""
    rows = deduplicated(pages, id_col, payload_col, least_bytes)
    (rows.select(record(F.col("page_id"), F.col("html"), F.col("refers_to")).alias("value"))
     .write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between version lines: (file, block, nth, value, n_bytes).

    A row of the text reader ends at a version line, also beyond its split, so
    the rows of the splits follow one another without gaps.
    """
    return (spark.read.option("lineSep", VERSION_LINE).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("nth"), "value",
                    (F.octet_length("value") + len(VERSION_LINE)).cast("long").alias("n_bytes")))


def _located(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``at``, the offset in the file of the version line before them.

    Running sums inside each split, plus the sum of the earlier splits of the
    file (one row per split).  What precedes the first version line of a file
    is no candidate and dropped.
    """
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (pieces.groupBy("file", "block").agg(F.sum("n_bytes").alias("block_bytes"))
              .select("file", "block", F.coalesce(F.sum("block_bytes").over(earlier), F.lit(0)).alias("start")))
    return (pieces.withColumn("inside", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
            .join(starts, ["file", "block"])
            .withColumn("at", F.col("start") + F.col("inside") - len(VERSION_LINE))
            .where(F.col("at") >= 0).drop("start", "inside", "block", "nth", "n_bytes"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def reachable(links: DataFrame) -> DataFrame:
    """The ``(file, at)`` of ``links`` (file, at, successor) on the chain of
    successors that starts at offset 0 of each file, by pointer jumping.

    After round k the first 2**k records of every file are known and a pointer
    spans 2**k records: joining both doubles the known ones, joining the
    pointers with themselves doubles their span.  A file of n records takes
    log2(n) rounds, each a written table.  Offsets are unique in a file, so the
    joins have no hot key and one huge file is spread like many small ones.
    They are merge joins by hint: such tables are tiny as files and large in
    memory, so the planner would broadcast what grows with the archives.
    """
    starts = links.select("file", "at")
    hops = written(links.select("file", "at", F.col("successor").alias("to"))
                   .join(starts.withColumnRenamed("at", "to").hint("merge"), ["file", "to"])
                   .select("file", "at", "to"), "hops")
    known = fresh = written(starts.where(F.col("at") == 0), "reached")
    while not fresh.isEmpty():
        fresh = written(known.join(hops.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at")), "reached")
        known = known.unionByName(fresh)
        further = hops.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        hops = written(hops.join(further.hint("merge"), ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "hops")
    return known


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in the folder ``path``: ``(file, at, header,
    content_length, payload_sha1)``; the digest is of the body as read back.

    Bodies are digested where they are scanned.  Only a body that holds a
    version line spans several pieces; those are put together in a second pass.
    """
    pieces = _pieces(spark, path)
    facts = (pieces.withColumn("header", F.substring_index("value", HEADER_END, 1))
             .withColumn("body_at", F.octet_length("header") + len(HEADER_END))
             .withColumn("content_length", F.regexp_extract(
                 "header", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1).try_cast("long"))
             .withColumn("whole", F.col("body_at") + F.col("content_length") + len(RECORD_END)
                         <= F.octet_length("value"))
             .withColumn("payload_sha1", F.when(F.col("whole"), F.sha1(F.substring(
                 F.col("value").cast("binary"), F.col("body_at") + 1, F.col("content_length").cast("int"))))))
    facts = written(_located(facts.drop("value")), "warc")
    links = (facts.where(F.col("content_length").isNotNull())
             .withColumn("successor", F.col("at") + len(VERSION_LINE) + F.col("body_at")
                         + F.col("content_length") + len(RECORD_END)))
    records = written(links.join(reachable(links).hint("merge"), ["file", "at"]), "records")
    spanning = records.where(~F.col("whole"))
    columns = ["file", "at", "header", "content_length", "payload_sha1"]
    if spanning.isEmpty():
        return records.select(columns)
    # pieces from a spanning record up to the next record of its file belong to it
    owner = F.last("start", ignorenulls=True).over(
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marks = records.select("file", "at", F.col("at").alias("start"), "whole", "body_at", "content_length")
    owned = (facts.select("file", "at").join(marks.select("file", "at", "start"), ["file", "at"], "left")
             .withColumn("owner", owner).select("file", "at", "owner"))
    owned = owned.join(spanning.select("file", F.col("at").alias("owner")), ["file", "owner"])
    bodies = (_located(pieces).join(owned, ["file", "at"])
              .groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
              .select("file", F.col("owner").alias("at"), F.array_join(
                  F.col("parts.value"), VERSION_LINE).cast("binary").alias("whole_body")))
    joined = (spanning.drop("payload_sha1").join(bodies, ["file", "at"])
              .withColumn("payload_sha1", F.sha1(F.substring(
                  F.col("whole_body"), F.col("body_at") + 1, F.col("content_length").cast("int")))))
    return records.where("whole").select(columns).unionByName(joined.select(columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
               least_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: ``(page_id, payload_bytes,
    payload_digest, record_type, refers_to)``, one row per page."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archives")
    write(pages, path, id_col, payload_col, least_bytes)
    number = lambda name: F.regexp_extract(_field(name), "<urn:page:(.*)>", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return (read(spark, path)
            .withColumn("record_type", _field("WARC-Type"))
            .select(number("WARC-Record-ID").alias("page_id"),
                    F.when(revisit, _field("WARC-Payload-Length").cast("long"))
                    .otherwise(F.col("content_length")).alias("payload_bytes"),
                    F.when(revisit, F.substring_index(_field("WARC-Payload-Digest"), ":", -1))
                    .otherwise(F.col("payload_sha1")).alias("payload_digest"),
                    "record_type", number("WARC-Refers-To").alias("refers_to")))
