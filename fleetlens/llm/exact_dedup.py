"""Exact dedup by a content sort: equal texts end up next to each other and are compared whole.

Sampled splitters cut the rows into ranges of their normalised bytes. Inside a range
Spark sorts, spilling to disk as it needs to, and every text is compared with the one
before it. A group of copies may span many ranges: the splitters hold row identity too, so
that it is cut like anything else, and the ends of neighbouring ranges are compared the same way.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.ranges import splitters
from fleetlens.sources.scratch import stored

#: Characters of a text that lead its sort key. The digest follows them, then the whole text.
LEADING = 24
_KEY = "lead string, digest string, no_id boolean, id bigint, row bigint"


def normalised(text: Column) -> Column:
    """``text`` with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _sorted_ranges(docs: DataFrame, keep_text: bool) -> DataFrame:
    """Every row with its range, its place there and the run of equal texts it stands in.

    ``size`` and ``first_id`` are those of the run within the range. The texts at both ends of
    a range stay, to be compared with the neighbouring ranges.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalised(F.col("text")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    key = {
        "lead": F.left("text", F.lit(LEADING)),
        "digest": F.sha2("text", 256),
        "no_id": F.col("doc_id").isNull(),
        "id": F.coalesce("doc_id", F.lit(0)),
        "row": F.col("row"),
    }
    # Any stretch of bytes costs at least a row's overhead.
    cuts = splitters(rows, key, _KEY, F.octet_length("text") + 64)
    placed = rows.select("*", *[c.alias(k) for k, c in key.items() if k != "row"])
    placed = placed.withColumn("range", cuts.range_of(F.struct(*key)))
    # Equal texts have one lead and one digest, so they are adjacent; nothing but the whole text makes them equal.
    order = Window.partitionBy("range").orderBy("lead", "digest", "text", "no_id", "id", "row")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    compared = (
        placed.withColumn("place", F.row_number().over(order))
        .withColumn("opens", F.coalesce(F.lag("text").over(order) != F.col("text"), F.lit(True)))
        .withColumn("ends", F.lead(F.lit(1)).over(order).isNull())
        .withColumn("run", F.sum(F.col("opens").cast("long")).over(upto))
    )
    here = Window.partitionBy("range", "run")
    return compared.select(
        "doc_id",
        "range",
        "place",
        "run",
        "opens",
        "ends",
        F.col("digest").alias("text_sha256"),
        *(["text"] if keep_text else []),
        F.when((F.col("place") == 1) | F.col("ends"), F.col("text")).alias("end_text"),
    ).select(
        "*",
        F.count("*").over(here).alias("size"),
        F.max(F.when(F.col("opens"), F.col("doc_id"))).over(here).alias("first_id"),
    )


def _joined_runs(ranges: DataFrame) -> DataFrame:
    """``range, run, keep_id, group_size, heads`` for the runs of groups that span ranges; ``heads``: it is the first.

    At most two runs a range, and one window over one small row a range.
    """
    first = ranges.filter("place = 1").select("range", F.col("end_text").alias("first_text"))
    last = ranges.filter("ends").select(
        F.col("range").alias("before"), F.col("run").alias("runs"), F.col("end_text").alias("last_text")
    )
    # Ranges without rows are passed over.
    in_order = Window.orderBy("before")
    last = last.withColumn("next", F.lead("before").over(in_order))
    going_on = (
        last.join(first, F.col("next") == F.col("range")).filter("last_text = first_text").select("range", F.lit(True).alias("goes_on"))
    )
    marked = last.join(going_on, last["before"] == going_on["range"], "left").select(
        F.col("before").alias("range"), "runs", F.coalesce("goes_on", F.lit(False)).alias("goes_on")
    )
    # A range's last run begins a group unless it is also the first and goes on.
    opener = F.when((F.col("runs") > 1) | ~F.col("goes_on"), F.struct("range", F.col("runs").alias("run")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    linked = (
        marked.withColumn("head", F.last(opener, ignorenulls=True).over(before))
        .filter("goes_on")
        .select("range", F.lit(1).cast("long").alias("run"), "head")
    )
    heads = linked.select(F.col("head.range").alias("range"), F.col("head.run").alias("run"), "head").distinct()
    members = linked.withColumn("heads", F.lit(False)).union(heads.withColumn("heads", F.lit(True)))
    runs = ranges.filter("opens").select("range", "run", "size", "first_id")
    sized = members.join(runs, ["range", "run"])
    groups = sized.groupBy("head").agg(
        F.sum("size").alias("group_size"), F.max(F.when(F.col("heads"), F.col("first_id"))).alias("keep_id")
    )
    return sized.join(groups, "head").select("range", "run", "keep_id", "group_size", "heads")


def exact_groups(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, its texts equal to those of its group.

    Texts are equal if they are once each run of ASCII white space is one space; null is
    empty, and leading or trailing space counts. ``kept`` is true for exactly one row of a group: one with the
    smallest doc_id, null last. Its doc_id is ``keep_id``, null only where all are null. Rows that
    repeat an id stay rows, and all but one of repeated rows are dropped. ``keep_text`` adds the
    normalised text: filter by ``kept`` for the deduplicated documents. An empty table
    gives an empty one. Only ``doc_id`` and ``text`` are read, whatever other columns are called.
    ``docs`` should be a scan or a written table: it is read three times.
    """
    ranges = stored(_sorted_ranges(docs, keep_text), "exact_ranges")
    joined = stored(_joined_runs(ranges), "exact_joined")
    return ranges.join(
        joined.select("range", "run", F.col("keep_id").alias("group_keep"), F.col("group_size").alias("whole"), "heads"),
        ["range", "run"],
        "left",
    ).select(
        "doc_id",
        F.when(F.col("whole").isNull(), F.col("first_id")).otherwise(F.col("group_keep")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"),
        (F.col("opens") & F.coalesce("heads", F.lit(True))).alias("kept"),
        "text_sha256",
        *(["text"] if keep_text else []),
    )
