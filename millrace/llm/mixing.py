"""Mixing sources to target weights by a low-discrepancy schedule (problem 7).

Each source's documents are shuffled by hash and laid end to end; blocks of equal token count are cut
from that line, through documents where they fall. Slot k of the mix has the point frac(k * golden ratio), which falls into the part of
[0, 1) that the cumulative weights give to one source; the slots of a source, ranked in order, take its
blocks one after the other, then again from the first, at most ``max_repeats`` times. So every stretch
of the mix has nearly the weights of the whole.

How much a source gives: the mix is the longest in which every listed source that has tokens reaches
its target, so its length is set by the source that is first at ``max_repeats`` passes; the target of
sources without tokens is spread over the others in proportion. With ``one_pass`` the mix is as long as
one pass over the listed sources instead: sources beyond their caps give ``max_repeats`` passes, and what
is missing is spread over the others in proportion to their targets, as far as their caps allow.

Ranks and running sums are made in two steps, within buckets and over buckets, so that no task ever
holds a whole source. Sources that are null or not listed take no part; listed sources without tokens
are reported with a share of 0. Documents of no tokens are in no block. Repeated targets of a source
count once, the greatest; null or negative targets and caps count as 0.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut

GOLDEN = 0.6180339887498949
BLOCK_TOKENS = 8_192
BUCKETS, BUCKET_ROWS = 512, 200_000


def running_sum(df: DataFrame, group: str, bucket: str, order: list[str], value: str, before: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows that precede a row in its group.

    The order is that of ``bucket``, then of ``order``. Only rows of one bucket meet in a task; the
    buckets' sums are few: groups times buckets.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return placed.join(starts, [group, bucket]).withColumn(before, F.col("_start") + F.col("_within")).drop("_start", "_within", "_sum")


def allotments(sizes: DataFrame, targets: DataFrame, one_pass: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, available, tokens, weight): what each listed source is to give.

    ``sizes``: (source, available), one row per source. The table has one row per listed source; sources
    fill up to their caps in the order of cap by target, so one running sum finds the level of the rest.
    """
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    known = listed.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    known = known.withColumn("_cap", F.col("available") * F.col("max_repeats")).withColumn("_one", F.lit(1))
    whole = Window.partitionBy("_one")  # one row per listed source
    total = F.sum("available").over(whole)
    ratio = F.when(F.col("target_share") > 0, F.col("_cap") / F.col("target_share")).otherwise(F.lit(0.0))
    known = known.withColumn("_total", total).withColumn("_ratio", ratio)
    upto = whole.orderBy("_ratio", "source")
    before, after = upto.rowsBetween(Window.unboundedPreceding, -1), upto.rowsBetween(0, Window.unboundedFollowing)
    usable = F.when(F.col("target_share") > 0, F.col("_cap")).otherwise(F.lit(0))
    known = known.withColumn("_level", (F.col("_total") - F.coalesce(F.sum(usable).over(before), F.lit(0))) / F.sum("target_share").over(after))
    usable_ratio = F.when((F.col("_cap") > 0) & (F.col("target_share") > 0), F.col("_ratio"))
    if not one_pass:
        known = known.withColumn("_level", F.min(usable_ratio).over(whole))
    capped = known.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    tokens = F.when(F.col("target_share") == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("target_share"), F.col("_cap").cast("double"))))
    given = capped.withColumn("tokens", tokens)
    return given.select("source", "target_share", "max_repeats", "available", "tokens", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(whole)), F.lit(0.0)).alias("weight"))


def blocks(documents: DataFrame, key: str, block_tokens: int = BLOCK_TOKENS, buckets: int = BUCKETS) -> DataFrame:
    """(source, block, key, first_token, n_tokens): the part of each document in each block that it reaches into.

    A block is ``block_tokens`` in a row of its source's shuffled line, so all but a source's last are equal,
    however long its documents are. ``first_token`` counts from 0 within the document.
    """
    mixed = F.xxhash64(F.col(key).cast("string"), F.lit("mix"))
    rows = documents.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("source", key, "n_tokens", mixed.alias("_hash"))
    rows = rows.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 20), F.lit(buckets)))
    line = running_sum(rows, "source", "_bucket", ["_hash", key], "n_tokens", "_before").withColumn("_behind", F.col("_before") + F.col("n_tokens"))
    reached = F.explode(F.sequence(F.floor(F.col("_before") / block_tokens), F.floor((F.col("_behind") - 1) / block_tokens))).alias("block")
    parts = line.select("source", key, "_before", "_behind", reached)
    begin, end = F.greatest("_before", F.col("block") * block_tokens), F.least("_behind", (F.col("block") + 1) * block_tokens)
    return parts.select("source", "block", key, (begin - F.col("_before")).alias("first_token"), (end - begin).alias("n_tokens"))


def schedule(spark_range: DataFrame, shares: DataFrame, block_counts: DataFrame) -> DataFrame:
    """(slot, source, block, copy): the slots' sources by their points, and the blocks that fill them.

    ``spark_range``: the slots as a column ``slot``; ``shares``: (source, weight, max_repeats), a row per
    listed source; ``block_counts``: (source, n_blocks).
    """
    # one row per listed source, so the parts of [0, 1) fit into an array literal
    parts = [(r["source"], r["weight"]) for r in shares.where("weight > 0").orderBy("source").select("source", "weight").collect()]
    ends = list(itertools.accumulate(w for _, w in parts))
    begins = [0.0, *ends[:-1]]
    ends = [*ends[:-1], 2.0]
    none = F.array().cast("array<struct<begin:double,end:double,source:string>>")
    table = F.array(*[F.struct(F.lit(b).alias("begin"), F.lit(e).alias("end"), F.lit(s).alias("source")) for b, e, (s, _) in zip(begins, ends, parts, strict=False)]) if parts else none
    slots = spark_range.withColumn("_point", F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN)))
    chosen = F.filter(table, lambda p: (p["begin"] <= F.col("_point")) & (F.col("_point") < p["end"]))
    slots = slots.select("slot", F.element_at(chosen, 1)["source"].alias("source"))
    slots = slots.withColumn("_bucket", F.floor(F.col("slot") / 65_536)).withColumn("_n", F.lit(1))
    ranked = running_sum(slots, "source", "_bucket", ["slot"], "_n", "_rank")
    rows = ranked.join(F.broadcast(shares.select("source", "max_repeats").join(block_counts, "source")), "source")
    rows = rows.withColumn("copy", F.floor(F.col("_rank") / F.col("n_blocks")) + 1)
    return rows.where(F.col("copy") <= F.col("max_repeats")).select("slot", "source", (F.col("_rank") % F.col("n_blocks")).alias("block"), "copy")


def mix(documents: DataFrame, key: str, targets: DataFrame, one_pass: bool = False, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of ``documents`` (key, source, n_tokens).

    ``mix``: (slot, source, copy, key, first_token, n_tokens), a row for each use of a part of a document. ``report``: a row per
    listed source with its target, cap, available tokens, planned and actual tokens, parts used,
    greatest copy and the share really reached.
    """
    spark = documents.sparkSession
    counted = cut(documents.select(key, "source", "n_tokens"))
    sizes = counted.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    shares = cut(allotments(sizes, targets, one_pass))  # a row per listed source
    buckets = max(BUCKETS, counted.count() // BUCKET_ROWS)
    placed = cut(blocks(counted.join(F.broadcast(shares.select("source")), "source", "left_semi"), key, block_tokens, buckets))
    block_counts = placed.groupBy("source").agg((F.max("block") + 1).alias("n_blocks"))
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    slots = spark.range(int(-(-total // block_tokens))).select(F.col("id").alias("slot"))
    plan = schedule(slots, shares, block_counts)
    mixed = plan.join(placed, ["source", "block"]).select("slot", "source", "copy", key, "first_token", "n_tokens")
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("actual_tokens"), F.count("*").alias("n_uses"), F.max("copy").alias("copies"))
    whole = Window.partitionBy(F.lit(1))
    report = shares.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.round("tokens").cast("long").alias("planned_tokens"),
        F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce(F.try_divide(F.coalesce("actual_tokens", F.lit(0)), F.sum("actual_tokens").over(whole)), F.lit(0.0)).alias("actual_share"),
    )
    return mixed, report
