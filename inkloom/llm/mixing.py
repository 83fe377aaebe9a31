"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are taken in the order
of their keys up to the source's exact budget of tokens, after as many whole
rounds as it needs. Prefix sums are distributed: sums over ranges of keys first
(a bounded number for each source), then over the parts of the one range in
which the budget ends, and so on until that range holds few documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Bits of the key that a range is divided by: 4,096 ranges for each source.
BITS = 12
#: Documents of a source that are sorted in one task at most.
SORTED = 200_000


FIELDS = ("id", "source", "size", "rounds", "extra")


def _placed(scratch: Scratch, docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs(source, range, before, rest, ...), before being the tokens that precede
    all of them, with the state of their range: in the budget's rest, out of it or
    cut by it; before counts up to the range then."""
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.withColumn("upto", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    heads = docs.groupBy("source").agg(F.first("before").alias("start"), F.first("rest").alias("rest"))
    starts = sums.join(heads, "source").withColumn("start", F.col("start") + F.col("upto"))
    state = F.when(F.col("start") + F.col("tokens") <= F.col("rest"), "in").when(F.col("start") >= F.col("rest"), "out").otherwise("cut")
    starts = scratch.keep(starts.select("source", "range", "start", state.alias("state")))
    # at most as many rows as sources times ranges
    return docs.join(F.broadcast(starts), ["source", "range"]).withColumn("before", F.col("start")).drop("start")


def mix_sources(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_tokens", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of documents sizes(id, source, size) and targets(source,
    target_share, max_repeats).

    mix: id, source, copies (1 to max_repeats), size; report: for each listed
    source its target and reached share, tokens, documents and largest number
    of copies. The total is the largest at which every source that has any
    tokens reaches its share of them without a document used more than
    max_repeats times; a source that holds none reaches 0 and the others keep
    their proportions. A source's last document is taken if that brings it
    nearer to its budget.

    Documents of unlisted or null sources and those without tokens are left
    out; targets that are null or not positive count as 0, max_repeats below 1
    as 0; equal keys are settled by the id; a document in several equal rows
    counts once; with nothing to mix the mix is empty.
    """
    scratch = Scratch(sizes.sparkSession)
    t = targets.groupBy(F.col("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    docs = (
        sizes.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"))
        .filter("size > 0").join(F.broadcast(t.select("source")), "source", "left_semi").distinct()
        .withColumn("key", F.xxhash64(F.col("id").cast("string"), F.lit(seed)))
        .withColumn("range", F.shiftrightunsigned("key", 64 - BITS))
    )
    docs = scratch.keep(docs)
    # at most as many rows as sources times ranges, from here to the budgets
    ranges = scratch.keep(docs.groupBy("source", "range").agg(F.sum("size").alias("tokens"), F.count("*").alias("docs")))
    plan = t.join(ranges.groupBy("source").agg(F.sum("tokens").alias("have"), F.sum("docs").alias("docs")), "source", "left")
    usable = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    # integers from here on: the same cut on every run
    total = plan.filter(usable).agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share")).alias("total")).first()["total"]
    budget = F.when(usable, F.least(F.round(F.lit(total or 0.0) * F.col("target_share")).cast("long"), F.col("have") * F.col("max_repeats"))).otherwise(0)
    plan = plan.withColumn("budget", budget).withColumn("rounds", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("int"))
    plan = scratch.keep(plan.withColumn("rest", F.when(F.col("have") > 0, F.col("budget") - F.col("rounds") * F.col("have")).otherwise(0)))
    budgets = plan.select("source", "rest", "rounds")
    pending = docs.join(F.broadcast(budgets), "source").withColumn("before", F.lit(0).cast("long"))
    settled, shift = [], 64 - BITS
    while True:
        placed = _placed(scratch, pending, ranges)
        settled.append(placed.filter("state <> 'cut'").withColumn("extra", (F.col("state") == "in").cast("int")).select(*FIELDS))
        pending = scratch.keep(placed.filter("state = 'cut'").drop("state", "range"))
        if shift < BITS or pending.groupBy("source").count().filter(F.col("count") > SORTED).isEmpty():
            break
        shift -= BITS
        pending = pending.withColumn("range", F.shiftrightunsigned("key", shift).bitwiseAND((1 << BITS) - 1))
        ranges = pending.groupBy("source", "range").agg(F.sum("size").alias("tokens"))
    # only the last range in which a budget ends needs the order of its documents
    order = Window.partitionBy("source").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = pending.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # taken if more than half of it lies below the budget; at a tie it is not
    settled.append(cut.withColumn("extra", (2 * (F.col("rest") - F.col("at")) > F.col("size")).cast("int")).select(*FIELDS))
    copies = F.col("rounds") + F.col("extra")
    mix = scratch.keep(functools.reduce(DataFrame.union, settled).withColumn("copies", copies).filter("copies > 0").select("id", "source", "copies", "size"))
    used = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    reached = used.agg(F.sum("tokens").alias("n")).first()["n"]
    report = t.join(used, "source", "left")
    report = report.select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / F.lit(reached or 1), F.lit(0.0)).alias("actual_share"),
    )
    return mix.withColumnRenamed("id", id_col).withColumnRenamed("source", source_col).withColumnRenamed("size", size_col), report
