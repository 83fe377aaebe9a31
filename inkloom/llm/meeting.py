"""Postings that meet over a key, however many share it.

A key may be held by a third of all rows. Whether it occurs in more than one
text is told by an aggregation with partial results, and texts of a key meet in
blocks, so that no group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Postings of a key on one side of a task when they are met with each other.
BLOCK = 2_000


def in_several(postings: DataFrame, size: Column | None = None) -> DataFrame:
    """The postings (h, d, ...), already written, whose h occurs with another d,
    with n, the sum of size over the key where size is given. Texts are told apart
    by a 64-bit hash of d, for an aggregation in fixed memory with partial results;
    no posting of such a key is left out."""
    c = F.xxhash64("d")
    sums = [] if size is None else [F.sum(size).alias("n")]
    keys = postings.groupBy("h").agg(F.min(c).alias("lo"), F.max(c).alias("hi"), *sums).filter("lo <> hi").drop("lo", "hi")
    return postings.join(keys, "h")


def in_several_once(postings: DataFrame) -> DataFrame:
    """As in_several() for postings that aren't written: they are shuffled by h once,
    and both the aggregation and the join read that shuffle. For keys that few texts
    share (bands of similar texts, not boilerplate): one of very many texts is
    streamed through a single task, in fixed memory."""
    spread = postings.repartition("h")
    # all columns are used on either side, so that the two are the same exchange
    c = F.xxhash64(*[x for x in postings.columns if x != "h"])
    keys = spread.groupBy("h").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).filter("lo <> hi").select("h")
    return spread.join(keys.hint("merge"), "h")


def counted(postings: DataFrame) -> DataFrame:
    """postings with n, the number of those with their key."""
    return postings.join(postings.groupBy("h").agg(F.count("*").alias("n")), "h")


def meet(groups: DataFrame, *also: str) -> DataFrame:
    """d1 < d2: texts of (h, d, n, ...) with a key in common, each pair once per
    key, with the columns of `also` of either side (as x1, x2). n is the number of
    postings of the key or more; a key with many is met in blocks: a posting
    belongs to one block on the left and is compared with that of each on the right."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = groups.select("h", F.pmod(F.xxhash64("d"), blocks).cast("int").alias("block"), F.col("d").alias("d1"), *[F.col(c).alias(f"{c}1") for c in also])
    right = groups.select("h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("d").alias("d2"), *[F.col(c).alias(f"{c}2") for c in also])
    return left.join(right, ["h", "block"]).filter(F.col("d1") < F.col("d2")).drop("h", "block")
