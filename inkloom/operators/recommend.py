"""Likeness of items by signals and by vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from .vectors import cosine, norm


def signal_weights(events: DataFrame, signals: DataFrame, user: str, item: str, top: int = 12) -> DataFrame:
    """user, signal, weight: how often a user's items carry each signal of
    signals(item, signal); the `top` strongest of each user."""
    w = Window.partitionBy(user).orderBy(F.desc("weight"), F.asc_nulls_last("signal"))
    sums = events.join(signals, item).groupBy(user, "signal").agg(F.count("*").alias("weight"))
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).drop("rank")


def signal_scores(weights: DataFrame, signals: DataFrame, seen: DataFrame, user: str, item: str, top: int = 8) -> DataFrame:
    """user, item, score, matched: items by the weight of the signals they carry,
    those already seen left out.

    Items of the same signals are one class and have the same score. Of a class a
    user needs the first `top` items and as many more as were seen of it, and none
    if the classes of higher scores hold `top` unseen ones: so no user meets all
    items of a signal, whatever their number."""
    scratch = Scratch(weights.sparkSession)
    carried = signals.filter(F.col("signal").isNotNull()).groupBy(item, "signal").agg(F.count("*").alias("times"))
    items = scratch.keep(carried.groupBy(item).agg(F.sort_array(F.collect_list(F.struct("signal", "times"))).alias("carries")))
    classes = scratch.keep(items.groupBy("carries").agg(F.count("*").alias("size")).withColumn("class", F.monotonically_increasing_id()))
    placed = items.join(classes, "carries").select("class", item, F.row_number().over(Window.partitionBy("class").orderBy(F.asc_nulls_last(item))).alias("place"))
    placed = scratch.keep(placed)
    of = classes.select("class", "size", F.explode("carries").alias("c")).select("class", "size", "c.signal", "c.times")
    s = scratch.keep(weights.join(of, "signal").groupBy(user, "class").agg(F.sum(F.col("weight") * F.col("times")).alias("score"), F.max("size").alias("size"), F.array_join(F.sort_array(F.collect_set("signal")), ",").alias("matched")))
    known = scratch.keep(seen.join(placed, item).select(user, "class", "place").join(s.select(user, "class"), [user, "class"], "left_semi").distinct())
    s = s.join(known.groupBy(user, "class").agg(F.count("*").alias("known")), [user, "class"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    unseen = F.sum(F.col("size") - F.col("known"))
    above = unseen.over(Window.partitionBy(user).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - unseen.over(Window.partitionBy(user, "score"))
    s = s.withColumn("above", above).filter(F.col("above") < top)
    first = s.select(user, "class", "score", "matched", F.explode(F.sequence(F.lit(1), F.least("size", F.col("known") + top).cast("int"))).alias("place"))
    fresh = first.join(known, [user, "class", "place"], "left_anti").join(placed, ["class", "place"])
    w = Window.partitionBy(user).orderBy(F.desc("score"), F.asc_nulls_last(item))
    return fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(user, item, "score", "matched")


def similar_items(items: DataFrame, item: str, keys: list[str], weights: list[float], top: int = 5, base: float = 0.15) -> DataFrame:
    """a, b, score: items that agree in some of the keys (blank and null agree with
    nothing), base plus the weight of each key they agree in, at most 1. One
    equi-join per key, never item by item."""
    out = None
    for k, x in zip(keys, weights):
        some = items.filter(F.trim(F.col(k).cast("string")) != "").select(F.col(k).alias("k"), F.col(item).alias("i"))
        j = some.withColumnRenamed("i", "a").join(some.withColumnRenamed("i", "b"), "k").filter(F.col("a") != F.col("b")).select("a", "b", F.lit(x).alias("x"))
        out = j if out is None else out.unionByName(j)
    scored = out.groupBy("a", "b").agg(F.least(F.lit(1.0), F.round(base + F.sum("x"), 6)).alias("score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def weighted_profile(anchors: DataFrame, user: str, vec: str = "embedding", weight: str = "weight") -> DataFrame:
    """The mean of each user's vectors by weight, of unit length; vectors of
    another length than the user's longest and weights not above 0 don't count."""
    a = anchors.filter((F.col(weight) > 0) & F.col(vec).isNotNull())
    a = a.withColumn("dim", F.max(F.size(vec)).over(Window.partitionBy(user))).filter(F.size(vec) == F.col("dim"))
    each = a.select(user, weight, F.posexplode(vec).alias("i", "x")).groupBy(user, "i").agg((F.sum(F.col("x").cast("double") * F.col(weight)) / F.sum(weight)).alias("x"))
    p = each.groupBy(user).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("profile"))
    n = norm(F.col("profile"))
    return p.filter(n > 0).withColumn("profile", F.transform("profile", lambda x: x / n))


def near_profile(profiles: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str, vec: str = "embedding", least: float = 0.5, top: int = 8) -> DataFrame:
    """The items nearest to each profile of a bounded set of users, seen ones left
    out; every item meets the profiles in one block."""
    block = F.broadcast(profiles.agg(F.collect_list(F.struct(user, "profile")).alias("p")))
    s = items.select(item, vec).join(block, F.lit(True)).select(item, F.explode(F.transform("p", lambda p: F.struct(p[user].alias(user), cosine(p.profile, F.col(vec)).alias("score")))).alias("s")).select(f"s.{user}", item, "s.score").filter(F.col("score") >= least)
    w = Window.partitionBy(user).orderBy(F.desc("score"), item)
    return s.join(seen.select(user, item).distinct(), [user, item], "left_anti").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
