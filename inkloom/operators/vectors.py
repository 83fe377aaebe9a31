"""Vector operators over array columns: similarity, centroids, assignment,
drift, clusters, rank fusion.

A side that is broadcast is a set of queries or centroids, whose number is a
parameter of the caller and doesn't grow with the corpus; similarity itself is
higher-order functions inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty or null, or its norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def top_k(items: DataFrame, queries: DataFrame, k: int, item_id: str = "vec_id", query_id: str = "query_id", vec: str = "embedding", least: float | None = None) -> DataFrame:
    """The k nearest items of each query vector, itself left out: every item is
    met by the queries in blocks, and each task keeps k per query before the
    shuffle (partial top-k), so that what is moved is queries x k per task."""
    q = queries.select(query_id, F.col(vec).alias("qv"))
    packed = q.agg(F.collect_list(F.struct(query_id, "qv")).alias("q"))
    scored = items.select(item_id, vec).join(F.broadcast(packed), F.lit(True)).select(item_id, vec, F.explode("q").alias("q")).filter(F.col(item_id) != F.col(f"q.{query_id}"))
    scored = scored.select(F.col(f"q.{query_id}").alias(query_id), F.col(item_id), cosine(F.col("q.qv"), F.col(vec)).alias("score"))
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    # Catalyst puts a partial group limit before the exchange for this shape
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_of_all(items: DataFrame, k: int, item_id: str = "vec_id", vec: str = "embedding", rows: int = 2048) -> DataFrame:
    """query_id, item_id, score: the k nearest others of every vector, by exact
    cosine; the smaller id at a tie. Blocks of about so many vectors are met with
    each other, and of a block k per vector are kept. Vectors of another length,
    null, empty or of norm 0 are like nothing and take no part."""
    import numpy as np
    import pandas as pd

    v = items.select(F.col(item_id).alias("i"), F.col(vec).cast("array<double>").alias("v")).filter(F.col("i").isNotNull() & (norm(F.col("v")) > 0))
    blocks = max(1, -(-v.count() // rows))
    packed = v.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks))).groupBy("b", F.size("v").alias("n")).agg(F.collect_list("i").alias("i"), F.flatten(F.collect_list("v")).alias("v"))
    both = packed.select("n", F.col("i").alias("qi"), F.col("v").alias("qv")).join(packed, "n")

    def run(parts):
        for p in parts:
            for n, qi, qv, i, x in zip(p["n"], p["qi"], p["qv"], p["i"], p["v"]):
                unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
                s = np.round(unit(np.asarray(qv).reshape(-1, n)) @ unit(np.asarray(x).reshape(-1, n)).T, 9)
                qi, i = np.asarray(qi), np.asarray(i)
                s[qi[:, None] == i[None, :]] = -np.inf
                order = np.argsort(i, kind="stable")  # a stable sort leaves ties in order of id
                best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                out = pd.DataFrame({"query_id": np.repeat(qi, best.shape[1]), item_id: i[best].reshape(-1), "score": np.take_along_axis(s, best, 1).reshape(-1)})
                yield out[out["score"] > -np.inf]

    kind = dict(items.dtypes)[item_id]
    some = both.select("n", "qi", "qv", "i", "v").mapInPandas(run, f"query_id {kind}, {item_id} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), item_id)
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def centroids(items: DataFrame, group: str, vec: str = "embedding", normalize: bool = False) -> DataFrame:
    """The mean vector of each group, of unit length if wanted."""
    each = items.select(group, F.posexplode(vec).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    out = each.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("centroid"))
    if normalize:
        n = norm(F.col("centroid"))
        out = out.withColumn("centroid", F.when(n > 0, F.transform("centroid", lambda x: x / n)).otherwise(F.col("centroid")))
    return out


def nearest_centroid(items: DataFrame, cents: DataFrame, item_id: str = "vec_id", group: str = "label", vec: str = "embedding", least: float = 0.45) -> DataFrame:
    """The nearest centroid of each item, if it is nearer than `least`; the
    smaller group at a tie."""
    packed = cents.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c")))).alias("cs"))
    best = F.array_max(F.transform("cs", lambda c: F.struct(cosine(c.c, F.col(vec)).alias("score"), (-c.g).alias("neg"), c.g.alias("g"))))
    out = items.select(item_id, vec).join(F.broadcast(packed), F.lit(True)).withColumn("best", best)
    return out.filter(F.col("best.score") > least).select(item_id, F.col("best.g").alias("assigned"), F.col("best.score").alias("score"))


def drift(items: DataFrame, group: str, order: str, vec: str = "embedding", event: float = 0.15, fusion: float = 0.3) -> DataFrame:
    """Per item in order: 1 - cosine to the one before and to the group's first,
    and whether that is an event."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.first(vec).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag(vec).over(w)
    d = items.withColumn("from_previous", F.when(before.isNotNull(), 1 - cosine(before, F.col(vec)))).withColumn("from_first", 1 - cosine(first, F.col(vec)))
    kind = F.when(F.col("from_previous") > fusion, "fusion").when(F.col("from_previous") > event, "shift")
    return d.select(group, order, "from_previous", "from_first", kind.alias("event"))


def tag_scores(items: DataFrame, profiles: DataFrame, group: str, item_id: str = "vec_id", vec: str = "embedding", threshold: float = 0.3) -> DataFrame:
    """Per group and profile(tag, centroid): mean of the three best items, share
    of items from the threshold on, best item."""
    packed = profiles.agg(F.collect_list(F.struct("tag", "centroid")).alias("ps"))
    s = items.select(group, item_id, vec).join(F.broadcast(packed), F.lit(True)).select(group, item_id, F.explode(F.transform("ps", lambda p: F.struct(p.tag.alias("tag"), cosine(p.centroid, F.col(vec)).alias("score")))).alias("s")).select(group, item_id, "s.tag", "s.score")
    w = Window.partitionBy(group, "tag").orderBy(F.desc("score"), item_id)
    top = s.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy(group, "tag").agg(F.avg("score").alias("top3_mean"), F.min(F.when(F.col("r") == 1, F.col(item_id))).alias("best_item"))
    rest = s.groupBy(group, "tag").agg((F.count_if(F.col("score") >= threshold) / F.count("*")).alias("concentration"))
    return top.join(rest, [group, "tag"])


def kmeans_cosine(items: DataFrame, k: int, item_id: str = "vec_id", vec: str = "embedding", rounds: int = 10) -> DataFrame:
    """Clusters by cosine: evenly spaced first centroids in id order, at most so
    many rounds, the lower cluster at a tie, an empty one keeps its centroid.
    k centroids are all that comes to the driver in a round."""
    n = items.count()
    if not n:
        return items.select(item_id, F.lit(0).alias("cluster")).limit(0)
    picks = sorted({i * n // k for i in range(k)})
    w = Window.orderBy(item_id)
    ids = items.select(item_id).withColumn("n", F.row_number().over(w) - 1).filter(F.col("n").isin(picks)).select(item_id)
    cents = [list(map(float, r[vec])) for r in items.join(F.broadcast(ids), item_id).orderBy(item_id).select(vec).collect()]
    spark, before = items.sparkSession, None

    def assigned(cs: list[list[float]]) -> DataFrame:
        c = spark.createDataFrame([(i, x) for i, x in enumerate(cs)], "label int, centroid array<double>")
        return nearest_centroid(items, c, item_id, "label", vec, least=-2.0)

    for _ in range(rounds):
        a = assigned(cents)
        new = {r["assigned"]: r["centroid"] for r in centroids(items.join(a, item_id), "assigned", vec).collect()}
        cents = [list(new.get(i, c)) for i, c in enumerate(cents)]
        if before == cents:
            break
        before = [list(c) for c in cents]
    return assigned(cents).select(item_id, F.col("assigned").alias("cluster"), "score")


def rrf(lists: DataFrame, key: str, source: str = "source", score: str = "score", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: per key the sum of 1 / (k + rank) over the ranked
    lists it is in (rank from 1), its best score and the names of the lists."""
    w = Window.partitionBy(source).orderBy(F.desc(score), key)
    r = lists.withColumn("rank", F.row_number().over(w))
    return r.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.max(score).alias("best_score"), F.array_join(F.sort_array(F.collect_set(source)), ",").alias("sources"))
