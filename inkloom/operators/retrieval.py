"""Retrieval as one plan: mode, fusion of keyword and vector lists, context."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import best_sentence, bm25, terms
from .shelves import ranked
from .vectors import cosine

#: Relations by how much they say, the first family that fits counts.
RELATION_FAMILIES = (
    (1.0, "师徒 亲属 父 母 伴侣 盟友 敌 隶属 leader member ally enemy"),
    (0.85, "朋友 同门 合作 friend mentor"),
    (0.25, "相关 关联 related"),
)
OTHER_RELATION = 0.5


def wide_k(query: str, base: int) -> int:
    """How many candidates to fetch for a result of `base`: more for a single short
    term and for questions or queries of five words and more, fewer for quotations."""
    words = len(query.split())
    if len(query) < 10 and words <= 2:
        factor = 1.5
    elif re.search("[?？]", query) or words >= 5:
        factor = 2.0
    else:
        factor = 1.0 if re.search('["“”]', query) else 1.2
    return min(100, max(5, int(base * factor + 0.5)))


def fused(lists: list[tuple[str, DataFrame]], key: str = "id", k: int = 60, top: int = 20) -> DataFrame:
    """id, rrf, share, sources and the best score of each list: rank fusion of
    ranked lists (id, score); share is the sum divided by the best one, for callers
    that want scores from 0 to 1. Ties fall to the smaller id."""
    tagged = functools.reduce(DataFrame.unionByName, (x.select(key, F.col("score").cast("double").alias("score"), F.lit(name).alias("source")) for name, x in lists))
    r = tagged.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), key)))
    best = [F.round(F.max(F.when(F.col("source") == name, F.col("score"))), 6).alias(f"{name}_score") for name, _ in lists]
    sums = r.groupBy(key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), *best)
    first = sums.orderBy(F.desc("rrf"), key).limit(top)
    return first.join(F.broadcast(first.agg(F.max("rrf").alias("most"))), F.lit(True)).withColumn("share", F.round(F.col("rrf") / F.col("most"), 6)).drop("most")


def vector_list(items: DataFrame, query: list[float], k: int, item_id: str, vec: str = "embedding", least: float = 0.0) -> DataFrame:
    """id, score: the k items nearest to one vector."""
    s = items.select(F.col(item_id).alias("id"), F.round(cosine(F.lit(query).cast("array<double>"), F.col(vec)), 6).alias("score"))
    return s.filter(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def searched(docs: DataFrame, items: DataFrame, query: str, vector: list[float] | None, mode: str = "hybrid", size: int = 20, doc_id: str = "doc_id", text: str = "text", title: str = "title", item_id: str = "vec_id") -> DataFrame:
    """One search: keyword, semantic or hybrid. A list that can't be had (no words
    in the query, no vector) is left out; with nothing at all titles that hold
    the query are the result. An unknown mode raises."""
    if mode not in ("keyword", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    k, lists = wide_k(query, size), []
    if mode != "semantic" and query.strip():
        lists.append(("keyword", bm25(docs, doc_id, text, query).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)))
    if mode != "keyword" and vector:
        lists.append(("semantic", vector_list(items, vector, k, item_id)))
    if lists and not all(x.isEmpty() for _, x in lists):
        return fused(lists, top=size)
    hit = docs.filter(F.contains(F.lower(title), F.lit(query.strip().lower())) & F.lit(bool(query.strip()))).select(F.col(doc_id).alias("id"), F.lit(1.0).alias("score"))
    return fused([("title", hit.orderBy("id").limit(k))], top=size)


def similar_passages(docs: DataFrame, passage: str, doc_id: str, text: str, top: int = 20) -> DataFrame:
    """id, score: texts by the cosine of term counts with a passage, which stands
    for a vector where no embedder is at hand. Only the passage's terms are
    counted one by one; norms come from one aggregation a text."""
    spark = docs.sparkSession
    wanted = {r["t"]: r["n"] for r in spark.range(1).select(F.explode(terms(F.lit(passage))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    length = sum(n * n for n in wanted.values()) ** 0.5
    each = docs.select(F.col(doc_id).alias("id"), F.explode(terms(text)).alias("t")).groupBy("id", "t").agg(F.count("*").alias("n"))
    weight = F.lit(0) if not wanted else F.coalesce(F.create_map(*[F.lit(x) for p in wanted.items() for x in p])[F.col("t")], F.lit(0))
    per = each.groupBy("id").agg(F.sum(weight * F.col("n")).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("squares")).filter("dot > 0")
    return per.select("id", F.round(F.col("dot") / (F.sqrt("squares") * F.lit(length)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def explained(hits: DataFrame, docs: DataFrame, query: list[str], doc_id: str, text: str) -> DataFrame:
    """hits(id, ...) with the sentence of each text that explains it best, cut to 160."""
    t = docs.select(F.col(doc_id).alias("id"), F.regexp_extract_all(text, F.lit("[^.!?。！？]+[.!?。！？]*"), F.lit(0)).alias("s"))
    return t.join(F.broadcast(hits), "id").withColumn("reason", F.substring(F.trim(best_sentence(F.col("s"), query)["sentence"]), 1, 160)).drop("s")


def context_block(hits: DataFrame, docs: DataFrame, doc_id: str, text: str, least: float = 0.3, top: int = 5, size: int = 200) -> DataFrame:
    """context: one text of the best hits (id, share) from `least` on, numbered."""
    best = hits.filter(F.col("share") >= least).orderBy(F.desc("share"), "id").limit(top)
    j = docs.select(F.col(doc_id).alias("id"), F.substring(text, 1, size).alias("t")).join(F.broadcast(best), "id")
    every = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("k"), "id", "t")))  # `top` rows
    return j.agg(F.array_join(F.transform(every, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x.t)), "\n").alias("context"))


def relation_weight(col: str) -> Column:
    """How much a named relation says, by the words it holds."""
    low, out = F.lower(col), None
    for weight, words in RELATION_FAMILIES:
        hit = functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words.split()))
        out = F.when(hit, weight) if out is None else out.when(hit, weight)
    return out.otherwise(OTHER_RELATION)


def paths(edges: DataFrame, starts: DataFrame, hops: int = 5) -> DataFrame:
    """nodes, relations, strength, length: directed paths from starts(node) along
    edges(source, target, relation), of one to `hops` steps, no node twice;
    strength is the weight of the strongest relation. The edges are written once
    by the caller if they are dear to compute."""
    e = edges.select("source", "target", "relation", relation_weight("relation").alias("w"))
    front = starts.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("relations"), F.lit(0.0).alias("strength"))
    out = None
    for _ in range(hops):
        front = front.withColumn("source", F.element_at("nodes", -1)).join(e, "source").filter(~F.array_contains("nodes", F.col("target")))
        front = front.select(F.concat("nodes", F.array("target")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.greatest("strength", "w").alias("strength"))
        out = front if out is None else out.union(front)
    return out.withColumn("length", F.size("relations"))


def ranked_paths(found: DataFrame, asked: list, top: int = 20) -> DataFrame:
    """Paths by score: short ones, through many of the nodes asked for, by strong
    relations; the shorter one at a tie, then by the nodes."""
    covered = F.size(F.array_intersect("nodes", F.array(*[F.lit(x) for x in asked]))) / len(asked) if asked else F.lit(0.0)
    score = F.round(0.45 / (F.col("length") + 1) + 0.40 * covered + 0.15 * F.col("strength"), 6)
    p = found.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("path"), F.array_join("relations", ",").alias("relations"), "length", score.alias("score"))
    return p.orderBy(F.desc("score"), "length", "path", "relations").limit(top)


def near_nodes(items: DataFrame, centroids: DataFrame, group: str, item_id: str, top: int = 5, least: float = 0.3, vec: str = "embedding") -> DataFrame:
    """Per node of centroids(group, centroid) the items of other groups nearest to
    it. Nodes are met with blocks of items: a join, whose size is the product asked for."""
    c = centroids.select(F.col(group).alias("node"), "centroid")
    s = items.select(F.col(group).alias("own"), item_id, vec).join(F.broadcast(c), F.col("own") != F.col("node")) if c.count() <= 10_000 else items.select(F.col(group).alias("own"), item_id, vec).join(c, F.col("own") != F.col("node"))
    s = s.select("node", item_id, F.round(cosine(F.col("centroid"), F.col(vec)), 6).alias("score")).filter(F.col("score") >= least)
    return ranked(s, ["node"], [F.desc("score"), F.asc(item_id)], top)


def likeness_bucket(score: Column) -> Column:
    """Four grades of how alike two profiles are."""
    return F.when(score >= 0.85, "same").when(score >= 0.7, "close").when(score >= 0.5, "related").otherwise("different")


def compared_profiles(centroids: DataFrame, group: str) -> DataFrame:
    """a, b, score, grade: the profiles of every two groups held against each other."""
    x, y = centroids.select(F.col(group).alias("a"), F.col("centroid").alias("u")), centroids.select(F.col(group).alias("b"), F.col("centroid").alias("v"))
    p = x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("u"), F.col("v")), 6).alias("score"))
    return p.withColumn("grade", likeness_bucket(F.col("score")))
