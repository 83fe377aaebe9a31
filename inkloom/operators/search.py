"""Keyword retrieval: postings, BM25, fusion, grouping, highlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import rrf

#: Words of Latin letters and digits, and single characters of other scripts.
TERM = r"[0-9a-z\x{C0}-\x{24F}]+|[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]"


def terms(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(f"({TERM})"), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, length: an inverted index; null texts have none."""
    t = docs.select(F.col(id_col).alias("id"), terms(text_col).alias("t")).withColumn("length", F.size("t"))
    return t.select("id", "length", F.explode("t").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score, matched: documents that hold any term of the query. Only the
    query's terms are exploded, so postings of other words are never made; the
    statistics are of all documents."""
    spark = docs.sparkSession
    wanted = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("t")).collect()]
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
    t = docs.select(F.col(id_col).alias("id"), terms(text_col).alias("t")).filter(F.col("t").isNotNull())
    stats = t.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_length"))
    hits = t.select("id", F.size("t").alias("length"), F.explode(F.filter("t", lambda x: x.isin(wanted))).alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    j = hits.join(F.broadcast(df), "term").join(F.broadcast(stats), F.lit(True))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return j.groupBy("id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def keyword_page(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = 50) -> DataFrame:
    """The k best documents of a query, with a snippet around its first term."""
    if not query.strip():
        return bm25(docs, id_col, text_col, "").withColumn("snippet", F.lit(""))
    if len(query.encode()) > 1000:
        raise ValueError("query too long")
    best = bm25(docs, id_col, text_col, query).orderBy(F.desc("score"), "id").limit(min(50, max(1, k)))
    first = query.split()[0].lower()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    at = F.greatest(F.lit(1), F.locate(first, F.lower("text")) - 40)
    return text.join(F.broadcast(best), "id").select("id", "score", "matched", F.substring("text", at, F.lit(200)).alias("snippet"))


def hybrid(keyword: DataFrame, vector: DataFrame, key: str = "id", k: int = 60) -> DataFrame:
    """Fusion of two ranked lists (key, score)."""
    one = keyword.select(key, F.col("score").cast("double").alias("score"), F.lit("keyword").alias("source"))
    return rrf(one.unionByName(vector.select(key, F.col("score").cast("double").alias("score"), F.lit("semantic").alias("source"))), key, k=k)


def grouped_hits(hits: DataFrame, group: str, score: str = "score", key: str = "id") -> DataFrame:
    """Hits per group: how many, the best score and which one it is."""
    return hits.groupBy(group).agg(F.count("*").alias("hits"), F.max(score).alias("top_score"), F.max_by(key, F.struct(F.col(score), F.col(key))).alias("top_hit"))


def suggestions(rows: DataFrame, col: str, prefix: str, k: int = 10) -> DataFrame:
    """Distinct values that begin with the prefix, in any case, most frequent first."""
    p = prefix.strip().lower()
    hit = rows.filter(F.startswith(F.lower(col), F.lit(p)) & (F.lit(p) != ""))
    return hit.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def highlight_spans(col: str, query_terms: list[str]) -> Column:
    """Array of (start, end) characters where a term begins, each term in turn."""
    low = F.lower(col)
    spans = []
    for t in query_terms:
        pieces = F.split(low, F.lit("\\Q" + t.lower() + "\\E"), -1)
        ends = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(-len(t))) + len(t) + F.length(p))))
        spans.append(F.transform(ends, lambda s: F.struct(s.alias("start"), (s + len(t)).alias("end"))))
    return F.flatten(F.array(*spans))


def best_sentence(sentences: Column, words: list[str]) -> Column:
    """The sentence that explains a hit best: its terms, then their characters,
    less a little for its length."""
    def value(s: Column) -> Column:
        hits = sum((F.contains(F.lower(s), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
        chars = sum((F.when(F.contains(F.lower(s), F.lit(w.lower())), len(w)).otherwise(0) for w in words), F.lit(0))
        return hits + chars / 100 - F.least(F.length(s), F.lit(240)) / 10000

    return F.array_max(F.transform(sentences, lambda s: F.struct(value(s).alias("value"), s.alias("sentence"))))
