"""Queries over embeddings and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import vectors as X
from ..sources.tables import table
from .register import registry

QUERIES, SQL, query = registry()

COS = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / (sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))) * sqrt(list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[]))))"
CENTROIDS = "u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL), cent AS (SELECT label, list(x ORDER BY i) AS c FROM a GROUP BY label)"


def _items(spark, d):
    return table(spark, d, "embeddings")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({COS.format('q.embedding', 'e.embedding')}, 6) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark, d):
    """The ten nearest of every vector whose id is divisible by 20, among all."""
    e = _items(spark, d)
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    t = X.top_k(e, q, 10)
    return t.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("""SELECT label, CAST(i AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2""")
def label_centroids(spark, d):
    c = X.centroids(_items(spark, d), "label")
    return c.select("label", F.posexplode("centroid").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {CENTROIDS}, s AS (SELECT e.vec_id, z.label AS g, {COS.format('e.embedding', 'z.c')} AS score FROM embeddings e CROSS JOIN cent z)
SELECT vec_id, g AS assigned, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, g) AS k FROM s) WHERE k = 1 AND score > 0""")
def nearest_centroid(spark, d):
    e = _items(spark, d)
    return X.nearest_centroid(e, X.centroids(e, "label"), least=0.0).select("vec_id", "assigned", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings),
x AS (SELECT label, vec_id, 1 - {COS.format('p', 'embedding')} AS a, 1 - {COS.format('f', 'embedding')} AS b FROM s)
SELECT label, vec_id, round(a, 6) AS from_previous, round(b, 6) AS from_first, CASE WHEN a > 0.3 THEN 'fusion' WHEN a > 0.15 THEN 'shift' END AS event FROM x""")
def vector_drift(spark, d):
    t = X.drift(_items(spark, d), "label", "vec_id")
    return t.select("label", "vec_id", F.round("from_previous", 6).alias("from_previous"), F.round("from_first", 6).alias("from_first"), "event")


@query(f"""WITH {CENTROIDS}, s AS (SELECT e.label, e.vec_id, 'tag' || z.label AS tag, {COS.format('e.embedding', 'z.c')} AS score FROM embeddings e CROSS JOIN cent z),
r AS (SELECT *, row_number() OVER (PARTITION BY label, tag ORDER BY score DESC, vec_id) AS k FROM s)
SELECT label, tag, round(avg(score) FILTER (WHERE k <= 3), 6) AS top3_mean, min(CASE WHEN k = 1 THEN vec_id END) AS best_item, round(count(*) FILTER (WHERE score >= 0.3) / count(*), 6) AS concentration FROM r GROUP BY 1, 2""")
def tag_scores(spark, d):
    e = _items(spark, d)
    profiles = X.centroids(e, "label").select(F.concat(F.lit("tag"), F.col("label").cast("string")).alias("tag"), "centroid")
    t = X.tag_scores(e, profiles, "label")
    return t.select("label", "tag", F.round("top3_mean", 6).alias("top3_mean"), "best_item", F.round("concentration", 6).alias("concentration"))


@query()
def kmeans_cosine(spark, d):
    return X.kmeans_cosine(_items(spark, d), 10)


TERMS = f"regexp_extract_all(lower(text), '{S.TERM}')"
QUERY_TERMS = ("lantern", "harbour", "letter", "well")
BM25 = f"""t AS (SELECT doc_id AS id, {TERMS} AS t FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM t), h AS (SELECT id, len(t) AS length, unnest(t) AS term FROM t),
tf AS (SELECT id, length, term, count(*) AS tf FROM h WHERE term IN {QUERY_TERMS} GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / al))) AS score, count(*) AS matched FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY id)"""


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score, matched FROM bm")
def keyword_search(spark, d):
    """Every document that holds a term of the query, scored."""
    b = S.bm25(table(spark, d, "documents"), "doc_id", "text", " ".join(QUERY_TERMS))
    return b.select("id", F.round("score", 6).alias("score"), "matched")


@query(f"WITH {BM25} SELECT source, count(*) AS hits, round(max(score), 6) AS top_score, arg_max(id, (score, id)) AS top_hit FROM bm JOIN documents d ON d.doc_id = bm.id GROUP BY source")
def hits_by_source(spark, d):
    docs = table(spark, d, "documents")
    b = S.bm25(docs, "doc_id", "text", " ".join(QUERY_TERMS)).join(docs.select(F.col("doc_id").alias("id"), "source"), "id")
    return S.grouped_hits(b, "source").withColumn("top_score", F.round("top_score", 6))


@query("""WITH e AS (SELECT event_id, user_id, value, event_type FROM events), l AS (SELECT 'recent' AS source, user_id AS key, CAST(max(event_id) AS DOUBLE) AS score FROM e GROUP BY 2 UNION ALL SELECT 'active', user_id, CAST(count(*) AS DOUBLE) FROM e GROUP BY 2 UNION ALL SELECT 'large', user_id, max(value) FROM e GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, key) AS rank FROM l)
SELECT key, round(sum(1 / (60 + rank)), 9) AS rrf, max(score) AS best_score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY key""")
def rrf_fusion(spark, d):
    """Fusion of three rankings of users."""
    e = table(spark, d, "events")
    one = lambda name, agg: e.groupBy(F.col("user_id").alias("key")).agg(agg.cast("double").alias("score")).withColumn("source", F.lit(name))
    lists = one("recent", F.max("event_id")).unionByName(one("active", F.count("*"))).unionByName(one("large", F.max("value")))
    return X.rrf(lists, "key").withColumn("rrf", F.round("rrf", 9))


@query("SELECT title AS value, count(*) AS n FROM documents WHERE starts_with(lower(title), 's') GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def suggest_titles(spark, d):
    return S.suggestions(table(spark, d, "documents"), "title", "s")
