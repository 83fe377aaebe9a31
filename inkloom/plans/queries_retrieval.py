"""Queries of retrieval: hybrid search, context, paths, nodes and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as Y
from ..operators import search as S
from ..operators import vectors as X
from ..operators.shelves import ranked
from ..sources.tables import table
from .durable import Scratch
from .queries_vectors import BM25, CENTROIDS, COS, QUERY_TERMS, TERMS
from .register import registry

QUERIES, SQL, query = registry()

QUERY = " ".join(QUERY_TERMS)
HYBRID = f"""{BM25}, kw AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 24), qv AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1),
ve AS (SELECT vec_id AS id, round({COS.format('q', 'embedding')}, 6) AS score FROM embeddings CROSS JOIN qv ORDER BY 2 DESC, 1 LIMIT 24),
ls AS (SELECT *, 'keyword' AS source FROM kw UNION ALL SELECT *, 'semantic' FROM ve WHERE score >= 0), rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS rank FROM ls),
fu AS (SELECT id, round(sum(1 / (60 + rank)), 9) AS rrf, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(score) FILTER (WHERE source = 'keyword') AS keyword_score, max(score) FILTER (WHERE source = 'semantic') AS semantic_score FROM rk GROUP BY id ORDER BY rrf DESC, id LIMIT 20),
hy AS (SELECT *, round(rrf / (SELECT max(rrf) FROM fu), 6) AS share FROM fu)"""


def _hybrid(spark, d):
    items = table(spark, d, "embeddings")
    first = items.orderBy("vec_id").limit(1).select("embedding").collect()  # the query's vector
    return Y.searched(table(spark, d, "documents"), items, QUERY, [float(x) for x in first[0][0]] if first else None)


@query(f"WITH {HYBRID} SELECT id, rrf, share, sources, keyword_score, semantic_score FROM hy")
def hybrid_search(spark, d):
    """Words and a vector, fused by rank, with scores from 0 to 1 beside."""
    return _hybrid(spark, d)


@query(f"""WITH {HYBRID} SELECT string_agg('[' || k || '] ' || t, chr(10) ORDER BY k) AS context FROM (SELECT row_number() OVER (ORDER BY share DESC, id) AS k, substr(text, 1, 200) AS t FROM (SELECT * FROM hy WHERE share >= 0.3 ORDER BY share DESC, id LIMIT 5) h JOIN documents ON doc_id = id WHERE text IS NOT NULL)""")
def rag_context(spark, d):
    """The best hits of the hybrid search as one numbered text."""
    return Y.context_block(_hybrid(spark, d), table(spark, d, "documents").filter("text is not null"), "doc_id", "text")


PASSAGE = "A lantern in the harbour, a letter in the well; the harbour was quiet. 灯火在港口"


@query(f"""WITH q AS (SELECT t, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower('{PASSAGE}'), '{S.TERM}')) AS t) GROUP BY 1), e AS (SELECT doc_id AS id, t, count(*) AS n FROM (SELECT doc_id, unnest({TERMS}) AS t FROM documents) GROUP BY ALL),
p AS (SELECT id, sum(coalesce(q.n, 0) * e.n) AS dot, sum(e.n * e.n) AS squares FROM e LEFT JOIN q USING (t) GROUP BY 1)
SELECT id, round(dot / (sqrt(squares) * sqrt((SELECT sum(n * n) FROM q))), 6) AS score FROM p WHERE dot > 0 ORDER BY score DESC, id LIMIT 20""")
def similar_passage(spark, d):
    """The texts most like a passage."""
    return Y.similar_passages(table(spark, d, "documents"), PASSAGE, "doc_id", "text")


VALUE = " + ".join(f"CAST(contains(lower(s), '{w}') AS INT)" for w in QUERY_TERMS) + " + (" + " + ".join(f"CASE WHEN contains(lower(s), '{w}') THEN {len(w)} ELSE 0 END" for w in QUERY_TERMS) + ") / 100 - least(length(s), 240) / 10000"


@query(f"""WITH {BM25}, top AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 50), x AS (SELECT id, score, list_max(list_transform(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]*'), lambda s: {{'v': {VALUE}, 's': s}})).s AS s FROM top JOIN documents ON doc_id = id)
SELECT id, score, substr(trim(s), 1, 160) AS reason FROM x""")
def explained_hits(spark, d):
    """The best fifty hits, each with the sentence that explains it."""
    docs = table(spark, d, "documents")
    hits = S.bm25(docs, "doc_id", "text", QUERY).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return Y.explained(hits, docs, list(QUERY_TERMS), "doc_id", "text").select("id", "score", "reason")


NAMES = "CASE l_returnflag WHEN 'R' THEN 'enemy of' WHEN 'A' THEN 'friend of' ELSE 'related to' END"
TRADE = f"""tr AS (SELECT 'n' || s_nationkey AS source, 'n' || c_nationkey AS target, {NAMES} AS relation, CAST(sum(l_quantity) AS BIGINT) AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
ed AS (SELECT source, target, relation FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY amount DESC, target) AS k FROM tr) WHERE k = 1)"""
WEIGHT = "CASE WHEN contains(relation, 'enemy') THEN 1.0 WHEN contains(relation, 'friend') THEN 0.85 WHEN contains(relation, 'related') THEN 0.25 ELSE 0.5 END"


def _trade(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    relation = F.when(F.col("l_returnflag") == "R", "enemy of").when(F.col("l_returnflag") == "A", "friend of").otherwise("related to")
    sums = li.join(s, "l_suppkey").join(o, "l_orderkey").filter("source <> target").groupBy("source", "target", relation.alias("relation")).agg(F.sum("l_quantity").cast("long").alias("amount"))
    return Scratch(spark).keep(ranked(sums, ["source", "relation"], [F.desc("amount"), F.asc("target")], 1).select("source", "target", "relation"))


@query(f"""WITH RECURSIVE {TRADE}, st AS (SELECT DISTINCT source AS node FROM ed), pa AS (SELECT [node] AS nodes, CAST([] AS VARCHAR[]) AS relations, CAST(0 AS DOUBLE) AS strength FROM st
UNION ALL SELECT list_append(nodes, target), list_append(relations, relation), greatest(strength, {WEIGHT}) FROM pa JOIN ed ON ed.source = nodes[-1] WHERE NOT list_contains(nodes, target) AND len(relations) < 4),
sc AS (SELECT array_to_string(nodes, '>') AS path, array_to_string(relations, ',') AS relations, CAST(len(relations) AS INT) AS length, round(0.45 / (len(relations) + 1) + 0.40 * len(list_intersect(nodes, ['n3', 'n7'])) / 2 + 0.15 * strength, 6) AS score FROM pa WHERE len(relations) > 0)
SELECT * FROM sc ORDER BY score DESC, length, path, relations LIMIT 200""")
def trade_paths(spark, d):
    """Paths of up to four steps among nations by their strongest trade, ranked for
    two nations asked for."""
    e = _trade(spark, d)
    return Y.ranked_paths(Y.paths(e, e.select(F.col("source").alias("node")).distinct(), 4), ["n3", "n7"], 200)


@query(f"""WITH RECURSIVE {TRADE}, w AS (SELECT source, target FROM ed UNION SELECT target, source FROM ed), h AS (SELECT DISTINCT source AS start, source AS node, 0 AS distance FROM w UNION SELECT h.start, w.target, h.distance + 1 FROM h JOIN w ON w.source = h.node WHERE h.distance < 5)
SELECT start, node, min(distance) AS distance FROM h GROUP BY 1, 2""")
def trade_distances(spark, d):
    """How many steps, up to five, lead from each nation to each other one."""
    e = _trade(spark, d).withColumn("weight", F.lit(1))
    return G.hop_distances(e, G.both_ways(e).select(F.col("source").alias("node")))


@query(f"WITH {TRADE} SELECT relation, count(*) AS n, max({WEIGHT}) AS weight FROM ed GROUP BY 1")
def relation_weights(spark, d):
    return _trade(spark, d).groupBy("relation").agg(F.count("*").alias("n"), F.max(Y.relation_weight("relation")).alias("weight"))


@query(f"""WITH {CENTROIDS}, s AS (SELECT z.label AS node, e.vec_id, round({COS.format('z.c', 'e.embedding')}, 6) AS score FROM cent z JOIN embeddings e ON e.label <> z.label)
SELECT node, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 5""")
def node_scan(spark, d):
    """Per label the nearest vectors that bear another one."""
    e = table(spark, d, "embeddings")
    return Y.near_nodes(e, X.centroids(e, "label"), "label", "vec_id", least=0.1)


@query(f"""WITH {CENTROIDS}, s AS (SELECT x.label AS a, y.label AS b, round({COS.format('x.c', 'y.c')}, 6) AS score FROM cent x JOIN cent y ON x.label < y.label)
SELECT a, b, score, CASE WHEN score >= 0.85 THEN 'same' WHEN score >= 0.7 THEN 'close' WHEN score >= 0.5 THEN 'related' ELSE 'different' END AS grade FROM s""")
def compared_profiles(spark, d):
    """How alike the mean vectors of any two labels are."""
    return Y.compared_profiles(X.centroids(table(spark, d, "embeddings"), "label"), "label")


@query(f"""WITH {CENTROIDS}, s AS (SELECT e.label, e.vec_id, z.label AS tag, round({COS.format('e.embedding', 'z.c')}, 6) AS score FROM embeddings e CROSS JOIN cent z)
SELECT label, tag, count(*) FILTER (WHERE score >= 0.3) AS markers, arg_max(vec_id, (score, -vec_id)) AS peak, round(max(score), 6) AS peak_score FROM s GROUP BY 1, 2""")
def tag_radar(spark, d):
    """Per group and tag: how many items bear it, and where it peaks; 0 where none does."""
    e = table(spark, d, "embeddings")
    c = F.broadcast(X.centroids(e, "label").select(F.col("label").alias("tag"), "centroid"))  # as many rows as tags
    s = e.join(c, F.lit(True)).select("label", "tag", "vec_id", F.round(X.cosine(F.col("centroid"), F.col("embedding")), 6).alias("score"))
    return s.groupBy("label", "tag").agg(F.count_if(F.col("score") >= 0.3).alias("markers"), F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("peak"), F.max("score").alias("peak_score"))
