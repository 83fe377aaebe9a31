"""Queries over passages, versions and likeness of books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import passages as P
from ..operators import recommend as N
from ..operators import vectors as X
from ..operators import versions as V
from ..operators.relational import latest_rows
from ..sources.tables import table
from .durable import Scratch
from .queries_books import BOOKS, PAIRS, PRINTS, books, chapters
from .register import registry

QUERIES, SQL, query = registry()


@query()
def passage_candidates(spark, d):
    """Books that share at least four winnowed passages."""
    a = V.passage_anchors(chapters(spark, d).filter("book_id is not null"))
    return V.shared_hash_candidates(a.select("book_id", "hash"), V.MIN_SHARED_PASSAGES)


@query()
def passage_evidence(spark, d):
    """The best chain of verified passages between any two books."""
    return P.chained_passages(chapters(spark, d))


@query()
def book_anchors(spark, d):
    """Anchors of every book within its budget: how many of each chapter."""
    a = P.book_anchors(V.passage_anchors(chapters(spark, d).filter("book_id is not null")))
    return a.groupBy("book_id", "chapter_id").agg(F.count("*").alias("anchors"))


@query()
def redundant_chapters(spark, d):
    """Chapters that a confirmed pair's primary side holds as well."""
    prints = Scratch(spark).keep(V.chapter_fingerprints(chapters(spark, d).filter("book_id is not null")))
    pairs = V.canonical_pairs(table(spark, d, "duplicate_pairs")).withColumn("recommended_primary_id", F.lower("recommended_primary_id"))
    return P.redundant_chapters(pairs, prints)


RANK = ("text_integrity_bps", "char_count", "chapter_count", "word_count", "metadata_quality", "file_size_bytes")


@query(f"""WITH {BOOKS}, {PRINTS}, j AS (SELECT f.layout_hash, f.text_integrity_bps, f.char_count, b.chapter_count, greatest(b.word_count, 0) AS word_count, b.metadata_quality, b.file_size_bytes, b.id FROM f JOIN b ON b.id = f.book_id WHERE f.char_count > 0),
r AS (SELECT layout_hash, id, row_number() OVER (PARTITION BY layout_hash ORDER BY {", ".join(f"coalesce({k}, -1) DESC" for k in RANK)}, id) AS k, count(*) OVER (PARTITION BY layout_hash) AS members FROM j)
SELECT layout_hash, id AS primary_id, members FROM r WHERE k = 1""")
def primary_rank(spark, d):
    """The best of the books with the same content."""
    f = latest_rows(table(spark, d, "book_fingerprints"), ["book_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("conservative_hash")]).filter("char_count > 0")
    b = books(spark, d).select(F.col("id").alias("book_id"), "chapter_count", F.greatest("word_count", F.lit(0)).alias("word_count"), "metadata_quality", "file_size_bytes")
    return P.rank_versions(f.join(b, "book_id"), "layout_hash", list(RANK))


@query(f"""WITH {PAIRS}, {PRINTS}, x AS (SELECT p.*, a.layout_hash AS print_a, b.layout_hash AS print_b FROM p LEFT JOIN f a ON a.book_id = p.book_a LEFT JOIN f b ON b.book_id = p.book_b),
o AS (SELECT book_a, book_b, status AS decision, print_a AS old_a, CASE WHEN shared_chapters > 5 THEN 'changed' ELSE print_b END AS old_b FROM x WHERE created_at < TIMESTAMPTZ '2025-03-01 00:00:00+00'),
n AS (SELECT book_a, book_b, relation, print_a, print_b, true AS fresh FROM x WHERE coalesce(confidence, 0) >= 0.5)
SELECT coalesce(n.book_a, o.book_a) AS book_a, coalesce(n.book_b, o.book_b) AS book_b, relation,
CASE WHEN fresh AND old_a IS NOT DISTINCT FROM print_a AND old_b IS NOT DISTINCT FROM print_b THEN decision WHEN fresh IS NULL THEN decision END AS decision, fresh IS NULL AS stale
FROM n FULL JOIN o ON n.book_a = o.book_a AND n.book_b = o.book_b""")
def publication_merge(spark, d):
    """A new scan's findings laid over earlier ones and their decisions."""
    f = latest_rows(table(spark, d, "book_fingerprints"), ["book_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("conservative_hash")]).select("book_id", "layout_hash")
    p = V.canonical_pairs(table(spark, d, "duplicate_pairs"))
    p = p.join(f.select(F.col("book_id").alias("book_a"), F.col("layout_hash").alias("print_a")), "book_a", "left").join(f.select(F.col("book_id").alias("book_b"), F.col("layout_hash").alias("print_b")), "book_b", "left")
    old = p.filter("created_at < '2025-03-01'").select("book_a", "book_b", F.col("status").alias("decision"), "print_a", F.when(F.col("shared_chapters") > 5, F.lit("changed")).otherwise(F.col("print_b")).alias("print_b"))
    new = p.filter("coalesce(confidence, 0) >= 0.5").select("book_a", "book_b", "relation", "print_a", "print_b")
    return P.publish(old, new)


@query(f"""WITH {BOOKS}, k AS (SELECT x.id AS a, y.id AS b, 0.25 AS x FROM b x JOIN b y ON x.author = y.author AND x.id <> y.id WHERE trim(x.author) <> '' UNION ALL SELECT x.id, y.id, 0.25 FROM b x JOIN b y ON x.title = y.title AND x.id <> y.id WHERE trim(x.title) <> ''),
s AS (SELECT a, b, CAST(least(1.0, round(0.15 + sum(x), 6)) AS DOUBLE) AS score FROM k GROUP BY a, b) SELECT a, b, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s) WHERE rank <= 5""")
def similar_books(spark, d):
    return N.similar_items(books(spark, d), "id", ["author", "title"], [0.25, 0.25])


USERS = "ev AS (SELECT o.o_custkey AS user, l.l_partkey AS item FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey), sg AS (SELECT p_partkey AS item, p_brand AS signal FROM part)"


@query(f"""WITH {USERS}, w AS (SELECT user, signal, weight FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY weight DESC, signal) AS k FROM (SELECT user, signal, count(*) AS weight FROM ev JOIN sg USING (item) GROUP BY ALL)) WHERE k <= 3),
s AS (SELECT user, item, CAST(sum(weight) AS BIGINT) AS score, string_agg(DISTINCT signal, ',' ORDER BY signal) AS matched FROM w JOIN sg USING (signal) GROUP BY user, item), f AS (SELECT s.* FROM s ANTI JOIN ev ON ev.user = s.user AND ev.item = s.item)
SELECT user, item, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank FROM f) WHERE rank <= 8""")
def signal_recommendations(spark, d):
    """Items that carry a user's strongest signals and are new to them."""
    ev = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user")).join(table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item")), F.col("o_orderkey") == F.col("l_orderkey")).select("user", "item")
    sg = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("signal"))
    return N.signal_scores(N.signal_weights(ev, sg, "user", "item", 3), sg, ev, "user", "item")


@query()
def profile_recommendations(spark, d):
    """The items of others nearest to the weighted profile of all of a label's vectors."""
    e = table(spark, d, "embeddings")
    anchors = e.select(F.col("label").alias("user"), "vec_id", "embedding", (1 + F.col("vec_id") % 3).alias("weight"))
    seen = anchors.select("user", "vec_id")
    return N.near_profile(N.weighted_profile(anchors, "user"), e.select("vec_id", "embedding"), seen, "user", "vec_id", least=-1.0)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS s, b.vec_id AS t, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9) AS w FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY w DESC, s) AS r FROM e) WHERE r <= 2 AND w >= 0.6), g AS (SELECT s, t FROM k UNION SELECT t, s FROM k),
reach(node, component) USING KEY (node) AS (SELECT s, s FROM g GROUP BY s UNION SELECT g.t, min(r.component) FROM reach r JOIN g ON r.node = g.s JOIN recurring.reach k ON k.node = g.t WHERE r.component < k.component GROUP BY g.t)
SELECT node, component FROM reach""")
def vector_groups(spark, d):
    """Groups of vectors that are tied by the two nearest of every vector, as far
    as these are alike at 0.6."""
    t = X.nearest_of_all(table(spark, d, "embeddings"), 2)
    return G.threshold_components(t.select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), F.col("score").alias("weight")), 0.6)


@query()
def file_names(spark, d):
    """Format, number, title and author as the files' names tell them."""
    b = books(spark, d)
    named = b.select("id", T.file_format("file_path").alias("format_by_name"), T.file_number("file_path").alias("number"), T.title_author("file_path").alias("t"))
    return named.select("id", "format_by_name", "number", "t.title", "t.author")
