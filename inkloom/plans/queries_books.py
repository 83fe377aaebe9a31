"""Queries over books, chapters, pairs and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import graph as G
from ..operators import versions as V
from ..operators.relational import contains_text, either_key_join, facet, latest_rows, page, with_total
from ..sources.tables import table
from .register import registry

QUERIES, SQL, query = registry()

BOOKS = """b AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, author DESC NULLS LAST, word_count DESC NULLS LAST, metadata_quality DESC NULLS LAST, file_hash DESC NULLS LAST) AS n FROM books) WHERE n = 1)"""
CHAPTERS = """c AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS n FROM chapters) WHERE n = 1)"""
PRINTS = """f AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY computed_at DESC NULLS LAST, conservative_hash DESC NULLS LAST) AS n FROM book_fingerprints) WHERE n = 1)"""
PAIRS = """p AS (SELECT * EXCLUDE n FROM (SELECT *, least(lower(book_a_id), lower(book_b_id)) AS book_a, greatest(lower(book_a_id), lower(book_b_id)) AS book_b,
row_number() OVER (PARTITION BY least(lower(book_a_id), lower(book_b_id)), greatest(lower(book_a_id), lower(book_b_id)) ORDER BY updated_at DESC NULLS LAST, id DESC) AS n
FROM duplicate_pairs WHERE lower(book_a_id) <> lower(book_b_id)) WHERE n = 1)"""
SPACE = C.SPACE


def books(spark, d):
    return C.current_books(table(spark, d, "books"))


def chapters(spark, d):
    return C.current_chapters(table(spark, d, "chapters"))


def measured_chapters(spark, d):
    """Chapters with the number of their characters in place of the content."""
    return C.current_chapters(table(spark, d, "chapters"), chars=F.coalesce(F.length("content"), F.lit(0)))


@query(f"WITH {BOOKS} SELECT x.id AS book_a_id, y.id AS book_b_id, x.file_hash, coalesce(x.file_size_bytes = y.file_size_bytes, false) AS same_size FROM b x JOIN b y ON x.file_hash = y.file_hash AND x.id < y.id WHERE x.file_hash <> ''")
def exact_duplicates(spark, d):
    return C.exact_file_pairs(books(spark, d))


@query(f"WITH {PRINTS} SELECT x.book_id AS book_a_id, y.book_id AS book_b_id, x.char_count FROM f x JOIN f y ON x.conservative_hash = y.conservative_hash AND x.book_id < y.book_id WHERE x.char_count > 0 AND y.char_count > 0")
def exact_content(spark, d):
    return C.exact_content_pairs(table(spark, d, "book_fingerprints"))


@query(f"""WITH {BOOKS}, g AS (SELECT library_id, count(*) AS n_books, sum(CASE WHEN word_count >= 0 THEN word_count END) AS words, sum(file_size_bytes) AS bytes, string_agg(DISTINCT format, ',' ORDER BY format) AS formats,
count(*) FILTER (WHERE coalesce(trim(author), '') = '') AS no_author FROM b GROUP BY 1)
SELECT l.id AS library_id, l.name, CAST(coalesce(n_books, 0) AS BIGINT) AS n_books, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, coalesce(formats, '') AS formats, coalesce(no_author, 0) AS no_author
FROM libraries l LEFT JOIN g ON g.library_id = l.id""")
def library_stats(spark, d):
    return C.library_stats(books(spark, d), table(spark, d, "libraries"))


@query(f"""WITH {BOOKS}, {CHAPTERS}, r AS (SELECT book_id, CAST(sum(length(regexp_replace(content, '{SPACE}', '', 'g'))) AS BIGINT) AS chars, count(*) AS n FROM c GROUP BY 1)
SELECT b.id AS book_id, b.word_count, b.chapter_count, coalesce(r.chars, 0) AS real_chars, coalesce(r.n, 0) AS real_chapters FROM b LEFT JOIN r ON r.book_id = b.id""")
def word_count_check(spark, d):
    return C.word_count_check(books(spark, d), table(spark, d, "chapters"))


@query(f"""WITH {BOOKS}, {CHAPTERS}
SELECT 'book without chapters' AS issue, count(*) AS n FROM b WHERE id NOT IN (SELECT book_id FROM chapters WHERE book_id IS NOT NULL)
UNION ALL SELECT 'book without fingerprint', count(*) FROM b WHERE id NOT IN (SELECT book_id FROM book_fingerprints WHERE book_id IS NOT NULL)
UNION ALL SELECT 'chapters of an unknown book', count(DISTINCT book_id) FROM chapters WHERE book_id NOT IN (SELECT id FROM books)
UNION ALL SELECT 'word count missing', count(*) FROM b WHERE word_count IS NULL OR word_count < 0
UNION ALL SELECT 'author missing', count(*) FROM b WHERE author IS NULL OR trim(author) = ''
UNION ALL SELECT 'empty chapter', count(*) FROM c WHERE content IS NULL OR trim(content) = ''""")
def health_report(spark, d):
    return C.health_report(books(spark, d), table(spark, d, "chapters"), table(spark, d, "book_fingerprints"))


@query(f"WITH {BOOKS} SELECT 'format' AS facet, format AS value, count(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM b GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM b GROUP BY 2 UNION ALL (SELECT 'author', author, count(*) AS n FROM b WHERE trim(author) <> '' GROUP BY 2 ORDER BY n DESC, author LIMIT 10)")
def facets(spark, d):
    b = books(spark, d)
    parts = [facet(b, c).select(F.lit(c).alias("facet"), "value", "n") for c in ("format", "language", "status")]
    parts.append(facet(b.filter("trim(author) <> ''"), "author", 10).select(F.lit("author").alias("facet"), "value", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"WITH {BOOKS}, x AS (SELECT id, title, author, language, updated_at FROM b WHERE contains(lower(title), 'the') OR contains(lower(author), 'the')) SELECT *, (SELECT count(*) FROM x) AS total FROM x ORDER BY title, id LIMIT 20 OFFSET 20")
def list_books_page(spark, d):
    """The second page of the books whose title or author holds a word."""
    b = books(spark, d).filter(contains_text("the", "title", "author")).select("id", "title", "author", "language", "updated_at")
    return page(with_total(b), [F.asc("title"), F.asc("id")], 2, 20)


@query(f"WITH {BOOKS} SELECT id AS book_id, regexp_replace(trim(title), '^(?i)(the|an|a)\\s+', '') AS sort_name FROM b")
def sort_names(spark, d):
    return C.title_parts(books(spark, d)).select("book_id", "sort_name")


@query(f"""WITH {CHAPTERS}, t AS (SELECT DISTINCT book_id, min(chapter_index) OVER (PARTITION BY book_id) + 2 AS ti FROM c), k AS (SELECT book_id, ti, unnest(range(greatest(0, ti - 2), ti + 3)) AS i FROM t)
SELECT k.book_id, CAST(k.ti AS INT) AS target_index, c.chapter_index, c.id AS chapter_id, c.chapter_index = k.ti AS is_target FROM k JOIN c ON c.book_id = k.book_id AND c.chapter_index = k.i""")
def context_window(spark, d):
    """Two chapters to either side of the third chapter of every book."""
    c = measured_chapters(spark, d)
    targets = c.groupBy("book_id").agg((F.min("chapter_index") + 2).alias("chapter_index"))
    return C.chapter_context(c, targets, 2)


@query(f"""WITH {CHAPTERS}, n AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, id) - 1) // 25 AS block FROM c)
SELECT book_id, block, count(*) AS n, min(chapter_index) AS first_index, max(chapter_index) AS last_index, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars FROM n GROUP BY 1, 2 HAVING count(*) >= 3""")
def macro_windows(spark, d):
    return C.macro_blocks(measured_chapters(spark, d))


@query("""WITH x AS (SELECT DISTINCT book_id, chapter_index FROM chapters), i AS (SELECT *, chapter_index - row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS island FROM x), r AS (SELECT book_id, island, count(*) AS n FROM i GROUP BY ALL)
SELECT book_id, max(n) AS longest_run, count(*) AS runs, CAST(sum(n) AS BIGINT) AS chapters FROM r GROUP BY book_id""")
def chapter_runs(spark, d):
    return C.index_gaps(table(spark, d, "chapters"))


@query(f"WITH {PAIRS} SELECT book_a, book_b, relation, status, confidence, updated_at FROM p")
def canonical_pairs(spark, d):
    return V.canonical_pairs(table(spark, d, "duplicate_pairs")).select("book_a", "book_b", "relation", "status", "confidence", "updated_at")


@query(f"""WITH {PAIRS}, a AS (SELECT lower(book_id) AS book, max(computed_at) AS at FROM book_fingerprints GROUP BY 1)
SELECT book_a, book_b, coalesce(x.at > p.updated_at OR y.at > p.updated_at, false) OR x.at IS NULL OR y.at IS NULL AS stale FROM p LEFT JOIN a x ON x.book = p.book_a LEFT JOIN a y ON y.book = p.book_b""")
def stale_pairs(spark, d):
    return V.stale_pairs(table(spark, d, "duplicate_pairs"), table(spark, d, "book_fingerprints"))


@query(f"WITH {PAIRS} SELECT relation, status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(max(confidence), 6) AS max_confidence, count(longest_contiguous_run) AS with_run FROM p GROUP BY 1, 2")
def pair_report(spark, d):
    p = V.canonical_pairs(table(spark, d, "duplicate_pairs"))
    return p.groupBy("relation", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.max("confidence"), 6).alias("max_confidence"), F.count("longest_contiguous_run").alias("with_run"))


@query(f"""WITH {PAIRS}, {CHAPTERS} SELECT p.book_a, p.book_b, side, count(*) AS chapters, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars
FROM (SELECT book_a, book_b, book_a AS book_id, 'a' AS side FROM p UNION ALL SELECT book_a, book_b, book_b, 'b' FROM p) p JOIN c ON c.book_id = p.book_id GROUP BY ALL""")
def pair_sides(spark, d):
    """What either side of each pair holds: an OR join as two oriented branches."""
    p = V.canonical_pairs(table(spark, d, "duplicate_pairs")).select("book_a", "book_b")
    per = measured_chapters(spark, d).groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("chars").cast("long").alias("chars"))
    return either_key_join(p, "book_a", "book_b", per, "book_id").select("book_a", "book_b", "side", "chapters", "chars")


@query("""WITH e AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, mention_count DESC NULLS LAST, name DESC NULLS LAST) AS n FROM entities) WHERE n = 1)
SELECT series_id, entity_type, count(*) AS n, CAST(coalesce(sum(mention_count), 0) AS BIGINT) AS mentions, max(mention_count) AS most, count(DISTINCT book_id) AS books FROM e GROUP BY 1, 2""")
def entity_report(spark, d):
    e = _entities(spark, d)
    return e.groupBy("series_id", "entity_type").agg(F.count("*").alias("n"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions"), F.max("mention_count").alias("most"), F.countDistinct("book_id").alias("books"))


def _entities(spark, d):
    return latest_rows(table(spark, d, "entities"), ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("mention_count"), F.desc_nulls_last("name")])


@query("""SELECT alias, count(*) AS n, count(DISTINCT id) AS entities FROM (SELECT id, unnest(list_distinct(aliases)) AS alias FROM entities) WHERE alias <> '' GROUP BY 1""")
def alias_cloud(spark, d):
    e = table(spark, d, "entities").select("id", F.explode(F.array_distinct("aliases")).alias("alias")).filter("alias <> ''")
    return e.groupBy("alias").agg(F.count("*").alias("n"), F.countDistinct("id").alias("entities"))


MENTIONS = "m AS (SELECT DISTINCT book_id, lower(trim(name)) AS node FROM entities WHERE book_id IS NOT NULL AND trim(name) <> '')"
EDGES = f"{MENTIONS}, edges AS (SELECT x.node AS source, y.node AS target, count(*) AS weight FROM m x JOIN m y ON x.book_id = y.book_id AND x.node < y.node GROUP BY ALL)"


def _mentions(spark, d):
    return table(spark, d, "entities").filter("book_id is not null and trim(name) <> ''").select("book_id", F.lower(F.trim("name")).alias("node"))


@query(f"WITH {EDGES} SELECT * FROM edges")
def co_mentions(spark, d):
    return G.co_mention_edges(_mentions(spark, d), "book_id", "node")


@query(f"""WITH {EDGES}, w AS (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)
SELECT node, neighbour, weight, rank FROM (SELECT source AS node, target AS neighbour, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS rank FROM w) WHERE rank <= 20""")
def entity_neighbours(spark, d):
    return G.neighbours(G.co_mention_edges(_mentions(spark, d), "book_id", "node"))


@query()
def bounded_paths_all(spark, d):
    """How far, up to five hops, every node is from every other."""
    return G.met_distances(_mentions(spark, d), "book_id", "node")


TREE = """SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"""


@query(f"""WITH RECURSIVE e AS ({TREE}), t AS (SELECT 'r' || r_regionkey AS node, 0 AS level, 'r' || r_regionkey AS path FROM region UNION ALL SELECT e.child, t.level + 1, t.path || '/' || e.child FROM t JOIN e ON e.parent = t.node)
SELECT node, level, path FROM t""")
def tree_levels(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"))
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.tree_levels(n.union(c), roots)


@query()
def entity_communities(spark, d):
    """Communities of the entities met in the same books, within each series."""
    e = table(spark, d, "entities").filter("book_id is not null and series_id is not null and trim(name) <> ''").select("series_id", "book_id", F.lower(F.trim("name")).alias("node")).distinct()
    left, right = e.withColumnRenamed("node", "source"), e.withColumnRenamed("node", "target")
    edges = left.join(right, ["series_id", "book_id"]).filter(F.col("source") < F.col("target")).groupBy("series_id", "source", "target").agg(F.count("*").alias("weight"))
    return G.communities(edges, "series_id")


@query()
def same_name_candidates(spark, d):
    """Entities of one book and type whose names resemble each other."""
    e = table(spark, d, "entities").filter("book_id is not null and entity_type is not null")
    return G.same_name_candidates(e, ["book_id", "entity_type"], "id", "name")


@query("""SELECT p.p_brand AS signal, c.c_custkey AS user, CAST(count(*) AS BIGINT) AS weight FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY ALL""")
def preference_weights(spark, d):
    """How strongly each signal (a brand) marks each user."""
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("p_brand").alias("signal"), F.col("c_custkey").alias("user")).agg(F.count("*").alias("weight"))


@query("""WITH r AS (SELECT s.s_suppkey AS person, l.l_returnflag AS role, l.l_partkey, l.l_quantity FROM supplier s JOIN lineitem l ON l.l_suppkey = s.s_suppkey)
SELECT person, count(DISTINCT l_partkey) AS items, CAST(sum(l_quantity) AS BIGINT) AS amount, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM r GROUP BY person""")
def person_rollup(spark, d):
    """Per person: distinct items, amount over all roles, the roles."""
    j = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", "l_quantity").join(table(spark, d, "supplier").select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("s_suppkey").alias("person")).agg(F.countDistinct("l_partkey").alias("items"), F.sum("l_quantity").cast("long").alias("amount"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("roles"))
