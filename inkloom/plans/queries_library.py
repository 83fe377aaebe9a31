"""Queries of a library's pages: lists, shelves, recommendations, queues, scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import graph as G
from ..operators import shelves as H
from ..operators import versions as V
from ..sources.tables import table
from .queries_books import BOOKS, EDGES, PAIRS, _entities, _mentions, books
from .queries_reading import SECS, SESSIONS, sessions
from .register import registry

QUERIES, SQL, query = registry()

PROGRESS = f"""{SESSIONS}, {BOOKS}, g AS (SELECT user_id, book_id, CAST(sum({SECS}) AS BIGINT) AS secs, sum(greatest(coalesce(words_read, 0), 0)) AS words, max(started_at) AS last_read_at FROM s WHERE user_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT g.user_id, g.book_id, round(CASE WHEN b.word_count > 0 THEN least(1.0, words / b.word_count) ELSE 0 END, 6) AS progress, g.secs, g.last_read_at FROM g JOIN b ON b.id = g.book_id)"""
SHOWN = "SELECT * FROM b WHERE status NOT IN ('archived', 'duplicate')"


def _progress(spark, d):
    return H.reading_progress(sessions(spark, d), books(spark, d))


@query(f"WITH {PROGRESS} SELECT * FROM pr")
def reading_progress(spark, d):
    return _progress(spark, d)


@query(f"""WITH {PROGRESS}, x AS (SELECT *, CASE WHEN progress >= 1 THEN 'finished' ELSE 'reading' END AS shelf FROM pr WHERE progress > 0)
SELECT user_id, shelf, book_id, progress, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, shelf ORDER BY last_read_at DESC, book_id) AS rank FROM x) WHERE rank <= 15""")
def reading_shelves(spark, d):
    """Per user what is being read and what is finished."""
    return H.reading_shelves(_progress(spark, d)).select("user_id", "shelf", "book_id", "progress", "rank")


def _signal_sql(*cols: str) -> str:
    return " UNION ".join(f"SELECT id AS book_id, '{c}:' || trim({c}) AS signal FROM b WHERE trim({c}) <> '' AND status <> 'archived'" for c in cols)


ENGAGED = "1 + 3 * progress + least(secs / 3600, 6.0) + CASE WHEN progress >= 1 THEN 2 ELSE 0 END"


def _weights_sql(*cols: str) -> str:
    return f"""sg AS ({_signal_sql(*cols)}), wt AS (SELECT user_id, signal, round(sum({ENGAGED}), 6) AS weight FROM pr JOIN sg USING (book_id) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, signal) AS rank FROM wt) WHERE rank <= 12)"""


@query(f"WITH {PROGRESS}, {_weights_sql('author', 'language', 'format')} SELECT user_id, signal, weight, rank FROM top")
def preference_signals(spark, d):
    """What marks each user: engagement summed over the signals of the books read."""
    return H.preference_signals(_progress(spark, d), H.signals_of(books(spark, d).filter("status <> 'archived'"), "author", "language", "format"))


@query(f"""WITH {PROGRESS}, {_weights_sql('author')}, sc AS (SELECT t.user_id, g.book_id, round(sum(weight), 5) AS score FROM top t JOIN sg g USING (signal) WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.user_id = t.user_id AND pr.book_id = g.book_id) GROUP BY ALL),
nw AS (SELECT id AS book_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, id) AS rank FROM ({SHOWN}) ORDER BY created_at DESC NULLS LAST, id LIMIT 8)
SELECT user_id, 'continue' AS shelf, rank, book_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_read_at DESC, book_id) AS rank FROM pr WHERE progress > 0 AND progress < 1) WHERE rank <= 8
UNION ALL SELECT user_id, 'matching', rank, book_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rank FROM sc) WHERE rank <= 8
UNION ALL SELECT user_id, 'recent', rank, book_id FROM (SELECT DISTINCT user_id FROM pr) CROSS JOIN nw""")
def recommendation_groups(spark, d):
    """What to continue, what matches a reader's authors, what is new."""
    b = books(spark, d)
    return H.recommendation_groups(_progress(spark, d), H.visible_books(b), H.signals_of(b.filter("status <> 'archived'"), "author"))


ENTITY_SIGNALS = "sig AS (SELECT DISTINCT book_id, lower(trim(name)) AS signal FROM entities WHERE book_id IS NOT NULL AND trim(name) <> '')"


@query(f"""WITH {BOOKS}, v AS ({SHOWN}), x AS (SELECT id, nullif(trim(author), '') AS author, nullif(language, 'unknown') AS language FROM v), {ENTITY_SIGNALS},
rare AS (SELECT signal, book_id FROM sig JOIN v ON v.id = sig.book_id QUALIFY count(*) OVER (PARTITION BY signal) BETWEEN 2 AND 50),
p AS (SELECT p.id AS a, q.id AS b, 1 AS sa, 0 AS sh FROM x p JOIN x q ON p.author = q.author AND p.id <> q.id UNION ALL SELECT p.book_id, q.book_id, 0, 1 FROM rare p JOIN rare q ON p.signal = q.signal AND p.book_id <> q.book_id),
g AS (SELECT a, b, max(sa) AS same_author, sum(sh) AS shared FROM p GROUP BY ALL), s AS (SELECT g.*, CAST(coalesce(p.language = q.language, false) AS INT) AS same_language FROM g JOIN x p ON p.id = a JOIN x q ON q.id = b)
SELECT a, b, CAST(shared AS BIGINT) AS shared, round(least(1.0, 0.15 + 0.25 * same_author + 0.1 * same_language + least(0.08 * shared, 0.35)), 6) AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, same_author DESC, same_language DESC, b DESC) AS rank FROM s) WHERE rank <= 5""")
def similar_works(spark, d):
    """The books most like each book, by author, language and the entities they share."""
    b = H.visible_books(books(spark, d))
    held = _mentions(spark, d).select("book_id", F.col("node").alias("signal")).distinct().join(b.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    return H.similar_works(b, held).select("a", "b", "shared", "score", "rank")


@query(f"""WITH {BOOKS}, v AS ({SHOWN}), t AS (SELECT id AS book_id, title, trim(regexp_replace(regexp_replace(title, '[\\s(\\[【]+(完结|v[0-9]+|[0-9]+)[)\\]】]*$', ''), '[【].*$', '')) AS s, try_cast(regexp_extract(title, '\\s([0-9]+)\\)?$', 1) AS INT) AS volume FROM v WHERE trim(title) <> ''),
k AS (SELECT *, lower(s) AS series_name FROM t WHERE length(s) >= 2 QUALIFY count(*) OVER (PARTITION BY lower(s)) >= 2)
SELECT series_name, book_id, volume, CAST(row_number() OVER (PARTITION BY series_name ORDER BY coalesce(volume, 9999), title, book_id) AS INT) AS position FROM k""")
def series_order(spark, d):
    """Books whose titles differ by a volume or an edition mark only, in order."""
    b = H.visible_books(books(spark, d)).filter("trim(title) <> ''")
    bare = F.trim(F.regexp_replace(F.regexp_replace("title", r"[\s(\[【]+(完结|v[0-9]+|[0-9]+)[)\]】]*$", ""), r"[【].*$", ""))
    t = b.select(F.col("id").alias("book_id"), "title", F.lower(bare).alias("series_name"), F.expr(r"try_cast(regexp_extract(title, '\\s([0-9]+)\\)?$', 1) as int)").alias("volume"))
    return H.series_order(t.filter("length(series_name) >= 2")).select("series_name", "book_id", "volume", "position")


@query(f"""WITH {BOOKS}, {SESSIONS}, r AS (SELECT book_id, count(*) AS n, max(started_at) AS last_at FROM s GROUP BY 1)
SELECT v.id AS book_id, v.title, l.name AS library, coalesce(r.n, 0) AS n_sessions, r.last_at FROM ({SHOWN}) v LEFT JOIN libraries l ON l.id = v.library_id LEFT JOIN r ON r.book_id = v.id ORDER BY v.word_count DESC NULLS LAST, v.created_at DESC NULLS LAST, v.id LIMIT 100""")
def enriched_books(spark, d):
    """The hundred longest books with their library and how often they were read."""
    top = H.sorted_page(H.visible_books(books(spark, d)), "words", size=100).select(F.col("id").alias("book_id"), "title", "library_id")
    read = sessions(spark, d).groupBy("book_id").agg(F.count("*").alias("n"), F.max("started_at").alias("last_at"))
    names = table(spark, d, "libraries").select(F.col("id").alias("library_id"), F.col("name").alias("library"))
    return top.join(names, "library_id", "left").join(read, "book_id", "left").select("book_id", "title", "library", F.coalesce("n", F.lit(0)).alias("n_sessions"), "last_at")


@query(f"""WITH {BOOKS} SELECT id AS book_id, CAST((coalesce(trim(title), '') <> '') AS INT) + CAST((coalesce(trim(author), '') <> '') AS INT) + CAST((coalesce(trim(cover_path), '') <> '') AS INT)
+ CAST((coalesce(trim(language), '') NOT IN ('', 'unknown')) AS INT) + CAST((coalesce(trim(library_id), '') <> '') AS INT) AS quality FROM b""")
def filled_metadata(spark, d):
    b = books(spark, d)
    return b.select(F.col("id").alias("book_id"), H.metadata_quality(b, "title", "author", "cover_path", "language", "library_id").alias("quality"))


@query(f"WITH {BOOKS} SELECT id AS book_id, language, word_count FROM b WHERE language IN ('english', 'chinese', 'japanese') AND word_count >= 100 AND NOT coalesce(contains(lower(title), 'the'), false) AND status IS DISTINCT FROM 'archived' ORDER BY updated_at DESC NULLS LAST, id LIMIT 50")
def smart_shelf(spark, d):
    """A shelf given by rules."""
    rules = [("language", "in", ("english", "chinese", "japanese")), ("word_count", "gte", 100), ("title", "not_contains", "the"), ("status", "neq", "archived")]
    return H.smart_shelf(books(spark, d), rules).select(F.col("id").alias("book_id"), "language", "word_count")


@query("""WITH m AS (SELECT 'u' || c_custkey AS user, c_nationkey AS g FROM customer), gr AS (SELECT n_nationkey AS g, n_regionkey AS scope FROM nation WHERE n_regionkey < 3), dg AS (SELECT 'u' || c_custkey AS user, 3 AS scope FROM customer WHERE c_acctbal > 5000),
held AS (SELECT scope FROM dg UNION SELECT scope FROM gr)
SELECT user, scope FROM m JOIN gr USING (g) UNION SELECT user, scope FROM dg UNION SELECT user, r_regionkey FROM m CROSS JOIN region WHERE r_regionkey NOT IN (SELECT scope FROM held)""")
def visible_scopes(spark, d):
    """Regions as scopes: granted through a nation as group, to single customers, or
    open to all as nobody has a grant for them."""
    c = table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), F.col("c_nationkey").alias("group"), "c_acctbal")
    groups = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("group"), F.col("n_regionkey").alias("scope"))
    return H.visible_scopes(c, c.filter("c_acctbal > 5000").select("user", F.lit(3).alias("scope")), groups, c, table(spark, d, "region").select(F.col("r_regionkey").alias("scope")))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND json_extract_string(props, '$.k') = '1' INTERSECT SELECT user_id FROM events WHERE json_extract_string(props, '$.k') = '2'""")
def attribute_search(spark, d):
    """Users with an event for each of several wanted property sets."""
    e = table(spark, d, "events").withColumn("all", F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").alias("k"))))
    return H.holding_all(e, "user_id", "all", [{"event_type": "view", "k": 1}, {"k": 2}])


@query("""SELECT user_id, '{' || string_agg('"' || event_type || '":' || k, ',' ORDER BY event_type) || '}' AS attributes FROM (SELECT user_id, event_type, max(CAST(json_extract_string(props, '$.k') AS INT)) AS k FROM events WHERE event_type IS NOT NULL GROUP BY ALL HAVING max(CAST(json_extract_string(props, '$.k') AS INT)) IS NOT NULL) GROUP BY 1""")
def attribute_objects(spark, d):
    """Per user the largest property of each kind of event as one JSON object."""
    e = table(spark, d, "events").filter("event_type is not null").withColumn("k", F.get_json_object("props", "$.k").cast("int")).filter("k is not null")
    return H.attributes_json(e, "user_id", "event_type", F.col("k"))


@query("""WITH f AS (SELECT l_orderkey, min(l_shipdate) AS at FROM lineitem GROUP BY 1)
SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, round(avg((epoch_us(f.at) - epoch_us(o_orderdate)) / 1000) FILTER (WHERE f.at IS NOT NULL), 3) AS mean_wait_ms FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def queue_stats(spark, d):
    """Tasks (orders) by status, with the mean time to their first shipment."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("at"))
    wait = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 1000
    o = table(spark, d, "orders").join(first, "o_orderkey", "left")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.avg(wait), 3).alias("mean_wait_ms"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderpriority, o_orderdate, o_orderkey LIMIT 15")
def queue_head(spark, d):
    """The next tasks: by standing, priority and age."""
    standing = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(standing, "o_orderpriority", "o_orderdate", "o_orderkey").limit(15).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT event_id, event_type, level FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'error' WHEN value IS NULL THEN 'warn' ELSE 'info' END AS level FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) WHERE level <> 'info' OR event_type = 'view'")
def log_view(spark, d):
    """The newest rows as log lines; the filter comes after the page."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("value").isNull(), "warn").otherwise("info")
    e = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", level.alias("level"))
    return e.filter((F.col("level") != "info") | (F.col("event_type") == "view"))


@query(f"WITH {BOOKS} SELECT id AS book_id FROM b WHERE status <> 'archived' AND id NOT IN (SELECT book_id FROM entities WHERE book_id IS NOT NULL)")
def books_without_entities(spark, d):
    named = table(spark, d, "entities").select(F.col("book_id").alias("id")).distinct()
    return books(spark, d).filter("status <> 'archived'").join(named, "id", "left_anti").select(F.col("id").alias("book_id"))


@query(f"WITH {BOOKS} SELECT cover_path AS path FROM b WHERE cover_path <> '' UNION SELECT root_path FROM libraries WHERE root_path <> ''")
def used_paths(spark, d):
    """Every path that some row refers to, once."""
    b = books(spark, d).filter("cover_path <> ''").select(F.col("cover_path").alias("path"))
    return b.union(table(spark, d, "libraries").filter("root_path <> ''").select("root_path")).distinct()


@query(f"""WITH {EDGES}, w AS (SELECT source AS node, target AS other, weight, 'outgoing' AS direction FROM edges UNION ALL SELECT target, source, weight, 'incoming' FROM edges)
SELECT node, other, weight, direction FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS rank FROM w) WHERE rank <= 10""")
def entity_relations(spark, d):
    """The strongest relations of each entity, either end, with their direction."""
    e = G.co_mention_edges(_mentions(spark, d), "book_id", "node")
    both = e.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", F.lit("outgoing").alias("direction")).unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight", F.lit("incoming").alias("direction")))
    return H.ranked(both, ["node"], [F.desc("weight"), F.asc("other")], 10).drop("rank")


LATEST_ENTITIES = """e AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, mention_count DESC NULLS LAST, name DESC NULLS LAST) AS n FROM entities) WHERE n = 1)"""


@query(f"""WITH {LATEST_ENTITIES}, {EDGES}, n AS (SELECT lower(trim(name)) AS node, CAST(sum(coalesce(mention_count, 0)) AS BIGINT) AS mentions FROM e WHERE book_id IS NOT NULL AND trim(name) <> '' GROUP BY 1 ORDER BY mentions DESC, node LIMIT 50)
SELECT source, target, weight, round(sqrt(x.mentions) * 5, 6) AS source_size, round(sqrt(y.mentions) * 5, 6) AS target_size FROM edges JOIN n x ON x.node = source JOIN n y ON y.node = target""")
def entity_graph(spark, d):
    """The fifty most mentioned entities and the edges among them."""
    top = _entities(spark, d).filter("book_id is not null and trim(name) <> ''").groupBy(F.lower(F.trim("name")).alias("node")).agg(F.sum(F.coalesce("mention_count", F.lit(0))).alias("mentions"))
    return G.top_subgraph(G.co_mention_edges(_mentions(spark, d), "book_id", "node"), top, 50)


@query(f"""WITH {LATEST_ENTITIES} SELECT series_id, name, count(*) AS n, min(first_appearance_chapter) AS first_chapter, CAST(coalesce(sum(mention_count), 0) AS BIGINT) AS mentions, count(DISTINCT book_id) AS books, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types
FROM (SELECT * EXCLUDE name, lower(trim(name)) AS name FROM e WHERE trim(name) <> '' AND series_id IS NOT NULL) GROUP BY 1, 2""")
def entity_profiles(spark, d):
    e = _entities(spark, d).filter("trim(name) <> '' and series_id is not null").withColumn("name", F.lower(F.trim("name")))
    return e.groupBy("series_id", "name").agg(F.count("*").alias("n"), F.min("first_appearance_chapter").alias("first_chapter"), F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions"), F.countDistinct("book_id").alias("books"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("types"))


@query(f"""WITH {LATEST_ENTITIES} SELECT book_id, id AS entity_id, chapter, position FROM (SELECT book_id, id, coalesce(first_appearance_chapter, 0) AS chapter, CAST(row_number() OVER (PARTITION BY book_id ORDER BY coalesce(first_appearance_chapter, 0), id) AS INT) AS position FROM e WHERE book_id IS NOT NULL) WHERE position <= 100""")
def entity_timeline(spark, d):
    """The first hundred entities of each book in the order they appear."""
    e = _entities(spark, d).filter("book_id is not null").select("book_id", F.col("id").alias("entity_id"), F.coalesce("first_appearance_chapter", F.lit(0)).alias("chapter"))
    return H.ranked(e, ["book_id"], [F.asc("chapter"), F.asc("entity_id")], 100, "position")


@query(f"""WITH {LATEST_ENTITIES}, t AS (SELECT DISTINCT series_id, lower(trim(name)) AS name, entity_type FROM e WHERE trim(name) <> '' AND series_id IS NOT NULL AND entity_type IS NOT NULL)
SELECT x.series_id, x.name, x.entity_type AS type_a, y.entity_type AS type_b FROM t x JOIN t y ON x.series_id = y.series_id AND x.name = y.name AND x.entity_type < y.entity_type""")
def type_conflicts(spark, d):
    """The same name under two types within a series."""
    t = _entities(spark, d).filter("trim(name) <> '' and series_id is not null and entity_type is not null").select("series_id", F.lower(F.trim("name")).alias("name"), "entity_type").distinct()
    return t.withColumnRenamed("entity_type", "type_a").join(t.withColumnRenamed("entity_type", "type_b"), ["series_id", "name"]).filter("type_a < type_b")


@query(f"""WITH {BOOKS}, {{0}} SELECT c.id AS chapter_id, concat_ws(' > ', nullif(trim(b.title), ''), nullif(trim(c.title), ''), '#' || (c.chapter_index + 1)) AS breadcrumb FROM c JOIN b ON b.id = c.book_id""".format("c AS (SELECT id, book_id, title, chapter_index FROM (SELECT id, book_id, title, chapter_index, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS n FROM chapters) WHERE n = 1)"))
def breadcrumbs(spark, d):
    """Where a chapter stands: book > chapter > number."""
    c = C.current_chapters(table(spark, d, "chapters").select("id", "book_id", "title", "chapter_index", "ingested_at"))
    filled = lambda x: F.when(F.trim(x) != "", F.trim(x))
    b = books(spark, d).select(F.col("id").alias("book_id"), filled("title").alias("book"))
    return c.join(b, "book_id").select(F.col("id").alias("chapter_id"), F.concat_ws(" > ", "book", filled("title"), F.concat(F.lit("#"), (F.col("chapter_index") + 1).cast("string"))).alias("breadcrumb"))


@query("""WITH e AS (SELECT CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS parent, n_nationkey AS child FROM nation) SELECT r_regionkey AS node, count(child) AS children FROM region LEFT JOIN e ON parent = r_regionkey WHERE r_regionkey <> 1 GROUP BY 1""")
def merged_nodes(spark, d):
    """A tree in which one node was merged into another: children moved, counts anew."""
    edges = table(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"))
    return G.merge_nodes(table(spark, d, "region").select(F.col("r_regionkey").alias("node")), edges, 1, 0)


@query(f"""WITH RECURSIVE {PAIRS}, ok AS (SELECT book_a, book_b FROM p WHERE status = 'confirmed'), w AS (SELECT book_a AS u, book_b AS v FROM ok UNION SELECT book_b, book_a FROM ok),
reach(node, component) USING KEY (node) AS (SELECT u, u FROM w GROUP BY u UNION SELECT w.v, min(r.component) FROM reach r JOIN w ON r.node = w.u JOIN recurring.reach k ON k.node = w.v WHERE r.component < k.component GROUP BY w.v)
SELECT component AS primary_id, node AS book_id FROM reach WHERE node <> component AND NOT EXISTS (SELECT 1 FROM p WHERE p.book_a = least(node, component) AND p.book_b = greatest(node, component))""")
def unproven_members(spark, d):
    """Books that are one work with a primary only through others: no pair names both."""
    p = V.canonical_pairs(table(spark, d, "duplicate_pairs")).select("book_a", "book_b", "status")
    groups = G.threshold_components(p.filter("status = 'confirmed'").select(F.col("book_a").alias("source"), F.col("book_b").alias("target"), F.lit(1.0).alias("weight")), 1.0)
    far = groups.filter("node <> component").select(F.col("component").alias("primary_id"), F.col("node").alias("book_id"), F.least("node", "component").alias("book_a"), F.greatest("node", "component").alias("book_b"))
    return far.join(p, ["book_a", "book_b"], "left_anti").select("primary_id", "book_id")


@query(f"""WITH {BOOKS}, x AS (SELECT *, nullif(trim(author), '') AS a FROM ({SHOWN})) SELECT a AS author, count(*) AS books, CAST(coalesce(sum(CASE WHEN word_count >= 0 THEN word_count END), 0) AS BIGINT) AS words, max(updated_at) AS last_at FROM x WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def series_counters(spark, d):
    """Authors with several books, how many and how long."""
    b = H.visible_books(books(spark, d)).filter(~H.blank("author"))
    return b.groupBy(F.trim("author").alias("author")).agg(F.count("*").alias("books"), F.coalesce(F.sum(F.when(F.col("word_count") >= 0, F.col("word_count"))), F.lit(0)).alias("words"), F.max("updated_at").alias("last_at")).filter("books >= 2")
