"""The queries of the operators in this package, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .components import connected_components
from .encoding import encode, token_counts
from .mixing import mix_sources
from .names import link_names, linked_pairs
from .neardup import near_duplicate_pairs
from .spans import expand_pairs, repeated_lines, shared_coverage, shared_span_pairs
from .splitting import split_oversized
from .subjects import assign_subjects, train
from .survivors import Field, current_rows, descending, survivorship
from .visual import lookalike_pairs


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that share at least 200 consecutive characters."""
    pairs, members = shared_span_pairs(table(spark, d, "chapters"), min_length=200)
    return expand_pairs(pairs, members, "chapter_a", "chapter_b")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each chapter is found word for word elsewhere."""
    out = shared_coverage(table(spark, d, "chapters"), min_length=200)
    return out.select(F.col("record_id").alias("chapter_id"), F.size("spans").alias("n_spans"), "shared_chars", "n_chars", "coverage", "copies")


def p1_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat one of an earlier chapter, with their places."""
    out = repeated_lines(table(spark, d, "chapters"))
    return out.select(F.col("record_id").alias("chapter_id"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("first_id").alias("first_chapter_id"), F.col("first_start").alias("first_start_char"))


P1_REPEATS_SQL = r"""
WITH c AS (SELECT DISTINCT id, content FROM chapters WHERE id IS NOT NULL AND content IS NOT NULL),
l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM c),
p AS (SELECT id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS pos FROM l),
u AS (SELECT *, trim(regexp_replace(line, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS unit FROM p),
g AS (SELECT *, first_value(id) OVER w AS first_id, first_value(pos) OVER w AS first_pos FROM u WHERE length(unit) >= 80 WINDOW w AS (PARTITION BY unit ORDER BY id, pos))
SELECT id AS chapter_id, pos AS start_char, CAST(pos + length(line) AS INT) AS end_char, first_id AS first_chapter_id, first_pos AS first_start_char FROM g WHERE id <> first_id OR pos <> first_pos
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of which the sets of 5-character shingles are alike at 0.8."""
    pairs, members = near_duplicate_pairs(table(spark, d, "chapters"), similarity=0.8, measure="plain", k=5, min_chars=120)
    return expand_pairs(pairs, members, "chapter_a", "chapter_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each chapter that is like another (weighted similarity of
    0.8), directly or through others: class of equal text and group."""
    pairs, members = near_duplicate_pairs(table(spark, d, "chapters"), similarity=0.8, measure="weighted", k=5, min_chars=120)
    names = members.groupBy("d").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    named = pairs.join(names.select(F.col("d").alias("d1"), F.col("class_id").alias("a")), "d1").join(names.select(F.col("d").alias("d2"), F.col("class_id").alias("b")), "d2")
    groups = connected_components(named, "a", "b")
    each = members.join(names, "d").join(groups, F.col("class_id") == F.col("node"), "left").filter("copies > 1 or component is not null")
    return each.select(F.col("id").alias("chapter_id"), "class_id", F.coalesce("component", "class_id").alias("group_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chapters stored with other characters that look the same."""
    return lookalike_pairs(table(spark, d, "chapters")).select(F.col("a").alias("chapter_a"), F.col("b").alias("chapter_b"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every book that is linked to another."""
    pairs = table(spark, d, "duplicate_pairs").select(F.lower("book_a_id").alias("a"), F.lower("book_b_id").alias("b"))
    return connected_components(pairs, "a", "b").select(F.col("node").alias("book_id"), F.col("component").alias("group_id"))


P4_CTE = """
edges AS (SELECT lower(book_a_id) AS u, lower(book_b_id) AS v FROM duplicate_pairs WHERE lower(book_a_id) <> lower(book_b_id)),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, component) USING KEY (node) AS (
  SELECT u, u FROM both_ways GROUP BY u
  UNION
  SELECT b.v, min(r.component) FROM reach r JOIN both_ways b ON r.node = b.u JOIN recurring.reach k ON k.node = b.v
  WHERE r.component < k.component GROUP BY b.v
)"""
P4_SQL = f"WITH RECURSIVE {P4_CTE} SELECT node AS book_id, component AS group_id FROM reach"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The surviving book of each group, and whence its author and language."""
    groups = p4_found(spark, d)
    books = table(spark, d, "books").select(F.lower("id").alias("book_id"), "author", "language", "word_count", "metadata_quality", "updated_at")
    members = groups.join(current_rows(books, "book_id", "updated_at").withColumn("in_books", F.lit(True)), "book_id", "left")
    found = F.col("in_books")
    words = F.when(F.col("word_count") >= 0, F.col("word_count"))
    rank = [descending(words), descending(F.col("metadata_quality")), descending(F.unix_micros("updated_at")), F.col("book_id")]
    fields = [
        Field("survivor_id", F.col("book_id"), found),
        Field("author_from_id", F.col("book_id"), F.col("author").rlike(r"(?U)\S")),
        Field("language_from_id", F.col("book_id"), F.col("language") != "unknown"),
    ]
    return survivorship(members, "group_id", rank, fields)


P5_SQL = f"""
WITH RECURSIVE {P4_CTE},
cur AS (
  SELECT * FROM (
    SELECT lower(id) AS book_id, author, language, CASE WHEN word_count >= 0 THEN word_count END AS words, metadata_quality, updated_at,
      row_number() OVER (PARTITION BY lower(id) ORDER BY updated_at DESC NULLS LAST, author DESC NULLS LAST, language DESC NULLS LAST, word_count DESC NULLS LAST, metadata_quality DESC NULLS LAST) AS n
    FROM books) WHERE n = 1),
m AS (SELECT r.component AS group_id, c.* FROM reach r LEFT JOIN cur c ON c.book_id = r.node),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY (book_id IS NULL), words DESC NULLS LAST, metadata_quality DESC NULLS LAST, updated_at DESC NULLS LAST, book_id) AS k FROM m)
SELECT group_id,
  arg_min(book_id, k) AS survivor_id,
  arg_min(book_id, k) FILTER (WHERE regexp_matches(author, '[^ \\t\\n\\r\\x{{3000}}\\x{{A0}}]')) AS author_from_id,
  arg_min(book_id, k) FILTER (WHERE language <> 'unknown') AS language_from_id
FROM ranked GROUP BY group_id
"""


def _split_both(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "split_limits")
    chapters = split_oversized(table(spark, d, "chapters"), "id", "content", "chapter", limits)
    return chapters.unionByName(split_oversized(table(spark, d, "parsed_documents"), "id", "content", "parsed", limits))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every text over its limit, and whether a cut within a word is inevitable."""
    return _split_both(spark, d).select("record_kind", "record_id", "forced").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every text over its limit."""
    each = _split_both(spark, d).select("record_kind", "record_id", F.posexplode("pieces").alias("piece_index", "piece"))
    return each.select("record_kind", "record_id", "piece_index", F.col("piece.start").alias("start_char"), F.col("piece.end").alias("end_char"), F.col("piece.text").alias("text"))


P6_SQL = """
SELECT DISTINCT k.record_kind, r.id AS record_id,
  CAST(list_max(list_transform(regexp_split_to_array(content, '[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}.!?。！？…;；]'), lambda x: length(x))) > k.max_chars AS INTEGER) AS forced
FROM (SELECT 'chapter' AS kind, id, content FROM chapters UNION ALL SELECT 'parsed', id, content FROM parsed_documents) r
JOIN split_limits k ON k.record_kind = r.kind
WHERE length(content) > k.max_chars AND id IS NOT NULL
"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").filter(F.col("entity_type").isin("character", "organization"))
    spellings = F.concat(F.array("name", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return link_names(e, "series_id", "entity_type", "id", spellings)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one series that denote the same person or organisation."""
    return linked_pairs(_named(spark, d)).select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))


def p7_entities(spark: SparkSession, d: str) -> DataFrame:
    """For each named row the smallest id of those that denote the same one."""
    links = _named(spark, d)
    first = links.groupBy("entity_key").agg(F.min("id").alias("group_id"))
    return links.join(first, "entity_key").select(F.col("id").alias("entity_id"), "group_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every text."""
    return encode(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    sources = docs.select("doc_id", "source")
    sizes = token_counts(docs, "doc_id", "text", "byte_bpe_50k").join(sources, "doc_id")
    return mix_sources(sizes, table(spark, d, "source_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Which documents the mix holds, and how often."""
    return _mixed(spark, d)[0].select("doc_id", "source", "copies", "n_tokens")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source has of the mix, beside its target."""
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = train(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects"))
    return assign_subjects(docs, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_coverage, p1_repeats, p2_found, p2_groups, p3_found, p4_found, p5_found, p6_found, p6_pieces,
        p7_found, p7_entities, p8_ids, p9_mix, p9_report, p10_found,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"p1_repeats": P1_REPEATS_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
