"""Queries over texts: cleaning, profiles, splitting, versions of works."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.normalize import conservative_text, layout_text, text_integrity
from ..operators import catalog as C
from ..operators import versions as V
from ..sources.tables import table
from .queries_books import CHAPTERS, PAIRS, chapters
from .register import registry

QUERIES, SQL, query = registry()

HAN, KANA, HANGUL = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}", r"\x{3040}-\x{30FF}", r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}"
N = "length(regexp_replace(text, '[^{0}]', '', 'g'))"


@query(f"""WITH x AS (SELECT doc_id, {N.format(HAN)} AS han, {N.format(KANA)} AS kana, {N.format(HANGUL)} AS hangul, {N.format('A-Za-z')} AS latin FROM documents WHERE text IS NOT NULL), y AS (SELECT *, greatest(han + kana + hangul + latin, 1) AS total FROM x)
SELECT doc_id, CASE WHEN hangul / total > 0.15 THEN 'korean' WHEN kana / total > 0.15 THEN 'japanese' WHEN han / total > 0.3 THEN 'chinese' ELSE 'english' END AS detected FROM y""")
def language_profile(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.language_profile("text").alias("detected"))


def _share(chars: str) -> str:
    return f"length(regexp_replace(s, '[^{chars}]', '', 'g')) / length(s)"


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE substr(text, 1, 2000) || substr(text, CAST(length(text) // 2 AS BIGINT) - 999, 2000) || substr(text, length(text) - 1999, 2000) END AS s FROM documents)
SELECT doc_id, CASE WHEN coalesce(length(s), 0) = 0 THEN 'unknown' WHEN {_share(T.SAMPLED['japanese'])} > 0.05 THEN 'japanese' WHEN {_share(T.SAMPLED['korean'])} > 0.05 THEN 'korean' WHEN {_share(T.SAMPLED['chinese'])} > 0.1 THEN 'chinese' ELSE 'english' END AS detected FROM x""")
def language_by_samples(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_by_samples("text").alias("detected"))


@query("""SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) + len(regexp_extract_all(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]', ' ', 'g'), '[\\p{L}\\p{N}]+')), 0) AS words FROM documents""")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.simple_word_count("text").alias("words"))


@query()
def clean_text(spark, d):
    """Cleaned text and noise of every parsed document."""
    p = table(spark, d, "parsed_documents").filter("content is not null")
    return p.select("id", T.clean_text("content").alias("cleaned"), T.noise_score("content").alias("noise"), T.text_quality("content").alias("quality"))


MARKS = r"!-/:-@\[-`{-~。、！？；：「」『』（）【】《》"
CJK = HAN + KANA + r"\x{AC00}-\x{D7AF}"


@query(f"""SELECT doc_id, CAST(greatest(1, floor({N.format(CJK)} * 1.5 + len(regexp_extract_all(text, '[0-9A-Za-z]+')) * 1.3 + {N.format(MARKS)} * 0.5)) AS INT) AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimate(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.token_estimate("text").alias("tokens"))


@query("SELECT lang, source, count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(DISTINCT text) AS distinct_texts, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank FROM documents GROUP BY 1, 2")
def corpus_profile(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars"), F.countDistinct("text").alias("distinct_texts"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_text_copies(spark, d):
    g = table(spark, d, "documents").filter("text <> ''").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return g.filter("copies > 1")


@query()
def sentence_split(spark, d):
    """Sentences and their characters per document."""
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", T.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


@query()
def chapter_split(spark, d):
    """Chapters found in every parsed document."""
    c = table(spark, d, "parsed_documents").filter("content is not null").dropDuplicates(["id"]).select("id", F.posexplode(T.chapters_of("content")).alias("chapter_index", "c"))
    return c.select("id", "chapter_index", "c.title", "c.start", "c.end")


@query()
def chunk_documents(spark, d):
    """Chunks of every parsed document."""
    c = table(spark, d, "parsed_documents").filter("content is not null").dropDuplicates(["id"]).select("id", F.explode(T.chunks_of("content")).alias("c"))
    return c.select("id", "c.chunk_index", "c.content", "c.dialogue")


@query()
def normalized_chapters(spark, d):
    """Hashes of the two normal forms and the integrity of every chapter."""
    c = chapters(spark, d).filter("content is not null")
    return c.select(F.col("id").alias("chapter_id"), F.sha2(conservative_text("content"), 256).alias("conservative_hash"), F.sha2(layout_text("content"), 256).alias("layout_hash"), text_integrity("content").alias("integrity_bps"))


@query()
def fingerprint_books(spark, d):
    return V.book_fingerprints(chapters(spark, d))


@query()
def winnow_passages(spark, d):
    """Winnowed passages per chapter: how many, and a digest of them."""
    a = V.passage_anchors(chapters(spark, d))
    return a.groupBy("book_id", "chapter_id").agg(F.count("*").alias("anchors"), F.bit_xor(F.xxhash64("hash", "position")).alias("digest"))


ITEMS = f"{CHAPTERS}, items AS (SELECT DISTINCT book_id, sha256(content) AS hash FROM c WHERE length(content) >= 120 AND book_id IS NOT NULL), usual AS (SELECT hash FROM items GROUP BY hash HAVING count(*) BETWEEN 2 AND 50), kept AS (SELECT i.* FROM items i JOIN usual USING (hash))"


def _raw_items(spark, d):
    return chapters(spark, d).filter("length(content) >= 120 and book_id is not null").select("book_id", F.sha2("content", 256).alias("hash"))


@query(f"WITH {ITEMS} SELECT x.book_id AS book_a, y.book_id AS book_b, count(*) AS shared FROM kept x JOIN kept y ON x.hash = y.hash AND x.book_id < y.book_id GROUP BY 1, 2")
def shared_chapter_candidates(spark, d):
    """Books with a chapter in common, word for word."""
    return V.shared_hash_candidates(_raw_items(spark, d), 1)


@query(f"WITH {ITEMS}, df AS (SELECT hash, count(*) AS books FROM items GROUP BY hash HAVING count(*) BETWEEN 2 AND 50) SELECT books, count(*) AS hashes, CAST(sum(books * (books - 1) // 2) AS BIGINT) AS pairs FROM df GROUP BY books")
def pair_contributions(spark, d):
    return V.pair_contributions(_raw_items(spark, d))


@query(f"""WITH {ITEMS}, ch AS (SELECT DISTINCT id AS book_id FROM books WHERE updated_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00')
SELECT x.book_id AS book_a, y.book_id AS book_b, count(*) AS shared FROM kept x JOIN kept y ON x.hash = y.hash AND x.book_id < y.book_id WHERE x.book_id IN (SELECT book_id FROM ch) OR y.book_id IN (SELECT book_id FROM ch) GROUP BY 1, 2""")
def incremental_candidates(spark, d):
    """The same for books changed since a day."""
    changed = table(spark, d, "books").filter("updated_at >= '2025-01-01'").select(F.col("id").alias("book_id"))
    return V.shared_hash_candidates(_raw_items(spark, d), 1, changed=changed)


def _aligned(spark, d):
    from ..plans.durable import Scratch

    prints = Scratch(spark).keep(V.chapter_fingerprints(chapters(spark, d).filter("book_id is not null and chapter_index is not null")))
    items = prints.filter(F.col("char_count") >= V.INFORMATIVE_CHARS).select("book_id", F.col("layout_hash").alias("hash"))
    return V.align_pairs(V.shared_hash_candidates(items, V.MIN_SHARED_CHAPTERS), prints), prints


@query()
def align_pairs(spark, d):
    """Ordered alignment of every candidate pair of books."""
    return _aligned(spark, d)[0]


@query()
def classify_pairs(spark, d):
    """Relation, contained side and confidence of every candidate pair."""
    c = V.classify(_aligned(spark, d)[0])
    return c.select("book_a", "book_b", "relation", "contained", F.round("confidence", 6).alias("confidence"), "shared", "longest_run", "order_score")


@query()
def content_quality(spark, d):
    return V.content_quality(V.chapter_fingerprints(chapters(spark, d).filter("book_id is not null")))


@query(f"""WITH {PAIRS}, e AS (SELECT book_a, book_b, relation AS kind, coalesce(shared_chapters, 0) AS amount FROM p)
SELECT book_a, book_b, bool_or(kind = 'exact_file') AS exact_file, bool_or(kind = 'exact_content') AS exact_content, max(amount) AS shared_chapters FROM e GROUP BY 1, 2""")
def evidence_merge(spark, d):
    """Evidence of several kinds brought together by canonical pair."""
    p = V.canonical_pairs(table(spark, d, "duplicate_pairs"))
    kind = F.when(F.col("relation") == "exact_file", "file").when(F.col("relation") == "exact_content", "content")
    flags = p.select("book_a", "book_b", F.coalesce(kind, F.lit("other")).alias("kind"), F.lit(0).alias("amount"))
    shared = p.select("book_b", "book_a", F.lit("chapters").alias("kind"), F.coalesce("shared_chapters", F.lit(0)).alias("amount"))
    return V.merge_evidence(flags, shared).select("book_a", "book_b", "exact_file", "exact_content", "shared_chapters")


@query()
def minhash_lsh_pairs(spark, d):
    """Documents alike by signature: each class of equal ones met once."""
    from ..plans.durable import Scratch

    docs = table(spark, d, "documents").filter("length(text) >= 5")
    sig = Scratch(spark).keep(V.minhash_signatures(docs, "doc_id", "text"))
    return V.lsh_candidates(sig)


LABELLED = """l AS (SELECT doc_id, lang AS expected, CASE WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS predicted FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
s AS (SELECT expected AS relation, count(*) AS support, count(*) FILTER (WHERE expected = predicted) AS tp FROM l GROUP BY 1), n AS (SELECT predicted AS relation, count(*) AS named FROM l GROUP BY 1)"""


@query(f"""WITH {LABELLED}, f AS (SELECT s.support, s.tp, coalesce(n.named, 0) AS named FROM s LEFT JOIN n USING (relation))
SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (named + support) ELSE 0 END), 6) AS macro_f1, count(*) AS classes FROM f""")
def eval_summary(spark, d):
    """Accuracy, and the mean F1 over the classes that occur, of the same rule."""
    return V.evaluation_summary(eval_metrics(spark, d))


@query("""WITH l AS (SELECT doc_id, lang AS expected, CASE WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'zh' ELSE 'en' END AS predicted FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
s AS (SELECT expected AS relation, count(*) AS support, count(*) FILTER (WHERE expected = predicted) AS tp FROM l GROUP BY 1), n AS (SELECT predicted AS relation, count(*) AS named FROM l GROUP BY 1),
m AS (SELECT relation, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(named, 0) AS named FROM s FULL JOIN n USING (relation)), r AS (SELECT *, CASE WHEN named > 0 THEN tp / named ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS q FROM m)
SELECT relation, support, CAST(tp AS BIGINT) AS tp, named, round(p, 6) AS "precision", round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r""")
def eval_metrics(spark, d):
    """A rule for the language of a text held against the labels."""
    t = table(spark, d, "documents").filter("lang is not null and text is not null")
    rule = F.when(F.col("text").rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(F.col("text").rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]"), "zh").otherwise("en")
    e = V.evaluate(t.select("doc_id", F.col("lang").alias("expected")), t.select("doc_id", rule.alias("predicted")), "doc_id")
    return e.select("relation", "support", "tp", "named", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
