"""Reports over the books of a collection and their chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_rows

#: Fixed value: white space of Unicode as a class that Java and RE2 read alike.
SPACE = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def current_books(books: DataFrame) -> DataFrame:
    """The latest row of each book id; ties fall to the row that sorts last."""
    rest = [F.desc_nulls_last(c) for c in ("title", "author", "word_count", "metadata_quality", "file_hash")]
    return latest_rows(books, ["id"], [F.desc_nulls_last("updated_at"), *rest])


def current_chapters(chapters: DataFrame, **measures: Column) -> DataFrame:
    """One row per chapter id: the one ingested last. With measures, these are
    taken in the scan and stand in for the content, which then is never shuffled."""
    if measures:
        chapters = chapters.select(*[c for c in chapters.columns if c != "content"], *[m.alias(n) for n, m in measures.items()])
    return latest_rows(chapters, ["id"], [F.desc_nulls_last("ingested_at")])


def visible_chars(col: str) -> Column:
    """Characters of a text that aren't white space."""
    return F.length(F.regexp_replace(col, SPACE, ""))


def library_stats(books: DataFrame, libraries: DataFrame) -> DataFrame:
    """Per library: books, known words, megabytes, formats, books without author."""
    per = books.groupBy("library_id").agg(
        F.count("*").alias("n_books"), F.coalesce(F.sum(F.when(F.col("word_count") >= 0, F.col("word_count"))), F.lit(0)).alias("words"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"),
        F.array_join(F.sort_array(F.collect_set("format")), ",").alias("formats"), F.count_if(F.coalesce(F.trim("author"), F.lit("")) == "").alias("no_author"),
    )
    joined = libraries.select(F.col("id").alias("library_id"), "name").join(per, "library_id", "left")
    return joined.select("library_id", "name", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_books", "words", "bytes")], F.coalesce("formats", F.lit("")).alias("formats"), F.coalesce("no_author", F.lit(0)).alias("no_author"))


def word_count_check(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per book: the declared words, the characters its chapters really hold, the
    declared and the real number of chapters."""
    real = current_chapters(chapters, visible=visible_chars("content")).groupBy("book_id").agg(F.coalesce(F.sum("visible"), F.lit(0)).cast("long").alias("real_chars"), F.count("*").alias("real_chapters"))
    return books.select(F.col("id").alias("book_id"), "word_count", "chapter_count").join(real, "book_id", "left").select("book_id", "word_count", "chapter_count", F.coalesce("real_chars", F.lit(0)).alias("real_chars"), F.coalesce("real_chapters", F.lit(0)).alias("real_chapters"))


def health_report(books: DataFrame, chapters: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Issues of the collection and how many rows have each."""
    ids = chapters.select(F.col("book_id").alias("id")).distinct()
    prints = fingerprints.select(F.col("book_id").alias("id")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
    out = count(books.join(ids, "id", "left_anti"), "book without chapters")
    for df, name in (
        (books.join(prints, "id", "left_anti"), "book without fingerprint"),
        (ids.join(books, "id", "left_anti"), "chapters of an unknown book"),
        (books.filter("word_count is null or word_count < 0"), "word count missing"),
        (books.filter("author is null or trim(author) = ''"), "author missing"),
        (current_chapters(chapters).filter("content is null or trim(content) = ''"), "empty chapter"),
    ):
        out = out.union(count(df, name))
    return out


def exact_file_pairs(books: DataFrame) -> DataFrame:
    """Books with the same non-empty file hash, smaller id first."""
    b = books.filter("file_hash is not null and file_hash <> ''").select("file_hash", "id", "file_size_bytes")
    right = b.select("file_hash", F.col("id").alias("book_b_id"), F.col("file_size_bytes").alias("size_b"))
    return b.join(right, "file_hash").filter(F.col("id") < F.col("book_b_id")).select(F.col("id").alias("book_a_id"), "book_b_id", "file_hash", F.coalesce(F.col("file_size_bytes") == F.col("size_b"), F.lit(False)).alias("same_size"))


def exact_content_pairs(fingerprints: DataFrame) -> DataFrame:
    """Books with the same normalised content, by their latest fingerprint."""
    f = latest_rows(fingerprints, ["book_id"], [F.desc_nulls_last("computed_at"), F.desc_nulls_last("conservative_hash")]).filter("char_count > 0").select("conservative_hash", "book_id", "char_count")
    right = f.select("conservative_hash", F.col("book_id").alias("book_b_id"))
    return f.join(right, "conservative_hash").filter(F.col("book_id") < F.col("book_b_id")).select(F.col("book_id").alias("book_a_id"), "book_b_id", "char_count")


def chapter_context(chapters: DataFrame, targets: DataFrame, width: int = 2) -> DataFrame:
    """The chapters within `width` of each target(book_id, chapter_index), the
    target marked. The range is spelt out as keys, so it is an equi-join."""
    width = min(5, max(0, width))
    near = targets.select("book_id", F.col("chapter_index").alias("target_index"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("chapter_index") - width), F.col("chapter_index") + width)).alias("chapter_index"))
    return near.join(chapters.select("book_id", "chapter_index", "id"), ["book_id", "chapter_index"]).select("book_id", "target_index", "chapter_index", F.col("id").alias("chapter_id"), (F.col("chapter_index") == F.col("target_index")).alias("is_target"))


def macro_blocks(chapters: DataFrame, size: int = 25, least: int = 3) -> DataFrame:
    """Blocks of so many consecutive chapters(book_id, chapter_index, id, chars) of
    a book; shorter rests than `least` are dropped."""
    w = Window.partitionBy("book_id").orderBy("chapter_index", "id")
    numbered = chapters.withColumn("block", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.groupBy("book_id", "block").agg(F.count("*").alias("n"), F.min("chapter_index").alias("first_index"), F.max("chapter_index").alias("last_index"), F.sum("chars").cast("long").alias("chars")).filter(F.col("n") >= least)


def index_gaps(chapters: DataFrame) -> DataFrame:
    """Per book the runs of consecutive chapter indices (gaps and islands)."""
    d = chapters.select("book_id", "chapter_index").distinct()
    w = Window.partitionBy("book_id").orderBy("chapter_index")
    runs = d.withColumn("island", F.col("chapter_index") - F.row_number().over(w)).groupBy("book_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("book_id").agg(F.max("n").alias("longest_run"), F.count("*").alias("runs"), F.sum("n").alias("chapters"))


def title_parts(books: DataFrame) -> DataFrame:
    """Sort name (leading article dropped), series and volume read from titles."""
    title = F.trim("title")
    number = F.regexp_extract(title, r"(?i)(?:vol\.?|volume|book|part|#|第)\s*([0-9]+)", 1)
    series = F.trim(F.regexp_replace(title, r"(?i)[\s,:(\-]*(?:vol\.?|volume|book|part|#|第)\s*[0-9]+.*$", ""))
    return books.select(
        F.col("id").alias("book_id"), F.regexp_replace(title, r"(?i)^(the|an|a)\s+", "").alias("sort_name"), F.when(number != "", number.cast("int")).alias("volume"),
        F.when((number != "") & (F.length(series) >= 2), series).alias("series_name"),
    )
