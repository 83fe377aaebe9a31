"""Versions of one work: fingerprints, candidates, alignment, classification.

Candidates come from equal fingerprints: distinct (book, hash), hashes of too
many books left out as boilerplate (that is the operator's definition, not a
cap), pairs by an equi-join on the hash. Only candidate pairs are aligned.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import conservative_text, integrity_bps, layout_text, source_hash, winnow_udf

#: Thresholds of the relations.
INFORMATIVE_CHARS, MAX_BOOKS_PER_HASH, MIN_SHARED_CHAPTERS, MIN_SHARED_PASSAGES = 120, 50, 2, 4
CONTAINED = {"shared": 10, "short_book": 10, "short_shared": 2, "coverage": 0.8, "order": 0.8, "added_chapters": 1, "added_chars": 120}
OVERLAP = {"shared": 3, "coverage": 0.6, "order": 0.8}
PARTIAL = {"shared": 10, "run": 3, "passages": 8}


def chapter_fingerprints(chapters: DataFrame) -> DataFrame:
    """book_id, chapter_index, chapter_id, conservative_hash, layout_hash,
    char_count (of the layout form), raw_hash. Null content counts as empty."""
    c = chapters.select("book_id", "chapter_index", F.col("id").alias("chapter_id"), F.coalesce("content", F.lit("")).alias("content"))
    c = c.withColumn("conservative", conservative_text("content")).withColumn("layout", layout_text("content"))
    return c.select("book_id", "chapter_index", "chapter_id", F.sha2("conservative", 256).alias("conservative_hash"), F.sha2("layout", 256).alias("layout_hash"), F.length("layout").alias("char_count"), F.sha2("content", 256).alias("raw_hash"))


def book_fingerprints(chapters: DataFrame) -> DataFrame:
    """Per book the hashes over all chapters in order. Splitting a chapter leaves
    the two content hashes as they are. A book's text is one task's group: books
    are bounded, a running serial included, by what one reader can read."""

    def of_book(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        from inkloom.functions.normalize import conservative, layout

        pdf = pdf.sort_values(["chapter_index", "id"])
        texts = [t or "" for t in pdf["content"]]
        a, b, chars = hashlib.sha256(), hashlib.sha256(), 0
        for t in texts:
            x = layout(t)
            a.update(conservative(t).encode())
            b.update(x.encode())
            chars += len(x)
        return pd.DataFrame([[pdf["book_id"].iloc[0], source_hash(list(zip(pdf["chapter_index"], texts))), a.hexdigest(), b.hexdigest(), chars, integrity_bps(texts)]], columns=["book_id", "source_content_hash", "conservative_hash", "layout_hash", "char_count", "text_integrity_bps"])

    rows = chapters.filter("book_id is not null and chapter_index is not null").select("book_id", "chapter_index", "id", "content")
    return rows.groupBy("book_id").applyInPandas(of_book, "book_id string, source_content_hash string, conservative_hash string, layout_hash string, char_count long, text_integrity_bps int")


def passage_anchors(chapters: DataFrame, gram: int = 13, window: int = 32) -> DataFrame:
    """book_id, chapter_id, hash, position: winnowed passages of all chapters."""
    c = chapters.select("book_id", F.col("id").alias("chapter_id"), F.explode(winnow_udf(gram, window)("content")).alias("a"))
    return c.select("book_id", "chapter_id", "a.hash", "a.position")


def shared_hash_candidates(items: DataFrame, min_shared: int, max_books: int = MAX_BOOKS_PER_HASH, changed: DataFrame | None = None) -> DataFrame:
    """book_a, book_b, shared: books of items(book_id, hash) that have at least
    min_shared hashes in common, of those found in 2 to max_books books. changed
    (book_id) restricts the result to pairs with a changed side."""
    distinct = items.select("book_id", "hash").distinct()
    usual = distinct.groupBy("hash").agg(F.count("*").alias("df")).filter(F.col("df").between(2, max_books)).select("hash")
    kept = distinct.join(usual, "hash")
    left, right = kept.select("hash", F.col("book_id").alias("book_a")), kept.select("hash", F.col("book_id").alias("book_b"))
    pairs = left.join(right, "hash").filter(F.col("book_a") < F.col("book_b")).groupBy("book_a", "book_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    if changed is None:
        return pairs
    some = changed.select("book_id").distinct().withColumn("hit", F.lit(True))
    marked = pairs.join(some.select(F.col("book_id").alias("book_a"), F.col("hit").alias("hit_a")), "book_a", "left").join(some.select(F.col("book_id").alias("book_b"), F.col("hit").alias("hit_b")), "book_b", "left")
    return marked.filter("hit_a or hit_b").select("book_a", "book_b", "shared")


def pair_contributions(items: DataFrame, max_books: int = MAX_BOOKS_PER_HASH) -> DataFrame:
    """How many pairs the hashes of each frequency would bring: known before the
    join, so that a run can be refused."""
    df = items.select("book_id", "hash").distinct().groupBy("hash").agg(F.count("*").alias("books")).filter(F.col("books").between(2, max_books))
    return df.groupBy("books").agg(F.count("*").alias("hashes"), F.sum(F.expr("books * (books - 1) div 2")).alias("pairs"))


def align(a: list[str], b: list[str], chars_a: list[int], chars_b: list[int]) -> dict:
    """Equal chapters of two books in order, each at most once: a longest
    increasing subsequence over equal hashes (a ascending, b descending), and
    what it says of either side."""
    where = defaultdict(list)
    for j, h in enumerate(b):
        where[h].append(j)
    tails: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    ends: list[int] = []
    for i, h in enumerate(a):
        for j in reversed(where.get(h, ())):
            k = bisect.bisect_left(tails, j)
            nodes.append((i, j, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(nodes) - 1)
            else:
                tails[k], ends[k] = j, len(nodes) - 1
    chain, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = nodes[at]
        chain.append((i, j))
    chain.reverse()
    run = best = 0
    last = (-2, -2)
    for i, j in chain:
        run = run + 1 if (i, j) == (last[0] + 1, last[1] + 1) else 1
        best, last = max(best, run), (i, j)
    possible = 0
    count_a = defaultdict(int)
    for h in a:
        count_a[h] += 1
    for h, n in count_a.items():
        possible += min(n, len(where.get(h, ())))
    got_a, got_b = sum(chars_a[i] for i, _ in chain), sum(chars_b[j] for _, j in chain)
    total_a, total_b = sum(chars_a), sum(chars_b)
    return {
        "shared": len(chain), "coverage_a": len(chain) / len(a) if a else 0.0, "coverage_b": len(chain) / len(b) if b else 0.0,
        "char_coverage_a": got_a / total_a if total_a else 0.0, "char_coverage_b": got_b / total_b if total_b else 0.0,
        "longest_run": best, "order_score": len(chain) / possible if possible else 0.0, "chapters_a": len(a), "chapters_b": len(b),
        "chars_a": total_a, "chars_b": total_b, "unique_chars_a": total_a - got_a, "unique_chars_b": total_b - got_b,
    }


ALIGNED = "book_a string, book_b string, shared int, coverage_a double, coverage_b double, char_coverage_a double, char_coverage_b double, longest_run int, order_score double, chapters_a int, chapters_b int, chars_a long, chars_b long, unique_chars_a long, unique_chars_b long"


def align_pairs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The alignment of each candidate pair(book_a, book_b). A book's chapters are
    brought together once as one array of (index, hash, characters)."""
    books = prints.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_index", "chapter_id", "layout_hash", "char_count"))).alias("c"))
    both = pairs.select("book_a", "book_b").join(books.select(F.col("book_id").alias("book_a"), F.col("c.layout_hash").alias("ha"), F.col("c.char_count").alias("ca")), "book_a").join(books.select(F.col("book_id").alias("book_b"), F.col("c.layout_hash").alias("hb"), F.col("c.char_count").alias("cb")), "book_b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{"book_a": r.book_a, "book_b": r.book_b} | align(list(r.ha), list(r.hb), [int(x) for x in r.ca], [int(x) for x in r.cb]) for r in p.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    return both.select("book_a", "book_b", "ha", "ca", "hb", "cb").mapInPandas(run, ALIGNED)


def _contained(side: str, other: str) -> Column:
    c = CONTAINED
    enough = (F.col("shared") >= c["shared"]) | ((F.col(f"chapters_{side}") < c["short_book"]) & (F.col("shared") >= c["short_shared"]))
    added = (F.col(f"chapters_{other}") - F.col("shared") >= c["added_chapters"]) | (F.col(f"unique_chars_{other}") >= c["added_chars"])
    return enough & (F.col(f"coverage_{side}") >= c["coverage"]) & (F.col(f"char_coverage_{side}") >= c["coverage"]) & (F.col("order_score") >= c["order"]) & added & (F.col(f"chars_{side}") < F.col(f"chars_{other}"))


def classify(aligned: DataFrame) -> DataFrame:
    """relation and contained side of aligned pairs, by the first rule that holds,
    and the confidence that goes with it. Optional columns exact_file,
    exact_content and passages are evidence from elsewhere."""
    a = aligned
    for name, default in (("exact_file", F.lit(False)), ("exact_content", F.lit(False)), ("passages", F.lit(0))):
        if name not in a.columns:
            a = a.withColumn(name, default)
    high = F.col("shared") >= OVERLAP["shared"]
    for c in ("coverage_a", "coverage_b", "char_coverage_a", "char_coverage_b"):
        high = high & (F.col(c) >= OVERLAP["coverage"])
    high = high & (F.col("order_score") >= OVERLAP["order"])
    partial = (F.col("shared") >= PARTIAL["shared"]) | (F.col("longest_run") >= PARTIAL["run"]) | (F.col("passages") >= PARTIAL["passages"])
    in_a, in_b = _contained("a", "b"), _contained("b", "a")
    relation = F.when(F.col("exact_file"), "exact_file").when(F.col("exact_content"), "exact_content").when(in_a | in_b, "contained_version").when(high, "high_overlap").when(partial, "partial_overlap").otherwise("not_duplicate")
    a = a.withColumn("relation", relation).withColumn("contained", F.when(F.col("relation") == "contained_version", F.when(in_a, "a").otherwise("b")))
    most = F.greatest("coverage_a", "coverage_b", "char_coverage_a", "char_coverage_b")
    mean = (F.col("coverage_a") + F.col("coverage_b") + F.col("char_coverage_a") + F.col("char_coverage_b") + F.col("order_score")) / 5
    few = 0.5 * F.least(F.col("shared"), F.lit(10)) / 10 + 0.3 * most + 0.2 * F.col("order_score")
    confidence = (
        F.when(F.col("relation") == "exact_file", 1.0).when(F.col("relation") == "exact_content", 0.995)
        .when(F.col("relation") == "contained_version", F.least(0.7 * most + 0.3 * F.col("order_score"), F.lit(0.98)))
        .when(F.col("relation") == "high_overlap", F.least(mean, F.lit(0.94)))
        .when(F.col("relation") == "partial_overlap", F.least(few, F.lit(0.88))).otherwise(0.0)
    )
    return a.withColumn("confidence", confidence)


def merge_evidence(*sources: DataFrame) -> DataFrame:
    """One row per canonical pair from frames (book_a, book_b, kind, amount):
    either order of the sides is one pair, a book paired with itself none."""
    out = None
    for s in sources:
        s = s.filter(F.col("book_a") != F.col("book_b")).select(F.least("book_a", "book_b").alias("book_a"), F.greatest("book_a", "book_b").alias("book_b"), "kind", "amount")
        out = s if out is None else out.unionByName(s)
    k = lambda name: F.col("kind") == name
    return out.groupBy("book_a", "book_b").agg(
        F.bool_or(k("file")).alias("exact_file"), F.bool_or(k("content")).alias("exact_content"),
        F.coalesce(F.max(F.when(k("chapters"), F.col("amount"))), F.lit(0)).alias("shared_chapters"), F.coalesce(F.max(F.when(k("passages"), F.col("amount"))), F.lit(0)).alias("passages"),
    )


def content_quality(prints: DataFrame) -> DataFrame:
    """Per book the distinct informative chapters and characters, and their share
    of all in basis points."""
    informative = F.col("char_count") >= INFORMATIVE_CHARS
    unique = prints.filter(informative).groupBy("book_id", "layout_hash").agg(F.max("char_count").alias("n")).groupBy("book_id").agg(F.count("*").alias("unique_chapters"), F.sum("n").alias("unique_chars"))
    every = prints.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("char_count").alias("chars"))
    return every.join(unique, "book_id", "left").select(
        "book_id", "chapters", F.coalesce("unique_chapters", F.lit(0)).alias("unique_chapters"), F.coalesce("unique_chars", F.lit(0)).alias("unique_chars"),
        F.when(F.col("chars") > 0, F.expr("coalesce(unique_chars, 0) * 10000 div chars")).otherwise(0).alias("unique_chars_bps"),
    )


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """The latest row of each pair of different books whichever way round it was
    stored and however its ids are cased."""
    from .relational import latest_rows

    p = pairs.withColumn("x", F.lower("book_a_id")).withColumn("y", F.lower("book_b_id")).filter(F.col("x") != F.col("y"))
    p = p.withColumn("book_a", F.least("x", "y")).withColumn("book_b", F.greatest("x", "y"))
    return latest_rows(p, ["book_a", "book_b"], [F.desc_nulls_last("updated_at"), F.desc("id")]).drop("x", "y")


def stale_pairs(pairs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Canonical pairs whose evidence is older than a side's latest fingerprint,
    or of which a side has none."""
    at = fingerprints.groupBy(F.lower("book_id").alias("book")).agg(F.max("computed_at").alias("at"))
    p = canonical_pairs(pairs).select("book_a", "book_b", "updated_at")
    j = p.join(at.select(F.col("book").alias("book_a"), F.col("at").alias("at_a")), "book_a", "left").join(at.select(F.col("book").alias("book_b"), F.col("at").alias("at_b")), "book_b", "left")
    return j.withColumn("stale", F.coalesce((F.col("at_a") > F.col("updated_at")) | (F.col("at_b") > F.col("updated_at")), F.lit(False)) | F.col("at_a").isNull() | F.col("at_b").isNull()).select("book_a", "book_b", "stale")


def evaluate(labels: DataFrame, predictions: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """Per class: support, true positives, precision, recall, F1 of
    labels(id, expected) and predictions(id, predicted). Ids on one side only
    raise."""
    j = labels.join(predictions, id_col, "full")
    missing = F.raise_error(F.concat(F.lit("no counterpart for "), F.col(id_col).cast("string")))
    j = j.withColumn("expected", F.when(F.col("expected").isNull() | F.col("predicted").isNull(), missing).otherwise(F.col("expected")))
    hit = (F.col("expected") == F.col("predicted")).cast("int")
    support = j.groupBy(F.col("expected").alias("relation")).agg(F.count("*").alias("support"), F.sum(hit).alias("tp"))
    named = j.groupBy(F.col("predicted").alias("relation")).agg(F.count("*").alias("named"))
    m = support.join(named, "relation", "full").select("relation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "named")])
    p = F.when(F.col("named") > 0, F.col("tp") / F.col("named")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return m.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def evaluation_summary(metrics: DataFrame) -> DataFrame:
    """One row over evaluate()'s: accuracy, and macro-F1 over the classes with support."""
    some = metrics.filter("support > 0")
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("named") + F.col("support"))).otherwise(0.0)
    return some.agg(F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("macro_f1"), F.count("*").alias("classes"))


def minhash_signatures(texts: DataFrame, id_col: str, text_col: str, hashes: int = 128, shingle: int = 5) -> DataFrame:
    """id, signature: the least of `hashes` seeded hashes over the distinct
    character shingles; a text under one shingle is one shingle. Vectorised over
    each Arrow batch."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        rng = np.random.default_rng(97)
        mul, add = rng.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, hashes, dtype=np.uint64)
        from inkloom.functions.normalize import gram_values

        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                h = np.unique(gram_values(t, min(shingle, len(t)))) if t else np.zeros(1, np.uint64)
                h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
                x = h[:, None] * mul + add
                out.append(((x ^ (x >> np.uint64(31))) >> np.uint64(1)).min(axis=0).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "signature"])

    rows = texts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, signature array<bigint>")


def lsh_candidates(signatures: DataFrame, bands: int = 16, rows: int = 8, least: float = 0.85) -> DataFrame:
    """a, b, estimate: texts that agree in a whole band, with the share of equal
    positions, from `least` on. Equal signatures are one class and met once:
    a is the class's smallest id; members of a class are (smallest, other)."""
    cls = signatures.groupBy("signature").agg(F.min("id").alias("a"))
    copies = signatures.join(cls, "signature").filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("estimate"))
    each = cls.select("a", "signature", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))).alias("band", "h"))
    left = each.select("band", "h", "a", F.col("signature").alias("sa"))
    right = each.select("band", "h", F.col("a").alias("b"), F.col("signature").alias("sb"))
    met = left.join(right, ["band", "h"]).filter(F.col("a") < F.col("b")).dropDuplicates(["a", "b"])
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(bands * rows)
    return met.select("a", "b", same.alias("estimate")).filter(F.col("estimate") >= least).union(copies)


def longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one row of the table at a time,
    held in the bits of an integer."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        masks[c] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def diff_ratio(a: list[str] | str, b: list[str] | str) -> float:
    """2 LCS / (n + m) of two sequences."""
    if not a and not b:
        return 1.0
    if not isinstance(a, str):
        code = {w: chr(0x100 + i) for i, w in enumerate(dict.fromkeys([*a, *b]))}
        a, b = "".join(code[w] for w in a), "".join(code[w] for w in b)
    return 2 * longest_common(a, b) / (len(a) + len(b))
