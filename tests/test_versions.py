import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import versions as V


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_evidence():
    m = V.align(list("xbcd"), ["x", "b", "c", "e", "f"], [2, 3, 3, 2], [3, 2, 3, 3, 3])
    assert m["shared"] == 3 and m["longest_run"] == 3 and m["order_score"] == 1.0
    assert m["coverage_a"] == 0.75 and m["char_coverage_a"] == 0.8 and m["coverage_b"] == 0.6 and abs(m["char_coverage_b"] - 8 / 14) < 1e-12


def test_alignment_reordered_repeated_empty():
    m = V.align(list("0123"), list("0213"), [1] * 4, [1] * 4)
    assert (m["shared"], m["order_score"], m["longest_run"]) == (3, 0.75, 1)
    m = V.align(["h"] * 300, ["h"] * 300, [1] * 300, [1] * 300)
    assert (m["shared"], m["longest_run"], m["order_score"]) == (300, 300, 1.0)
    assert V.align([], [], [], [])["shared"] == 0


def test_alignment_is_longest():
    r = random.Random(1)
    for _ in range(60):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(12))] for _ in range(2))
        assert V.align(a, b, [1] * len(a), [1] * len(b))["shared"] == slow_lcs(a, b)


def test_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(80):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(40))) for _ in range(2))
        assert V.longest_common(a, b) == slow_lcs(a, b)
    assert V.diff_ratio("a b c".split(), "a c".split()) == 0.8 and V.diff_ratio([], []) == 1.0


def relation(spark, **kw):
    base = dict(book_a="a", book_b="b", shared=0, coverage_a=0.0, coverage_b=0.0, char_coverage_a=0.0, char_coverage_b=0.0, longest_run=0, order_score=0.0, chapters_a=10, chapters_b=10, chars_a=1000, chars_b=1000, unique_chars_a=0, unique_chars_b=0)
    r = V.classify(spark.createDataFrame([tuple((base | kw).values())], V.ALIGNED)).first()
    return r.relation, r.contained, r.confidence


def test_classification(spark):
    full = dict(char_coverage_a=1.0, coverage_a=1.0, order_score=1.0, longest_run=10)
    assert relation(spark, shared=10, chapters_b=12, coverage_b=10 / 12, char_coverage_b=0.8, chars_b=1200, unique_chars_b=200, **full)[:2] == ("contained_version", "a")
    assert relation(spark, shared=4, chapters_a=5, chapters_b=4, coverage_a=0.8, char_coverage_a=0.8, coverage_b=1.0, char_coverage_b=1.0, order_score=1.0, chars_a=1200, chars_b=900, unique_chars_a=300)[:2] == ("contained_version", "b")
    assert relation(spark, shared=10, chapters_a=15, chapters_b=15, coverage_a=2 / 3, coverage_b=2 / 3, char_coverage_a=0.66, char_coverage_b=0.66, order_score=1.0, longest_run=10)[0] == "high_overlap"
    assert relation(spark, shared=10, chapters_a=1000, chapters_b=1000, coverage_a=0.01, coverage_b=0.01, char_coverage_a=0.01, char_coverage_b=0.01, order_score=1.0)[0] == "partial_overlap"
    assert relation(spark)[0] == "not_duplicate"


def books(spark, spec):
    rows = [(b, k, f"{b}{k}", t) for b, texts in spec.items() for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "book_id string, chapter_index int, id string, content string")


def test_containment_end_to_end(spark):
    text = lambda k: f"Chapter text number {k}. " * 12
    c = books(spark, {"short": [text(k) for k in range(10)], "long": [text(k) for k in range(15)], "other": [text(k) for k in range(50, 60)], "none": [None, ""]})
    prints = V.chapter_fingerprints(c)
    items = prints.filter(F.col("char_count") >= V.INFORMATIVE_CHARS).select("book_id", F.col("layout_hash").alias("hash"))
    out = V.classify(V.align_pairs(V.shared_hash_candidates(items, 2), prints)).collect()
    assert [(r.book_a, r.book_b, r.relation, r.contained) for r in out] == [("long", "short", "contained_version", "b")]


def test_book_fingerprint_ignores_chapter_limits(spark):
    c = books(spark, {"one": ["ab cd"], "two": ["ab", "cd"], "spaced": ["a b\n", " c d"]})
    out = {r.book_id: r for r in V.book_fingerprints(c).collect()}
    assert len({out[b].layout_hash for b in out}) == 1 and out["one"].conservative_hash != out["two"].conservative_hash
    assert out["one"].source_content_hash != out["two"].source_content_hash and out["one"].char_count == 4


def test_frequency_limit_and_contributions(spark):
    items = spark.createDataFrame([(f"b{i:03d}", "boiler") for i in range(51)] + [("b000", "x"), ("b001", "x"), ("b001", "x"), ("b002", None)], "book_id string, hash string")
    assert [tuple(r) for r in V.shared_hash_candidates(items, 1).collect()] == [("b000", "b001", 1)]
    assert [tuple(r) for r in V.pair_contributions(items).collect()] == [(2, 1, 1)]
    changed = spark.createDataFrame([("b001",)], "book_id string")
    assert V.shared_hash_candidates(items, 1, changed=changed).count() == 1
    assert V.shared_hash_candidates(items, 1, changed=changed.limit(0)).count() == 0


def test_evaluate_and_missing(spark):
    lab = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "pair_id string, expected string")
    pred = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "y")], "pair_id string, predicted string")
    out = {r.relation: (r.precision, r.recall) for r in V.evaluate(lab, pred).collect()}
    assert out == {"x": (1.0, 0.5), "y": (0.5, 1.0)}
    with pytest.raises(Exception, match="no counterpart"):
        V.evaluate(lab, pred.filter("pair_id < '3'")).collect()


def test_minhash_finds_copies_and_edits(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdefghij ") for _ in range(600))
    rows = [(1, base), (2, base), (3, base[:590] + "zzzz"), (4, "".join(r.choice("klmnop ") for _ in range(600))), (5, "ab"), (6, None), (7, "")]
    sig = V.minhash_signatures(spark.createDataFrame(rows, "id long, text string"), "id", "text").cache()
    got = {(r.a, r.b) for r in V.lsh_candidates(sig).collect()}
    assert {(1, 2), (1, 3)} <= got and all({a, b} <= {1, 2, 3} or {a, b} == {6, 7} for a, b in got)
    assert not set(itertools.product((4,), range(9))) & got
