import pytest
from pyspark.sql import functions as F

from inkloom.operators import graph as G
from inkloom.operators import retrieval as Y
from inkloom.operators import shelves as H


def test_candidates_to_fetch():
    assert [Y.wide_k(q, 20) for q in ("well", "who rang the bell?", "one two three four five", '"the old bell" rang', "the bell rang")] == [30, 40, 40, 20, 24]
    assert Y.wide_k("x", 1) == 5 and Y.wide_k("x", 100) == 100


def test_search_modes(spark):
    docs = spark.createDataFrame([(1, "The Bell", "a bell rang"), (2, "Fog", "only fog"), (3, None, None)], "doc_id long, title string, text string")
    items = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    ids = lambda *a, **k: [r.id for r in Y.searched(docs, items, *a, **k).orderBy(F.desc("rrf"), "id").collect()]
    assert ids("bell", None, "keyword") == [1]
    assert ids("bell", [1.0, 0.0], "semantic") == [2, 1]
    assert ids("bell", [1.0, 0.0]) == [1, 2]
    assert ids("the b", None) == [1] and ids("", None) == []
    with pytest.raises(ValueError):
        Y.searched(docs, items, "x", None, "other")


def test_paths_are_ranked(spark):
    """A direct path by a strong relation comes before one of two steps by weak ones."""
    e = spark.createDataFrame([("a", "b", "敌对"), ("a", "c", "相关"), ("c", "b", "related"), ("b", "a", "friend")], "source string, target string, relation string")
    found = Y.paths(e, spark.createDataFrame([("a",)], "node string"), 3)
    got = [(r.path, r.score) for r in Y.ranked_paths(found, ["a", "b"]).collect()]
    assert got == [("a>b", 0.775), ("a>c>b", 0.5875), ("a>c", 0.4625)]


def test_smart_shelf_rules(spark):
    b = spark.createDataFrame([("1", "The Bell", "en", 5), ("2", None, None, None), ("3", "Fog", "zh", 50)], "id string, title string, language string, word_count int").withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    ids = lambda *rules: [r.id for r in H.smart_shelf(b, list(rules)).collect()]
    assert ids(("language", "eq", "en")) == ["1"] and ids(("language", "neq", "en")) == ["2", "3"]
    assert ids(("title", "not_contains", "bell")) == ["2", "3"] and ids(("word_count", "lt", 50), ("language", "in", ["en", "zh"])) == ["1"]
    assert ids(("updated_at", "after", "2024-01-01"), ("language", "not_in", ["zh"])) == ["1", "2"]
    with pytest.raises(KeyError):
        ids(("title", "like", "x"))


def test_scopes_with_grants(spark):
    f = lambda rows, cols: spark.createDataFrame(rows, cols)
    out = H.visible_scopes(f([("u",), ("v",)], "user string"), f([("u", "s1")], "user string, scope string"), f([("g", "s2")], "group string, scope string"), f([("v", "g")], "user string, group string"), f([("s1",), ("s2",), ("s3",)], "scope string"))
    assert {tuple(r) for r in out.collect()} == {("u", "s1"), ("v", "s2"), ("u", "s3"), ("v", "s3")}


def test_distances_on_a_circle(spark):
    e = spark.createDataFrame([(k, (k + 1) % 8, 1) for k in range(8)], "source int, target int, weight int")
    got = {(r.start, r.node): r.distance for r in G.hop_distances(e, spark.createDataFrame([(0,), (3,)], "node int"), 3).collect()}
    assert got == {(s, n): d for s in (0, 3) for n in range(8) if (d := min((n - s) % 8, (s - n) % 8)) <= 3}
