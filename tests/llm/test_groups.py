import random

from pyspark.sql import functions as F

from inkloom.llm.components import connected_components
from inkloom.llm.survivors import Field, current_rows, descending, survivorship


def components(spark, edges, kind="string"):
    df = spark.createDataFrame([(a, b, "clash", "clash") for a, b in edges], f"a {kind}, b {kind}, u string, v string")
    return {r.node: r.component for r in connected_components(df, "a", "b").collect()}


def slow(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_random_graphs_chains_and_stars(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(60):03d}", f"n{r.randrange(60):03d}") for _ in range(35)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"s{i}") for i in range(200)]
    edges += [("x", "x"), (None, "x"), ("y", None), ("s1", "hub"), ("s1", "hub")]
    assert components(spark, edges) == slow(edges)


def test_numbers_and_no_edges(spark):
    assert components(spark, [(3, 1), (3, 2), (9, 8)], "long") == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert components(spark, []) == {}
    assert components(spark, [("a", "a"), (None, None)]) == {}


def test_survivorship_by_field(spark):
    rows = [("g", "a", 10, None, " "), ("g", "b", 10, "unknown", "Ann"), ("g", "c", None, "english", "Bob"), ("h", "z", None, None, None), (None, "q", 1, "english", "Q"), ("g", "b", 10, "unknown", "Ann")]
    df = spark.createDataFrame(rows, "g string, id string, words int, lang string, author string").withColumn("k0", F.lit(1)).withColumn("value", F.lit(2))
    fields = [Field("best", F.col("id"), F.lit(True)), Field("who", F.col("author"), F.trim("author") != ""), Field("lang", F.col("lang"), F.col("lang") != "unknown")]
    out = {r.g: tuple(r)[1:] for r in survivorship(df, "g", [descending(F.col("words")), F.col("id")], fields).collect()}
    assert out == {"g": ("a", "Ann", "english"), "h": ("z", None, None)}
    assert survivorship(df.limit(0), "g", [F.col("id")], fields).count() == 0


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w"), (None, 9, "n")], "id string, at int, v string")
    assert {tuple(r) for r in current_rows(df, "id", "at").select("id", "at", "v").collect()} == {("a", 3, "y"), ("b", None, "w")}


def test_groups_of_pairs_on_the_test_tables(spark):
    from tests.oracle import connect, rows_of, sql_rows

    from inkloom.llm import queries as q

    d = "/root/testdata/sf0.001"
    con = connect(d)
    for name, sql in q.oracle_sql().items():
        assert rows_of(q.queries()[name](spark, d)) == sql_rows(con, sql), name
