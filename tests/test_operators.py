import math

from pyspark.sql import functions as F

from inkloom.functions import text as T
from inkloom.operators import graph as G
from inkloom.operators import reading as R
from inkloom.operators import relational as L
from inkloom.operators import search as S
from inkloom.operators import vectors as X


def test_streak_allows_single_gaps(spark):
    days = {"u": ["2025-06-30", "2025-06-28", "2025-06-27", "2025-06-24"], "late": ["2025-06-28"], "future": ["2025-07-02"], "yesterday": ["2025-06-29", "2025-06-27"]}
    s = spark.createDataFrame([(u, d) for u, ds in days.items() for d in ds], "user_id string, day string").select("user_id", F.to_timestamp("day").alias("started_at"))
    assert {r.user_id: r.streak for r in R.current_streak(s, "2025-06-30").collect()} == {"u": 3, "late": 0, "yesterday": 2}


def test_intervals_merge(spark):
    s = spark.createDataFrame([("u", 0, 100), ("u", 50, 150), ("u", 150, 160), ("u", 300, 310), ("u", 305, 306), ("v", 9, 5), (None, 0, 9), ("v", 0, None)], "user_id string, a long, b long").select("user_id", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("b").alias("ended_at"))
    assert [tuple(r) for r in R.union_seconds(s).collect()] == [("u", 170, 2)]


def test_peaks(spark):
    d = spark.createDataFrame(list(enumerate([1, 3, 2, 2, 5, 1])), "day int, v int")
    out = [(r.is_peak, r.is_valley) for r in R.peaks_and_valleys(d, "day", "v").orderBy("day").collect()]
    assert out == [(False, False), (True, False), (False, False), (False, False), (True, False), (False, False)]


def test_upsert_scope_and_bridge(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", None)], "id int, v string, at int")
    assert sorted(tuple(r)[:2] for r in L.upsert(old, new, ["id"], F.col("at")).select("id", "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    assert L.scoped(old, None, "id").count() == 2 and L.scoped(old, new.limit(0), "id").count() == 0
    assert L.get_or_create(old, new, ["id"]).count() == 3
    assert L.page(old, [F.asc("id")], 2, 1).collect()[0].id == 2
    assert old.filter(L.contains_text("%", "v")).count() == 0 and old.filter(L.contains_text("  ", "v")).count() == 2


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([], []), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_top_k_and_clusters(spark):
    v = [(i, [math.cos(i * 0.01 + (i // 10)), math.sin(i * 0.01 + (i // 10))]) for i in range(30)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    q = e.filter("vec_id = 5").select(F.col("vec_id").alias("query_id"), "embedding")
    out = X.top_k(e, q, 2).orderBy("rank").collect()
    assert {r.vec_id for r in out} == {4, 6} and out[0].vec_id == 4
    c = {}
    for r in X.kmeans_cosine(e, 3).collect():
        c.setdefault(r.cluster, set()).add(r.vec_id // 10)
    assert sorted(map(tuple, c.values())) == [(0,), (1,), (2,)]
    assert X.kmeans_cosine(e.limit(0), 3).count() == 0


def test_groups_of_all_vectors(spark, tmp_path):
    """Every vector looks for its two nearest, and only likeness ties."""
    import random

    from inkloom.plans.queries_versions import vector_groups

    r = random.Random(3)
    near = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    v = {i: [r.gauss(0, 1) for _ in range(4)] for i in range(1, 62)} | {90: [0.0] * 4}
    best = {i: sorted((-round(near(v[i], v[j]), 9), j) for j in v if j != i and j != 90)[:2] for i in v if i != 90}
    out = {}
    for q in X.nearest_of_all(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>"), 2, rows=16).collect():
        out.setdefault(q.query_id, set()).add(q.vec_id)
    assert out == {i: {j for _, j in b} for i, b in best.items()}
    spark.createDataFrame(list(v.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    of = {i: i for i in v}
    for _ in v:
        for i, b in best.items():
            for s, j in b:
                if -s >= 0.6:
                    of[i] = of[j] = min(of[i], of[j])
    tied = {x for i, b in best.items() for s, j in b if -s >= 0.6 for x in (i, j)}
    assert {q.node: q.component for q in vector_groups(spark, str(tmp_path)).collect()} == {i: of[i] for i in tied}


def test_profile_of_all_vectors_of_a_label(spark, tmp_path):
    from inkloom.plans.queries_versions import profile_recommendations

    v = [(10, [1.0, 0.0], 1), (11, [0.0, 9.0], 1), (20, [0.0, 1.0], 2), (21, [1.0, 0.0], 2)]
    spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {(r.user, r["rank"]): r.vec_id for r in profile_recommendations(spark, str(tmp_path)).collect()}
    assert out == {(1, 1): 20, (1, 2): 21, (2, 1): 11, (2, 2): 10}


def test_rrf(spark):
    lists = spark.createDataFrame([("k", "x", 3.0), ("k", "y", 2.0), ("s", "y", 0.9)], "source string, key string, score double")
    out = {r.key: r for r in X.rrf(lists, "key").collect()}
    assert abs(out["y"].rrf - (1 / 62 + 1 / 61)) < 1e-12 and out["y"].sources == "k,s" and out["x"].best_score == 3.0
    assert X.rrf(lists.limit(0), "key").count() == 0


def test_bm25_and_snippets(spark):
    d = spark.createDataFrame([(1, "The Harbour bell. harbour light"), (2, "a bell far away from any harbour in the long long night"), (3, "nothing"), (4, None), (5, "雨夜 harbour")], "id long, text string")
    best = S.bm25(d, "id", "text", "harbour").orderBy(F.desc("score")).collect()
    assert [r.id for r in best] == [1, 5, 2]
    assert S.bm25(d, "id", "text", " !? ").count() == 0 and S.bm25(d, "id", "text", "雨").collect()[0].id == 5
    assert "Harbour" in S.keyword_page(d, "id", "text", "harbour bell").filter("id = 1").first().snippet
    spans = d.filter("id = 1").select(S.highlight_spans("text", ["harbour"]).alias("s")).first().s
    assert [(x.start, x.end) for x in spans] == [(4, 11), (18, 25)]
    h = S.hybrid(S.bm25(d, "id", "text", "bell"), d.select("id", F.lit(0.5).alias("score")))
    assert h.orderBy(F.desc("rrf")).first().sources == "keyword,semantic"


def test_best_sentence(spark):
    df = spark.createDataFrame([(["The bell rang.", "The bell and the lantern.", "Nothing."],)], "s array<string>")
    assert df.select(S.best_sentence(F.col("s"), ["bell", "lantern"]).alias("b")).first().b.sentence == "The bell and the lantern."


def test_graph(spark):
    tri = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")]
    e = spark.createDataFrame([("g", x, y, 1.0) for x, y in tri] + [("g", "c", "d", 0.5)], "book string, source string, target string, weight double")
    m = G.communities(e, "book")
    of = {r.node: r.community for r in m.collect()}
    assert of["a"] == of["b"] == of["c"] != of["d"] == of["e"] == of["f"]
    assert G.modularity(e, m).first().modularity > 0.3
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in G.hop_distances(e, start, 5).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 3}
    tree = spark.createDataFrame([("r", "x"), ("x", "y"), ("y", "x")], "parent string, child string")
    assert [r.path for r in G.tree_levels(tree, start.select(F.lit("r").alias("node"))).orderBy("level").collect()] == ["r", "r/x", "r/x/y"]
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 0.25)], "n int, c double, w double").select(G.path_score("n", "c", "w").alias("s")).collect()
    assert abs(p[0].s - 0.775) < 1e-12 and abs(p[1].s - 0.5875) < 1e-12


def test_paths_between_all_nodes(spark, tmp_path):
    from inkloom.plans.queries_books import bounded_paths_all

    m = [(f"b{k}", f" N{k + j} ") for k in range(8) for j in (0, 1)] + [("c", "x"), ("c", "Y"), (None, "z"), ("d", "alone"), ("d", " ")]
    spark.createDataFrame(m, "book_id string, name string").write.parquet(f"{tmp_path}/entities.parquet")
    out = sorted(tuple(r) for r in bounded_paths_all(spark, str(tmp_path)).collect())
    chain = [(f"n{i}", f"n{j}", abs(i - j)) for i in range(9) for j in range(9) if abs(i - j) <= 5]
    assert out == sorted(chain + [("x", "x", 0), ("y", "y", 0), ("x", "y", 1), ("y", "x", 1)])


def test_paths_between_all_nodes_write_no_pairs(spark, monkeypatch):
    """The same distances however many mentions are held, and by classes nothing written per pair."""
    import random

    from inkloom.plans.durable import Scratch

    r = random.Random(5)
    rows = [(f"p{k}", f"n{r.randrange(60):02d}") for k in range(40) for _ in range(r.choice((1, 2, 4)))] + [("many", f"m{k:03d}") for k in range(300)] + [("p0", "m000"), (None, "n00"), ("p1", None)]
    m = spark.createDataFrame(rows, "place string, node string")
    at = {}
    for p, n in rows:
        if p and n:
            at.setdefault(p, set()).add(n)
    near = {n: {x for s in at.values() if n in s for x in s} for s in at.values() for n in s}
    want = []
    for n in near:
        level, seen = {n}, {n: 0}
        for h in range(1, 4):
            level = {x for y in level for x in near[y]} - set(seen)
            seen |= dict.fromkeys(level, h)
        want += [(n, x, h) for x, h in seen.items() if len(near[n]) > 1]
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(keep(self, df)) or written[-1])
    got = [tuple(x) for x in G.met_distances(m, "place", "node", 3).collect()]
    assert sorted(got) == sorted(want) and sum(w.count() for w in written) < 2_000 < 90_000 < len(got)
    assert sorted(tuple(x) for x in G.met_distances(m, "place", "node", 3, held=10).collect()) == sorted(want)
    assert G.met_distances(m.limit(0), "place", "node").count() == 0


def test_paths_between_all_nodes_take_few_bytes(spark, tmp_path, monkeypatch):
    """Nearly all pairs are written in few bytes each, in the same rows at any division into tasks."""
    import random
    from pathlib import Path

    r = random.Random(8)
    m = spark.createDataFrame([(f"p{k}", f"name of {r.randrange(900):04d}") for k in range(400) for _ in range(4)], "place string, node string")
    G.met_distances(m, "place", "node").coalesce(1).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    rows, written = out.count(), sum(x.stat().st_size for x in Path(tmp_path, "out").glob("*.parquet"))
    assert rows > 250_000 and written < 0.9 * rows
    for k, v in (("STARTS_AT_ONCE", 70), ("NAMES_AT_ONCE", 5_000), ("NODES_AT_ONCE", 9)):
        monkeypatch.setattr(G, k, v)
    again = G.met_distances(m, "place", "node")
    assert again.rdd.getNumPartitions() > 30 and again.count() == rows and again.exceptAll(out).isEmpty()


def test_text_functions(spark):
    noisy = "正文。\n本文首发于笔趣阁，请支持正版\nsee http://x.y/z end\n\n\n\n\n\nlast\x07 line  "
    df = spark.createDataFrame([(noisy,), ("",), (None,)], "t string")
    out = df.select(T.clean_text("t").alias("c"), T.noise_score("t").alias("n"), T.language_profile("t").alias("l")).collect()
    assert "笔趣阁" not in out[0].c and "http" not in out[0].c and out[0].c.endswith("last line") and "\n\n\n\n" not in out[0].c
    assert 0 < out[0].n < 1 and out[1].n == 0.0 and out[1].c == "" and out[2].c is None
    langs = spark.createDataFrame([("雨夜里的灯",), ("雨の夜のランプ",), ("비 오는 밤",), ("a rainy night",)], "t string").select(T.language_profile("t")).collect()
    assert [r[0] for r in langs] == ["chinese", "japanese", "korean", "english"]
    sim = spark.createDataFrame([("Jon Snow", "John Snow"), ("", "x"), ("ab", "cd")], "a string, b string").select(T.name_similarity("a", "b")).collect()
    assert abs(sim[0][0] - 8 / 9) < 1e-9 and sim[1][0] == sim[2][0] == 0.0


def test_splitters():
    text = "序" * 120 + "\n第一章 雨\n内容一。\n第二章 风\n内容二。"
    c = T.chapter_list(text)
    assert [x[0] for x in c] == ["preface", "第一章 雨", "第二章 风"] and "".join(text[a:b] for _, a, b in c) == text
    plain = ("word " * 200 + "\n\n") * 12
    parts = T.chapter_list(plain)
    assert len(parts) > 1 and "".join(plain[a:b] for _, a, b in parts) == plain and max(b - a for _, a, b in parts) <= 5120
    assert T.chapter_list("") == [] and T.chapter_list("short")[0][0] == "whole text"
    chunks = T.chunk_list("This is a sentence of some length. " * 60)
    assert all(len(x[1]) <= 640 for x in chunks) and len(chunks) > 2
    assert T.sentence_list("你好。“走吧！”他说。\nYes. No?") == ["你好。", "“走吧！”", "他说。", "Yes.", "No?"]
