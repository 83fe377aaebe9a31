from inkloom.llm import mixing
from inkloom.llm.mixing import mix_sources

TARGETS = "source string, target_share double, max_repeats int"


def run(spark, docs, targets):
    sizes = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, source string, n_tokens long, key string, copies int")
    mix, report = mix_sources(sizes, spark.createDataFrame(targets, TARGETS))
    return [tuple(r) for r in mix.select("doc_id", "source", "copies", "n_tokens").collect()], {r.source: r for r in report.collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "big", 10) for i in range(2000)] + [(10_000 + i, "small", 10) for i in range(100)] + [(20_000 + i, "other", 7) for i in range(50)] + [(30_000, "unlisted", 5), (30_001, None, 5), (30_002, "big", 0), (30_003, "big", None), (0, "big", 10)]
    mix, rep = run(spark, docs, [("big", 0.6, 1), ("small", 0.3, 4), ("empty", 0.1, 2), (None, 0.1, 1)])
    assert rep["empty"].tokens == 0 and rep["empty"].actual_share == 0
    assert rep["small"].tokens == 4000 and {c for _, s, c, _ in mix if s == "small"} == {4}
    assert rep["big"].tokens == 8000 and {c for _, s, c, _ in mix if s == "big"} == {1}
    assert abs(rep["big"].actual_share - 2 / 3) < 1e-9 and len({i for i, *_ in mix}) == len(mix)
    assert all(s in ("big", "small") for _, s, *_ in mix)


def test_partial_round_is_nearest(spark):
    docs = [(i, "a", 100 + i % 7) for i in range(300)] + [(1000 + i, "b", 31) for i in range(100)]
    mix, rep = run(spark, docs, [("a", 0.5, 3), ("b", 0.5, 5)])
    assert rep["b"].tokens == 5 * 3100
    assert abs(rep["a"].tokens - 15_500) <= 53 and rep["a"].most_copies == 1


def test_nothing_to_mix(spark):
    mix, rep = run(spark, [], [("a", 1.0, 1)])
    assert mix == [] and rep["a"].tokens == 0
    mix, rep = run(spark, [(1, "a", 5)], [])
    assert mix == [] and rep == {}
    mix, _ = run(spark, [(1, "a", 5)], [("a", None, 1), ("b", 0.5, 0)])
    assert mix == []


def test_ranges_are_refined(spark, monkeypatch):
    """However small the ranges are made, the cut is the same."""
    docs = [(i, "a", 3 + i % 5) for i in range(400)] + [(1000 + i, "b", 11) for i in range(300)]
    targets = [("a", 0.4, 1), ("b", 0.6, 1)]
    whole = run(spark, docs, targets)
    monkeypatch.setattr(mixing, "SORTED", 0)
    assert sorted(run(spark, docs, targets)[0]) == sorted(whole[0])
