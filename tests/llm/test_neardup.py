import math
import random
from collections import Counter

from inkloom.llm.kernels import WHITE_SPACE
from inkloom.llm.neardup import near_duplicate_pairs
from inkloom.llm.spans import expand_pairs

SPACES = {chr(c) for c in WHITE_SPACE}
WORDS = [f"{a}{b}" for a in ("lan", "mer", "tol", "via", "qua", "hin", "sor") for b in ("tern", "chant", "ling", "dow", "rel", "mist", "bright", "gate")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(n))


def shingles(t):
    u = "".join(c for c in t or "" if c not in SPACES)
    return {u[p : p + 5] for p in range(len(u) - 4)} if len(u) >= 120 else None


def brute(rows, least=0.8):
    s = {i: x for i, t in rows if i is not None and (x := shingles(t))}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= least * len(s[a] | s[b])}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "id string, content string, d string, n int")
    pairs, members = near_duplicate_pairs(df, **kw)
    return {tuple(r) for r in expand_pairs(pairs, members, "a", "b").collect()}


def edited(t, k, seed):
    r, w = random.Random(seed), t.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_against_brute_force(spark):
    rows = []
    for k in range(12):
        base = prose(60 + 10 * k, k)
        rows += [(f"{k:02d}a", base), (f"{k:02d}b", edited(base, 1 + k // 3, k)), (f"{k:02d}c", base + " " + prose(6, 100 + k)), (f"{k:02d}d", prose(60, 200 + k))]
    rows += [("same", prose(80, 1).replace(" ", " \n")), ("same", prose(80, 1).replace(" ", " \n")), ("tab", prose(80, 1).replace(" ", "\t　")), ("null", None), (None, prose(60, 0)), ("empty", ""), ("blank", " \n" * 200), ("short", "a" * 119)]
    assert found(spark, rows, measure="plain") == brute(rows)


def test_common_text_with_rare_edits(spark):
    """Texts that share a common body are alike as sets, though far less by weight."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda n, seed: "".join(random.Random(seed).choices(letters, k=n))
    body = own(1000, 1)
    rows = [(f"{k:02d}", body[:600] + own(95, 50 + k) + body[600:]) for k in range(60)]
    true = brute(rows)
    got = found(spark, rows, measure="plain")
    assert len(true) == 60 * 59 // 2 and got <= true and len(got) >= 0.98 * len(true)


def test_long_text_and_repeats(spark):
    long = prose(20_000, 5)
    rows = [("a", long), ("b", edited(long, 40, 1)), ("c", "x" * 50_000), ("d", "x" * 40_000)]
    assert found(spark, rows, measure="plain") == {("a", "b"), ("c", "d")}


def test_weighted_measure_and_empty(spark):
    base = prose(100, 3)
    assert found(spark, [("a", base), ("b", edited(base, 1, 2)), ("c", prose(100, 9))]) == {("a", "b")}
    assert found(spark, []) == set()


def test_weighted_by_true_frequencies(spark):
    """The similarity is that of exact counts, not of the hashed table."""
    bases = [prose(60, 700 + k) for k in range(30)]
    rows = [(f"{k:02d}a", b) for k, b in enumerate(bases)] + [(f"{k:02d}b", edited(b, 1 + k % 4, k)) for k, b in enumerate(bases)] + [("00a", bases[0])]
    bag = [Counter(u[p : p + 5] for p in range(len(u) - 4)) for _, t in rows if (u := "".join(c for c in t if c not in SPACES))]
    df = Counter(x for b in bag for x in b)

    def weighted(i, j):
        w = [{x: max(1.0, math.log((len(rows) + 1) / (df[x] + 1)) + 1) * (1 + math.log(n)) for x, n in bag[q].items()} for q in (i, j)]
        low = sum(min(v, w[1][x]) for x, v in w[0].items() if x in w[1])
        return low / (sum(w[0].values()) + sum(w[1].values()) - low)

    true = {(f"{k:02d}a", f"{k:02d}b"): weighted(k, 30 + k) for k in range(30)}
    pairs, members = near_duplicate_pairs(spark.createDataFrame(rows, "id string, content string"), similarity=0.6)
    of = {r.d: r.id for r in members.collect()}
    got = {tuple(sorted((of[r.d1], of[r.d2]))): r.weighted_jaccard for r in pairs.collect()}
    assert len(got) > 5 and all(abs(true[p] - w) < 1e-9 for p, w in got.items())
    assert {p for p, w in true.items() if w >= 0.75} <= set(got)
