import itertools
import random

import pytest

from inkloom.llm import kernels as K
from inkloom.llm import meeting, spans
from inkloom.llm.spans import expand_pairs, repeated_lines, shared_coverage, shared_span_pairs

SCHEMA = "id string, content string, d string, h long, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "clash") for i, t in rows], SCHEMA)


def text(n, seed, alphabet="abcdefghijklmnopqrstuvwxyz     。，天地玄黄宇宙洪荒"):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(n))


def found(spark, rows, n=200):
    pairs, members = shared_span_pairs(frame(spark, rows), min_length=n)
    return {tuple(r) for r in expand_pairs(pairs, members, "a", "b").collect()}


def brute(rows, n=200):
    grams = {}
    for i, t in rows:
        if i is not None and t:
            for p in range(len(t) - n + 1):
                grams.setdefault(t[p : p + n], set()).add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def brute_spans(rows, n=200):
    grams = {}
    for i, t in rows:
        for p in range(len(t or "") - n + 1):
            grams.setdefault(t[p : p + n], set()).add(i)
    out = {}
    for i, t in dict(rows).items():
        spans = []
        for p in range(len(t or "") - n + 1):
            if len(grams[t[p : p + n]]) > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], p + n)
                else:
                    spans.append((p, p + n))
        if spans:
            out[i] = spans
    return out


def test_against_brute_force(spark):
    quote = text(200, 1)
    rows = [
        ("a", text(300, 2) + quote + text(50, 3)), ("b", quote + text(100, 4)), ("c", text(77, 5) + quote), ("short", quote[:199] + text(150, 6)),
        ("copy1", text(400, 7)), ("copy2", text(400, 7)), ("copy2", text(400, 7)), ("tiny", "x"), ("empty", ""), ("null", None), (None, quote), ("emoji", "🙂" * 250), ("emoji2", "a" + "🙂" * 200),
        ("long", text(60_000, 8) + quote[:150] + text(3000, 7)[:400] + text(2000, 9)),
    ]
    assert found(spark, rows) == brute(rows)
    assert ("a", "b") in found(spark, rows) and not any("short" in p for p in found(spark, rows))


def test_unit_of_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_UNIT", 5)
    notice, long = text(150, 21), text(230, 22)
    rows = [(f"n{k:02d}", text(60, 100 + k) + notice + text(80, 200 + k)) for k in range(30)] + [(f"l{k:02d}", text(k, 300 + k) + long + text(9, 400 + k)) for k in range(12)]
    rows += [("m1", text(70, 5) + notice + text(90, 6)), ("m2", text(40, 5)[10:] + text(70, 5)[-30:] + notice + text(90, 6))]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) >= 66


def test_every_place_of_a_hot_unit(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_UNIT", 5)
    # a refrain of so small a hash that it is the unit of every window that holds it
    refrain = next(t for k in itertools.count() if K.gram_hashes(K.codepoints([t := text(80, k)])[0], 80)[0] < 1 << 52)
    # m1 and m2 are 40 verses with it, of which only two in the middle are the same
    verse = lambda k, v: text(20, f"{'both' if v in (19, 20) else k} {v}") + refrain
    rows = [(f"m{k}", "".join(verse(k, v) for v in range(40))) for k in (1, 2)]
    rows += [(f"n{k:02d}", text(200, f"{k}e") + refrain + text(200, f"{k}f")) for k in range(20)]
    assert found(spark, rows) == brute(rows) == {("m1", "m2")}
    assert found(spark, rows[:2] * 5 + rows) == {("m1", "m2")}


@pytest.mark.parametrize("hot", [5, 64, 10**9])
def test_notice_several_times_in_each_text(spark, monkeypatch, hot):
    """The result doesn't depend on when a unit counts as one of very many texts."""
    monkeypatch.setattr(spans, "HOT_UNIT", hot)
    notice, rows = text(150, 31), []
    for k in range(45):  # both of a pair hold 210 equal characters around the second notice only
        around = text(30, f"l{k}") + notice + text(30, f"r{k}")
        for side in "ab":
            own = lambda v: text(90, f"{k}{side}{v}")  # noqa: E731,B023
            rows.append((f"{k:02d}{side}", own(1) + notice + own(2) + around + own(3) + notice + own(4)))
    rows += [("again", rows[0][1]), ("again", rows[0][1])]
    true = brute(rows)
    assert len(true) >= 45 and found(spark, rows) == true
    out = {r.record_id: [(s.start, s.end) for s in r.spans] for r in shared_coverage(frame(spark, rows)).collect()}
    assert out == brute_spans(rows)


def test_lines_link_whatever_the_places(spark):
    line = text(205, 41)
    rows = [("a", line), ("b", text(30, 42) + "\n" + line + "\n" + line), ("c", line[:199] + "\n" + text(300, 43)), ("d", None), ("e", "\n" * 400), ("f", "\n" * 300)]
    assert found(spark, rows) == brute(rows) == {("a", "b"), ("e", "f")}
    pairs, members = shared_span_pairs(frame(spark, rows))
    assert pairs.filter("by_line").count() == 1


def test_postings_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(meeting, "BLOCK", 3)
    rows = [(h, f"{h}{k:02d}".encode()) for h, n in ((1, 1), (2, 2), (3, 3), (4, 11)) for k in range(n)]
    met = meeting.meet(meeting.counted(meeting.in_several(spark.createDataFrame(rows + rows[-1:], "h long, d binary")).distinct()))
    got = sorted((bytes(r.d1), bytes(r.d2)) for r in met.collect())
    assert got == sorted((a, b) for h, a in rows for g, b in rows if h == g and a < b)


def test_random_texts_of_few_letters(spark):
    rows = [(f"r{k:02d}", text(400, k % 7, "ab") + text(random.Random(k).randrange(200), k)) for k in range(24)]
    assert found(spark, rows, 90) == brute(rows, 90)


def test_empty_table(spark):
    assert found(spark, []) == set()
    assert shared_coverage(frame(spark, [])).count() == 0


def test_coverage_merges_stretches(spark):
    q1, q2 = text(250, 11), text(220, 12)
    rows = [("a", q1 + text(100, 13) + q2), ("b", text(40, 14) + q1 + text(10, 15)), ("c", q1[30:] + "!" + q2), ("whole", text(210, 16)), ("whole2", text(210, 16))]
    out = {r.record_id: r for r in shared_coverage(frame(spark, rows)).collect()}
    assert [(s.start, s.end) for s in out["a"].spans] == [(0, 250), (350, 570)]
    assert out["a"].shared_chars == 470 and abs(out["a"].coverage - 470 / 570) < 1e-9
    assert out["whole"].coverage == 1.0 and out["whole"].copies == 2


def test_repeated_lines_keep_the_first(spark):
    line = "A line that is long enough to count among the units of this text, if only just, more or less."
    rows = [("b", f"x\n{line}\n{line}"), ("a", f"  {line.replace(' ', '  ')}\nshort"), ("c", None), ("a", f"  {line.replace(' ', '  ')}\nshort"), (None, line), ("d", "")]
    out = sorted(tuple(r) for r in repeated_lines(frame(spark, rows)).collect())
    n = len(line)
    assert out == [("b", 2, 2 + n, "a", 0), ("b", 3 + n, 3 + 2 * n, "a", 0)]
    assert repeated_lines(frame(spark, [])).count() == 0
