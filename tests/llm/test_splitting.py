import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.kernels import codepoints
from inkloom.llm.splitting import cuts, longest_unbroken, split_oversized

LIMITS = "record_kind string, max_chars int, overlap_chars int"


def pieces(text, most, overlap):
    ends = cuts(codepoints([text])[0], most, overlap)
    starts = [0, *(max(0, e - overlap) for e in ends[:-1])]
    return [text[a:b] for a, b in zip(starts, ends)], ends


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab。. \n🙂字"), min_size=1, max_size=600), st.integers(5, 80), st.integers(0, 4))
def test_round_trip_and_limits(text, most, overlap):
    if len(text) <= most:
        return
    parts, ends = pieces(text, most, overlap)
    assert all(0 < len(p) <= most for p in parts)
    assert parts[0] + "".join(p[min(overlap, e):] for p, e in zip(parts[1:], ends)) == text
    for a, b in zip(parts, parts[1:]):
        k = min(overlap, len(a))
        assert b.startswith(a[len(a) - k :])


def test_prefers_strong_boundaries():
    text = "word " * 30 + "End of it.\n\n" + "word " * 30
    parts, _ = pieces(text, 200, 0)
    assert parts[0].endswith("\n\n")
    assert longest_unbroken(codepoints(["ab cde。f"])[0]) == 3
    assert longest_unbroken(codepoints([""])[0]) == 0


def test_operator(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcd e。\n") for _ in range(60_000))
    rows = [("a", "x" * 25), ("b", "x" * 10 + " " + "y" * 14), ("c", "short"), ("d", None), ("e", ""), (None, "z" * 50), ("a", "x" * 25), ("l", long)]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "id string, content string, text string, max_chars int")
    limits = spark.createDataFrame([("k", 20, 3), ("other", 5, 1)], LIMITS)
    out = {x.record_id: x for x in split_oversized(df, "id", "content", "k", limits).collect()}
    assert set(out) == {"a", "b", "l"} and out["a"].forced == 1 and out["b"].forced == 0
    assert all(len(p.text) <= 20 for x in out.values() for p in x.pieces)
    assert out["l"].pieces[0].text + "".join(p.text[3:] for p in out["l"].pieces[1:]) == long
    assert split_oversized(df, "id", "content", "none", limits).count() == 0
    assert split_oversized(df.limit(0), "id", "content", "k", limits).count() == 0
    with pytest.raises(Exception, match="overlap_chars"):
        split_oversized(df, "id", "content", "k", spark.createDataFrame([("k", 5, 5)], LIMITS)).collect()
