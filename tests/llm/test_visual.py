import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.visual import canonical_text, lookalike_pairs, tables

SCHEMA = "id string, content string, stored string, canonical int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def canon(spark, texts):
    out = {r.record_id: r.canonical for r in canonical_text(frame(spark, [(str(k), t) for k, t in enumerate(texts)])).collect()}
    return [out[str(k)] for k in range(len(texts))]


def test_same_look(spark):
    same = [
        ("Ｔｈｅ ｗｅｌｌ", "The well"), ("ﬁrst oﬀer", "first offer"), ("café", "café"), ("zero​width﻿", "zerowidth"), ("soft­hyphen", "softhyphen"),
        ("no break", "no break"), ("a  　 b", "a b"), ("  ends ", "ends"), ("аеорсухіјѕ", "aeopcyxijs"), ("ΑΒΕ", "ABE"),
        ("ё", "ë"), ("\U0001d41e\U0001d41a", "ea"), ("ｶﾞ", "ガ"), ("⾬", "雨"), ("각", unicodedata.normalize("NFD", "각")), ("g", "ɡ"), ("™", "TM"), ("，", ","),
    ]
    flat = canon(spark, [x for p in same for x in p])
    assert [p for p, a, b in zip(same, flat[::2], flat[1::2]) if a != b] == []


def test_different_look(spark):
    differ = [("a\nb", "a b"), ("café", "cafe"), ("The", "the"), ("l0ck", "lock"), ("你", "妳"), ("а́", "a"), ("и", "n"), ("1", "l")]
    flat = canon(spark, [x for p in differ for x in p])
    assert [p for p, a, b in zip(differ, flat[::2], flat[1::2]) if a == b] == []


def test_null_empty_long(spark):
    assert canon(spark, [None, "", "   ", "é" * 100_000]) == [None, "", "", "é" * 100_000]


def test_pairs(spark):
    rows = [("b", "Ｈｉ"), ("a", "Hi"), ("a", "Hi"), ("c", "Hi"), ("d", "hi"), ("n", None), (None, "Hi"), ("e", ""), ("f", "​")]
    assert {tuple(r) for r in lookalike_pairs(frame(spark, rows)).collect()} == {("a", "b"), ("b", "c"), ("e", "f")}
    assert lookalike_pairs(frame(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Co", "Cn"], blacklist_characters="\x00"), max_size=40), min_size=1, max_size=20))
def test_equals_unicode_composition(texts):
    import pyarrow as pa

    from inkloom.llm.visual import _batches

    one, many, invisible = tables()
    gone = set(invisible)

    def slow(t):
        t = unicodedata.normalize("NFC", t)
        t = "".join("" if c in gone else one.get(c, many.get(c, c)) for c in t)
        t = unicodedata.normalize("NFC", t)
        return " ".join(w for w in t.split(" ") if w)

    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], ["id", "text"])
    got = [x for o in _batches(["id AS record_id", "text AS stored"], False)(iter([b])) for x in o.column(2).to_pylist()]
    assert got == [slow(t) for t in texts]
