"""One consistent form for text that looks the same but differs in characters.

The rewriting is SQL run by DuckDB over each Arrow batch. The mapping tables
are built from the Unicode data by rule and from the short lists below.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Letters of other alphabets drawn like a Latin letter (Cyrillic,
#: Greek, Armenian, Cherokee, Coptic, Lisu), each followed by that letter.
LOOKALIKES = (
    # Cyrillic
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҺH ԚQ ԜW ӀI ѴV ԌG ҮY ӔÆ "
    "аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ѵv ӕæ "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ ϜF οo νv ϲc ϳj ρp "
    # Armenian
    "ՏS ՕO օo սu ոn հh ցg զq "
    # Cherokee
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    # Coptic
    "ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT "
    # Lisu
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
)
#: Letters of the Latin script drawn like a plain one.
LATIN_VARIANTS = "ɡg ɑa"
#: Ranges of characters without width that have no general category
#: Cf, besides all of Cf but the visible signs that follow.
WIDTHLESS = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
VISIBLE_FORMAT = ((0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))


def _within(c: int, ranges: tuple) -> bool:
    return any(a <= c <= b for a, b in ranges)


@functools.cache
def tables() -> tuple[dict[str, str], dict[str, str], list[str]]:
    """(one-to-one, one-to-many, invisible): mappings of single characters.

    Targets are in their final form: compatibility decomposition, look-alike
    letters of any base letter replaced, spaces ordinary, composed again."""
    pairs = [x for x in (LOOKALIKES + " " + LATIN_VARIANTS).split() if len(x) == 2 and x[0] != x[1]]
    same = {x[0]: x[1] for x in pairs if ord(x[1]) < 0x250}
    one, many, invisible = {}, {}, []
    for c in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= c <= 0xDFFF or 0xAC00 <= c <= 0xD7A3 or 0xE000 <= c <= 0xF8FF:
            continue
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co"):
            if not _within(c, WIDTHLESS):
                continue
        if (cat == "Cf" and not _within(c, VISIBLE_FORMAT)) or _within(c, WIDTHLESS):
            invisible.append(ch)
            continue
        if cat == "Zs":
            one[ch] = " "
            continue
        parts = unicodedata.normalize("NFKD", ch)
        parts = "".join(same.get(x, x) for x in parts)
        to = unicodedata.normalize("NFKC", parts)
        to = "".join(" " if unicodedata.category(x) == "Zs" else x for x in to)
        if to != unicodedata.normalize("NFC", ch):
            (one if len(to) == 1 else many)[ch] = to
    return one, many, invisible


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.cache
def canonical_sql(column: str) -> str:
    """The DuckDB expression of the canonical form of a column.

    Decomposed look-alikes are composed first (nfc_normalize), then single
    characters are translated (an invisible character to nothing) and
    characters that stand for several are replaced, each where a text holds
    any, and the result is composed again, with runs of spaces as one and none
    at the ends. Line breaks, accents, case, digits and wording stay."""
    one, many, invisible = tables()
    # DuckDB reads a translation table anew for each row, so the short one of the
    # full-width forms that are usual in Chinese and Japanese goes first
    wide = {c: t for c, t in one.items() if 0xFF01 <= ord(c) <= 0xFF5E or c == "\u3000"}
    rest = {c: t for c, t in one.items() if c not in wide}
    x = f"nfc_normalize({column})"
    for sources, targets in (("".join(wide), "".join(wide.values())), ("".join(rest) + "".join(invisible), "".join(rest.values()))):
        some = "[" + "".join(_class_ranges(sorted(sources))) + "]"
        x = f"(SELECT CASE WHEN regexp_matches(x, {_quoted(some)}) THEN translate(x, {_quoted(sources)}, {_quoted(targets)}) ELSE x END FROM (SELECT {x} AS x))"
    expand = "array_to_string(list_transform(string_split(x, ''), lambda c: coalesce(many[c], c)), '')"
    rare = "[" + "".join(_class_ranges(sorted(many))) + "]"
    x = f"(SELECT CASE WHEN regexp_matches(x, {_quoted(rare)}) THEN {expand} ELSE x END FROM (SELECT {x} AS x))"
    x = f"(SELECT CASE WHEN contains(x, '  ') THEN regexp_replace(x, '  +', ' ', 'g') ELSE x END FROM (SELECT nfc_normalize({x}) AS x))"
    return f"trim({x}, ' ')"


def _class_ranges(chars: list[str]) -> Iterator[str]:
    """Members of a character class, runs of code points as ranges."""
    i = 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and ord(chars[j + 1]) == ord(chars[j]) + 1:
            j += 1
        yield f"\\x{{{ord(chars[i]):X}}}" + (f"-\\x{{{ord(chars[j]):X}}}" if j > i else "")
        i = j + 1


def _connection():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    _, many, _ = tables()
    con.execute("CREATE TABLE mapping (c VARCHAR, t VARCHAR)")
    con.executemany("INSERT INTO mapping VALUES (?, ?)", [[c, t] for c, t in many.items()]) if many else None
    return con


def _batches(keep: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if con is None:
                con = _connection()
                con.execute("SET VARIABLE many = (SELECT map(list(c), list(t)) FROM mapping)")
                sql = canonical_sql("text").replace("many[c]", "getvariable('many')[c]")
                out = "md5({0}) AS canonical".format("canonical") if digest else "canonical"
                query = f"SELECT {', '.join(keep)}, {out} FROM (SELECT *, {sql} AS canonical FROM part)"
            con.register("part", pa.Table.from_batches([batch]))
            for b in con.sql(query).to_arrow_table().to_batches():
                yield pa.RecordBatch.from_arrays([b.column(i).cast(pa.string()) for i in range(b.num_columns)], b.schema.names)
            con.unregister("part")

    return run


def canonical_text(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """record_id, stored (the text as it is) and canonical, one row per row of df.

    A null text has a null canonical form, an empty or blank one an empty form.
    Other columns of df are ignored; an empty input gives an empty frame.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_batches(["id AS record_id", "text AS stored"], False), "record_id string, stored string, canonical string")


def lookalike_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """a, b: ids (smaller first) of records whose texts are stored differently
    but have the same canonical form, each pair once.

    Rows with null id or null text take no part; texts that are blank or empty
    once canonical are equal to each other; repeated rows count once."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("stored", F.md5("text"))
    forms = rows.mapInArrow(_batches(["id", "stored"], True), "id string, stored string, canonical string").distinct()
    forms = Scratch(df.sparkSession).keep(forms)
    # the different texts of one form are paired first, then given their ids: equal
    # texts, however many, are never paired
    texts = forms.select("canonical", "stored").distinct()
    left, right = texts.select("canonical", F.col("stored").alias("s1")), texts.select("canonical", F.col("stored").alias("s2"))
    pairs = left.join(right, "canonical").filter(F.col("s1") < F.col("s2")).select("s1", "s2")
    ids = forms.select("stored", "id")
    met = pairs.join(ids.select(F.col("stored").alias("s1"), F.col("id").alias("x")), "s1").join(ids.select(F.col("stored").alias("s2"), F.col("id").alias("y")), "s2").filter(F.col("x") != F.col("y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
