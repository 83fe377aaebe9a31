"""Long exact spans shared between records.

Units of text are hashed and their digests grouped globally. Lines come first:
texts that hold the same line of at least `min_length` characters are linked by its
digest alone. A stretch quoted from the middle of a line holds no whole line, so
there are units of a second kind, runs of `unit` characters whose limits are set
by the content itself (winnowing): any `min_length` characters two texts have in
common contain a unit that both selected. Texts that share such a unit and no
line are compared character by character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from ..plans.sized import keep_keys
from . import kernels as K
from .meeting import in_several, meet

#: A unit found in more places than this is met by the runs around it instead.
HOT_UNIT = 64
SPANS = "array<struct<start:int,end:int>>"


def _digest(col: str) -> F.Column:
    return F.unhex(F.md5(F.col(col)))


def _unit_postings(unit: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, str] = {}
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(d, t)
            digests, texts = list(seen), list(seen.values())
            for lo, hi in K.chunks(texts):
                cps, lengths = K.codepoints(texts[lo:hi])
                at, h = K.winnow(cps, lengths, unit, min_length - unit + 1)
                owner = np.searchsorted(np.cumsum(lengths), at, side="right") + lo
                start = at - (np.cumsum(lengths) - lengths)[owner - lo]
                order = np.lexsort((start, h, owner))  # all places of a unit in a text are one row
                owner, h, start = owner[order], h[order], start[order]
                first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))) if len(h) else order
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(digests, pa.binary()).take(pa.array(owner[first])), places], ["h", "d", "places"])

    return run


def _windows(unit: int, min_length: int):
    """Hashes and places of all runs of min_length characters around the units of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, places, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = K.gram_hashes(K.codepoints([text])[0], min_length)
                around = np.asarray(places, dtype=np.int64)[:, None] - np.arange(min_length - unit + 1)
                around = np.unique(around[(around >= 0) & (around < len(h))])
                yield pa.RecordBatch.from_arrays([pa.array(h[around].view(np.int64)), pa.array([d] * len(around), pa.binary()), pa.array(around.astype(np.int32))], ["h", "d", "at"])

    return run


def _runs(mask: np.ndarray, reach: int) -> list[dict]:
    """Ranges of characters covered by the windows at the true positions."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > reach)
    starts, ends = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + reach
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)]


def _common(a: np.ndarray, b: np.ndarray, s: str, t: str, n: int) -> list[dict]:
    """The stretches of s, of n characters or more, that t holds, from the hashes
    of their runs; each is borne out by the characters themselves."""
    found = _runs(np.isin(a, b), n)
    return [r for r in found if any(s[r["start"] : r["start"] + n] == t[q : q + n] for q in np.flatnonzero(b == a[r["start"]]))]


def _verify(min_length: int):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2, t1, t2 = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[], [], [], []]
            memo: dict[bytes, np.ndarray] = {}

            def grams(d: bytes, t: str) -> np.ndarray:
                if d not in memo:
                    if len(memo) > 64:
                        memo.clear()
                    memo[d] = K.gram_hashes(K.codepoints([t])[0], min_length)
                return memo[d]

            for x, y, s, t in zip(d1, d2, t1, t2):
                a, b = grams(x, s), grams(y, t)
                if in_a := _common(a, b, s, t, min_length):
                    for o, v in zip(out, (x, y, in_a, _common(b, a, t, s, min_length))):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], spans), pa.array(out[3], spans)], ["d1", "d2", "spans1", "spans2"])

    return run


def _classes(df: DataFrame, id_col: str, text_col: str, min_length: int) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= min_length)).withColumn("d", _digest("text"))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return keep_keys(rows.select("d", "text"), wanted, "d").groupBy("d").agg(F.first("text").alias("text"))


def _units(scratch: Scratch, rows: DataFrame, min_length: int, unit: int) -> tuple[DataFrame, DataFrame | None]:
    """(few, many): postings of the units of several texts, and, in place of the
    units found more than HOT_UNIT times, of all runs of min_length characters
    around them that several texts hold (with their place, at).

    What either leads to is the same: two texts with such a run in common hold
    one of its units; by a unit of many texts they meet only if the run is the same."""
    postings = scratch.keep(rows.select("d", "text").mapInArrow(_unit_postings(unit, min_length), "h long, d binary, places array<int>"))
    shared = scratch.keep(in_several(postings, F.size("places")).distinct())
    scratch.drop(postings)
    hot = scratch.keep(shared.filter(F.col("n") > HOT_UNIT).select("d", F.explode("places").alias("at")).groupBy("d").agg(F.collect_set("at").alias("places")))
    few = shared.filter(F.col("n") <= HOT_UNIT).select("h", "d", "n")
    if hot.isEmpty():
        return few, None
    texts = _texts(rows, hot.select("d"))
    windows = scratch.keep(hot.join(texts, "d").select("d", "places", "text").mapInArrow(_windows(unit, min_length), "h long, d binary, at int"))
    many = scratch.keep(in_several(windows, F.lit(1)).distinct())
    scratch.drop(windows)
    return few, many


def _lines_met(scratch: Scratch, rows: DataFrame, min_length: int) -> DataFrame:
    """d1 < d2: texts that hold the same line of at least min_length characters."""
    lines = rows.select("d", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= min_length)
    return meet(in_several(scratch.keep(lines.select(_digest("line").alias("h"), "d").distinct()), F.lit(1)))


def _compared(scratch: Scratch, rows: DataFrame, pairs: DataFrame, min_length: int) -> DataFrame:
    wanted = scratch.keep(pairs.select(F.col("d1").alias("d")).union(pairs.select("d2")).distinct())
    texts = _texts(rows, wanted)
    both = pairs.join(texts.select(F.col("d").alias("d1"), F.col("text").alias("t1")), "d1").join(texts.select(F.col("d").alias("d2"), F.col("text").alias("t2")), "d2")
    return scratch.keep(both.select("d1", "d2", "t1", "t2").mapInArrow(_verify(min_length), f"d1 binary, d2 binary, spans1 {SPANS}, spans2 {SPANS}"))


def _members(scratch: Scratch, rows: DataFrame) -> DataFrame:
    return scratch.keep(rows.select("d", "id", F.length("text").alias("n_chars")).distinct())


def shared_span_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", min_length: int = 200, unit: int = 80) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts with a common run of at least min_length
    characters, and the members of each text.

    Returns (pairs, members): pairs(d1, d2, by_line) with d1 < d2 digests of
    texts, by_line whether a whole line links them; members(d, id, n_chars), one
    row per id and text. Equal texts are one class and meet once. Rows with null
    id or null text, and texts shorter than min_length, take no part; repeated
    rows count once; other columns of df are ignored. Empty input gives empty
    frames.
    """
    scratch = Scratch(df.sparkSession)
    rows = _classes(df, id_col, text_col, min_length)
    few, many = _units(scratch, rows, min_length, unit)
    met = meet(few) if many is None else meet(few).union(meet(many.select("h", "d", "n").distinct()))
    each = met.withColumn("by_line", F.lit(False)).union(_lines_met(scratch, rows, min_length).withColumn("by_line", F.lit(True)))
    pairs = scratch.keep(each.groupBy("d1", "d2").agg(F.max("by_line").alias("by_line")))
    compared = _compared(scratch, rows, pairs.filter("not by_line").select("d1", "d2"), min_length)
    return pairs.filter("by_line").union(compared.select("d1", "d2", F.lit(False))), _members(scratch, rows)


def expand_pairs(pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of ids from pairs (d1, d2) of classes and their members (d, id),
    with the pairs within a class; smaller id first, each pair once."""
    m = members.select("d", "id")
    between = pairs.select("d1", "d2").join(m.select(F.col("d").alias("d1"), F.col("id").alias("x")), "d1").join(m.select(F.col("d").alias("d2"), F.col("id").alias("y")), "d2")
    within = m.select("d", F.col("id").alias("x")).join(m.select("d", F.col("id").alias("y")), "d").filter(F.col("x") < F.col("y"))
    both = between.select("x", "y").filter(F.col("x") != F.col("y")).union(within.select("x", "y"))
    return both.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()


def shared_coverage(df: DataFrame, id_col: str = "id", text_col: str = "content", min_length: int = 200, unit: int = 80) -> DataFrame:
    """For each record with a stretch of at least min_length characters found in
    another one: record_id, spans (merged, in characters), shared_chars,
    n_chars, coverage (0..1), copies (records with the very same text).

    A text that several ids hold is shared as a whole. What very many texts
    share is found without pairing them: a run is shared if its digest occurs
    in several texts. Nulls, short texts, repeated rows and empty input as in
    shared_span_pairs().
    """
    scratch = Scratch(df.sparkSession)
    rows = _classes(df, id_col, text_col, min_length)
    members = _members(scratch, rows)
    few, many = _units(scratch, rows, min_length, unit)
    pairs = _compared(scratch, rows, scratch.keep(meet(few).distinct()), min_length)
    ids = members.groupBy("d").agg(F.count("id").alias("copies"), F.first("n_chars").alias("n_chars"))
    whole = ids.filter("copies > 1").select("d", F.lit(0).alias("start"), F.col("n_chars").alias("end"))
    each = pairs.select(F.col("d1").alias("d"), F.explode("spans1").alias("s")).union(pairs.select("d2", F.explode("spans2"))).select("d", "s.start", "s.end").distinct().union(whole)
    if many is not None:
        each = each.union(many.select("d", F.col("at").alias("start"), (F.col("at") + min_length).alias("end")))
    order = Window.partitionBy("d").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        each.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
        .withColumn("part", F.sum("new").over(order))
        .groupBy("d", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    )
    return (
        members.select("d", "id").join(merged, "d").join(ids, "d")
        .select(F.col("id").alias("record_id"), "spans", "shared_chars", F.col("n_chars").cast("long").alias("n_chars"), (F.col("shared_chars") / F.col("n_chars")).alias("coverage"), "copies")
    )


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, digests = [], [], [], []
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for line in text.split("\n"):
                    unit = " ".join(line.split())
                    if len(unit) >= least:
                        ids.append(i)
                        starts.append(at)
                        ends.append(at + len(line))
                        digests.append(hashlib.md5(unit.encode("utf-8", "surrogatepass")).digest())
                    at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())], ["id", "start", "end", "h"])

    return run


def repeated_lines(df: DataFrame, id_col: str = "id", text_col: str = "content", least: int = 80) -> DataFrame:
    """record_id, start, end, first_id, first_start: every line of at least `least`
    characters (runs of white space as one) that repeats an earlier one, with its
    place in the text as stored and the occurrence that is kept: the one of the
    smallest record id, then the first in it. Nulls take no part; repeated rows
    count once; empty input gives an empty frame."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    lines = Scratch(df.sparkSession).keep(rows.mapInArrow(_lines(least), "id string, start int, end int, h binary").distinct())
    first = lines.groupBy("h").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    out = lines.join(first, "h").filter((F.col("id") != F.col("first.id")) | (F.col("start") != F.col("first.start")))
    return out.select(F.col("id").alias("record_id"), "start", "end", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
