"""Splitting oversized texts at natural boundaries, by recursive bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Punctuation after which a text may be cut.
PUNCTUATION = ".!?。！？…;；"

_STRENGTH = np.zeros(1 << 16, dtype=np.int8)
_STRENGTH[[ord(c) for c in PUNCTUATION]] = 3
_STRENGTH[[c for c in K.WHITE_SPACE]] = 1
_STRENGTH[[10, 11, 12, 13, 133, 8232, 8233]] = 4


def strengths(cps: np.ndarray) -> np.ndarray:
    """Of each character, how good a cut after it is: 0 no boundary, 1 a space,
    2 a space after the end of a sentence, 3 the end of a sentence, 4 a line
    break, 5 an empty line."""
    s = _STRENGTH[np.minimum(cps, 0xFFFF)].copy()
    s[cps > 0xFFFF] = 0
    if len(s) > 1:
        after = s[:-1]
        s[1:][(s[1:] == 1) & (after == 3)] = 2
        s[1:][(s[1:] == 4) & (after == 4)] = 5
        # the better cut is after the space that follows a sentence
        s[:-1][(s[:-1] == 3) & (s[1:] == 2)] = 2
        s[1:][s[1:] == 2] = 3
    return s


def longest_unbroken(cps: np.ndarray) -> int:
    """The longest run of characters none of which is a boundary."""
    at = np.flatnonzero(_STRENGTH[np.minimum(cps, 0xFFFF)] * (cps <= 0xFFFF))
    return int(np.diff(np.concatenate(([-1], at, [len(cps)]))).max() - 1)


def cuts(cps: np.ndarray, max_chars: int, overlap: int) -> list[int]:
    """Ends of the stretches of a text; the pieces are these stretches, each
    with the `overlap` characters before it (the first without).

    A stretch that is too long is cut at the strongest boundary of its middle
    half, the one nearest to the midpoint among equals; without one there, at
    the boundary nearest to the midpoint; without any, at the midpoint."""
    limit = max_chars - overlap
    s = strengths(cps)
    ends, todo = [], [(0, len(cps))]
    while todo:
        a, b = todo.pop()
        if b - a <= (max_chars if a == 0 else limit):
            ends.append(b)
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        lo, hi = max(a + 1, mid - quarter), min(b - 1, mid + quarter)
        window = s[lo - 1 : hi]  # a cut at p comes after the character p - 1
        if len(window) and window.max() > 0:
            at = np.flatnonzero(window == window.max()) + lo
            p = int(at[np.argmin(np.abs(at - mid))])
        else:
            at = np.flatnonzero(s[a : b - 1]) + a + 1
            p = int(at[np.argmin(np.abs(at - mid))]) if len(at) else mid
        todo += [(p, b), (a, p)]
    return ends


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        kinds, ids, texts, limits, overlaps = (c.to_pylist() for c in batch.columns)
        forced, pieces = [], []
        for t, limit, overlap in zip(texts, limits, overlaps):
            cps, _ = K.codepoints([t])
            ends = cuts(cps, limit, overlap)
            starts = [0, *(e - overlap for e in ends[:-1])]
            forced.append(int(longest_unbroken(cps) > limit))
            pieces.append([{"start": max(0, a), "end": b, "text": t[max(0, a) : b]} for a, b in zip(starts, ends)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.string()), pa.array(forced, pa.int32()), pa.array(pieces, piece)], ["record_kind", "record_id", "forced", "pieces"])


def split_oversized(df: DataFrame, id_col: str, text_col: str, kind: str, limits: DataFrame) -> DataFrame:
    """record_kind, record_id, forced, pieces(start, end, text) of each record of
    df with more characters than max_chars of its kind in limits(record_kind,
    max_chars, overlap_chars), one row per id and text.

    Each piece has at most max_chars characters and begins with the last
    overlap_chars of the one before; start and end are characters of the whole
    text. forced is 1 if the text has more than max_chars characters on end
    without a boundary. Null ids, null texts and kinds without a limit take no
    part; repeated rows count once; an overlap that isn't less than max_chars
    raises, and so do several different limits for a kind; empty input gives an empty frame.
    """
    lim = limits.filter(F.col("record_kind") == kind).select("record_kind", F.col("max_chars").cast("int").alias("max_chars"), F.greatest(F.lit(0), F.coalesce(F.col("overlap_chars"), F.lit(0))).cast("int").alias("overlap_chars")).filter("max_chars > 0")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).when(F.min(c).isNotNull(), F.raise_error(F.lit(f"several limits for {kind}")).cast("int")).alias(c)
    lim = lim.groupBy("record_kind").agg(one("max_chars"), one("overlap_chars"))
    lim = lim.withColumn("overlap_chars", F.when(F.col("overlap_chars") < F.col("max_chars"), F.col("overlap_chars")).otherwise(F.raise_error(F.lit("overlap_chars must be less than max_chars")).cast("int")))
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    # one row of limits: the join is a broadcast of a single row
    over = rows.join(F.broadcast(lim), F.length("text") > F.col("max_chars")).select("record_kind", "id", "text", "max_chars", "overlap_chars").dropDuplicates(["id", "text"])
    return over.mapInArrow(_split, "record_kind string, record_id string, forced int, pieces array<struct<start:int,end:int,text:string>>")
