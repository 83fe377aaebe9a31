"""Near-duplicate records: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

Shingle statistics are counted over all texts in a table of fixed size (hashed
document frequencies), signatures take one consistent weighted sample per bin
of the shingle hashes, bands of them group texts, and every pair of texts that
meets in a band is verified on its whole text. Where the similarity asked for is
that of plain sets, a second set of bands samples the shingles with equal
weights: texts that share what is common and differ in what is rare are far less
alike by weight than as sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from ..plans.sized import keep_keys
from . import kernels as K
from .meeting import counted, in_several_once, meet

#: Buckets of the table of document frequencies: 4 bytes each, whatever the corpus.
DF_BITS = 18
_BLOCK = 1 << 14
#: Bands of equal weights. They have more values each than those by weight: what very
#: many texts share weighs as much as the rest here, and would bring together all that
#: are a little alike.
EQUAL_BANDS, EQUAL_ROWS = 30, 8


def _stripped(texts: list[str], min_chars: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points without white space, lengths, and which of the texts they are."""
    for lo, hi in K.chunks(texts):
        cps, lengths = K.strip_spaces(*K.codepoints(texts[lo:hi]))
        ok = lengths >= min_chars
        yield cps[np.repeat(ok, lengths)], lengths[ok], np.flatnonzero(ok) + lo


def _frequencies(k: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for batch in batches:
            for cps, lengths, _ in _stripped(batch.column(0).to_pylist(), min_chars):
                _, h, _ = K.shingle_sets(cps, lengths, k)
                counts += np.bincount((h & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
                docs += len(lengths)
        if docs:
            blocks = range(0, 1 << DF_BITS, _BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(blocks)), -1], pa.int32()), pa.array([*(counts[i : i + _BLOCK].astype("<i4").tobytes() for i in blocks), np.array([docs], "<i4").tobytes()], pa.binary())], ["block", "counts"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, c, wide in zip(*(x.to_pylist() for x in batch.columns)):
            x = np.frombuffer(c, "<i8" if wide else "<i4").astype(np.int64)
            total[b] = total[b] + x if b in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary()), pa.array([True] * len(total))], ["block", "counts", "wide"])


def document_frequencies(texts: DataFrame, k: int, min_chars: int) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of the k-character shingles over all texts
    (2**DF_BITS numbers, however large the corpus) and the number of texts."""
    parts = texts.mapInArrow(_frequencies(k, min_chars), "block int, counts binary").withColumn("wide", F.lit(False))
    total, docs = np.zeros(1 << DF_BITS, dtype=np.int64), 0
    sums = parts.repartition("block").mapInArrow(_add_blocks, "block int, counts binary, wide boolean")
    for r in sums.collect():  # as many rows as blocks
        x = np.frombuffer(r["counts"], "<i8")
        if r["block"] < 0:
            docs = int(x[0])
        else:
            total[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = x
    return total, docs


def idf_weights(frequencies: np.ndarray, docs: int) -> np.ndarray:
    return (np.log((docs + 1) / (frequencies + 1)) + 1).clip(min=1.0)


def _weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(h & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)] * (1 + np.log(tf))


def _class(cps: np.ndarray) -> bytes:
    return hashlib.md5(cps.tobytes()).digest()


def _short(d: bytes) -> int:
    """The first 64 bits of a class, by which its bands name it. Classes that
    share them are all fetched for a pair; only each other they wouldn't meet."""
    return int.from_bytes(d[:8], "big", signed=True)


def _members(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_id, out_d = batch.column(0).to_pylist(), [], []
            for cps, lengths, which in _stripped(batch.column(1).to_pylist(), min_chars):
                ends = np.cumsum(lengths)
                out_d += [_class(cps[e - n : e]) for n, e in zip(lengths, ends)]
                out_id += [ids[i] for i in which]
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out_d, pa.binary())], ["id", "d"])

    return run


def _bands(k: int, min_chars: int, bins: int, rows: int, idf, equal: bool):
    """h, d, s: bands of each text of a batch, its class (64 bits) and its number of shingles;
    with `equal` also bands for equal weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            seen: set[bytes] = set()
            for cps, lengths, _ in _stripped(batch.column(0).to_pylist(), min_chars):
                if not len(lengths):
                    continue
                ends = np.cumsum(lengths)
                digests = [_class(cps[e - n : e]) for n, e in zip(lengths, ends)]
                doc, h, tf = K.shingle_sets(cps, lengths, k)
                samples = [(_weights(h, tf, table), bins)] + [(None, EQUAL_BANDS * EQUAL_ROWS)] * equal
                bands = np.hstack([K.band_hashes(x, n, i) for i, (x, n) in enumerate(zip(K.icws_signatures(doc, h, samples, len(lengths)), (rows, EQUAL_ROWS)))])
                size = np.bincount(doc, minlength=len(lengths)).astype(np.int32)
                new = np.zeros(len(lengths), dtype=bool)  # copies within a batch are met once
                for i, d in enumerate(digests):
                    if d not in seen:
                        seen.add(d)
                        new[i] = True
                pick = np.flatnonzero(new & (size > 0))
                each = np.repeat(pick, bands.shape[1])
                short = np.array([_short(d) for d in digests], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bands[pick].reshape(-1).view(np.int64)), pa.array(short[each]), pa.array(size[each])], ["h", "d", "s"])

    return run


def _verify(k: int, least: float, measure: str, idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            d1, d2, t1, t2 = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[], [], [], []]
            memo: dict[bytes, tuple] = {}

            def shingles(d: bytes, t: str) -> tuple:
                if d not in memo:
                    if len(memo) > 64:
                        memo.clear()
                    cps, n = K.strip_spaces(*K.codepoints([t]))
                    _, h, tf = K.shingle_sets(cps, n, k)
                    memo[d] = h, _weights(h, tf, table)
                return memo[d]

            for x, y, s, t in zip(d1, d2, t1, t2):
                (a, wa), (b, wb) = shingles(x, s), shingles(y, t)
                same = K.same_counts(a, b)
                plain = same / max(1, len(a) + len(b) - same)
                if measure == "plain" and plain < least:
                    continue
                _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                low = np.minimum(wa[ia], wb[ib]).sum()
                weighted = low / max(1e-12, wa.sum() + wb.sum() - low)
                if (plain if measure == "plain" else weighted) >= least:
                    for o, v in zip(out, (x, y, plain, weighted)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], ["d1", "d2", "jaccard", "weighted_jaccard"])

    return run


def _shingle_counts(k: int, min_chars: int):
    """h, n: shingles and in how many of the texts read they are, summed over some
    million at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for cps, lengths, _ in _stripped(batch.column(0).to_pylist(), min_chars):
                held.append(K.shingle_sets(cps, lengths, k)[1])
                if sum(map(len, held)) >= 1 << 22:
                    yield summed()
        if held:
            yield summed()

    return run


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(*(c.to_pylist() for c in batch.columns)):
                cps, n = K.strip_spaces(*K.codepoints([t]))
                _, h, tf = K.shingle_sets(cps, n, k)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(h), pa.binary()), pa.array(h.astype(np.int64)), pa.array(tf.astype(np.int32))], ["d", "h", "tf"])

    return run


def _verify_true(least: float, docs: int):
    """As _verify() by the weighted measure, from shingles with their true frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]

            def shingles(i: int, c: int) -> tuple[np.ndarray, np.ndarray]:
                h, tf, n = (v.to_numpy(zero_copy_only=False) for v in batch.column(c)[i].values.flatten())
                return h, idf_weights(n, docs) * (1 + np.log(tf))

            for i in range(batch.num_rows):
                (a, wa), (b, wb) = shingles(i, 2), shingles(i, 3)
                same, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                low = np.minimum(wa[ia], wb[ib]).sum()
                weighted = low / max(1e-12, wa.sum() + wb.sum() - low)
                if weighted >= least:
                    for o, v in zip(out, (x[i], y[i], len(same) / max(1, len(a) + len(b) - len(same)), weighted)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], ["d1", "d2", "jaccard", "weighted_jaccard"])

    return run


def near_duplicate_pairs(df: DataFrame, id_col: str = "id", text_col: str = "content", similarity: float = 0.8, measure: str = "weighted", k: int = 5, min_chars: int = 120, bands: int = 24, rows: int = 6) -> tuple[DataFrame, DataFrame]:
    """Pairs of different texts that are alike, and the members of each text.

    Returns (pairs, members): pairs(d1, d2, jaccard, weighted_jaccard), d1 < d2
    classes of texts equal but for white space; members(d, id). measure says
    which similarity must reach the threshold: "weighted" (TF-IDF, by true document
    frequencies) or "plain" (sets of shingles; weighted_jaccard is then only told
    by the hashed table). A pair at the threshold of 0.8 meets in a band with a
    chance of 0.999 by weight (24 bands of 6) and of 0.996 as sets (30 bands of 8
    besides); no bucket has a cap, large ones are met in blocks.

    White space is removed before all else; texts with fewer than min_chars
    other characters, null texts and null ids take no part. Repeated rows count
    once; other columns are ignored; empty input gives empty frames.
    """
    if measure not in ("weighted", "plain"):
        raise ValueError(f"unknown measure {measure!r}")
    spark = df.sparkSession
    scratch = Scratch(spark)
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    counts, docs = document_frequencies(source.select("text"), k, min_chars)
    idf = spark.sparkContext.broadcast(idf_weights(counts, docs))
    members = scratch.keep(source.mapInArrow(_members(min_chars), "id string, d binary").distinct())
    postings = source.select("text").mapInArrow(_bands(k, min_chars, bands * rows, rows, idf, measure == "plain"), "h long, d long, s int")
    shared = scratch.keep(in_several_once(postings).distinct())
    met = meet(counted(shared), "s")
    if measure == "plain":  # of sets with that similarity, neither is much larger
        met = met.filter(F.least("s1", "s2") >= F.lit(math.floor(similarity * 1e9) / 1e9) * F.greatest("s1", "s2"))
    met = met.select(F.col("d1").alias("c1"), F.col("d2").alias("c2")).distinct()
    short = F.conv(F.hex(F.substring("d", 1, 8)), 16, -10).cast("long")
    classes = scratch.keep(members.select("d").distinct().select("d", short.alias("c")))
    met = met.join(classes.select(F.col("d").alias("x"), F.col("c").alias("c1")), "c1").join(classes.select(F.col("d").alias("y"), F.col("c").alias("c2")), "c2")
    pairs = scratch.keep(met.select(F.least("x", "y").alias("d1"), F.greatest("x", "y").alias("d2")).distinct())
    wanted = pairs.select(F.col("d1").alias("d")).union(pairs.select("d2")).distinct()
    holders = scratch.keep(members.join(wanted, "d", "left_semi").groupBy("d").agg(F.min("id").alias("id")))
    # one text of each class that is in a pair, fetched by the id that stands for it
    ids = scratch.keep(holders.select("id").distinct())
    texts = keep_keys(source, ids, "id").dropDuplicates(["id"]).join(holders, "id").select("d", "text")
    if measure == "weighted":
        # frequencies as they are, not as the table has them: of the shingles of these texts only
        rows_of = scratch.keep(texts.mapInArrow(_shingle_rows(k), "d binary, h long, tf int"))
        counts = source.select("text").mapInArrow(_shingle_counts(k, min_chars), "h long, n long")
        true = counts.join(rows_of.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.sum("n").alias("n"))
        each = scratch.keep(rows_of.join(true, "h").groupBy("d").agg(F.collect_list(F.struct("h", "tf", "n")).alias("s")))
        both = pairs.join(each.select(F.col("d").alias("d1"), F.col("s").alias("s1")), "d1").join(each.select(F.col("d").alias("d2"), F.col("s").alias("s2")), "d2")
        return scratch.keep(both.select("d1", "d2", "s1", "s2").mapInArrow(_verify_true(similarity, docs), "d1 binary, d2 binary, jaccard double, weighted_jaccard double")), members
    both = pairs.join(texts.select(F.col("d").alias("d1"), F.col("text").alias("t1")), "d1").join(texts.select(F.col("d").alias("d2"), F.col("text").alias("t2")), "d2")
    found = both.select("d1", "d2", "t1", "t2").mapInArrow(_verify(k, similarity, measure, idf), "d1 binary, d2 binary, jaccard double, weighted_jaccard double")
    return scratch.keep(found), members
