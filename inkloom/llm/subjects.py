"""Subject areas of each document: averaged word and subword embeddings with an
independent logistic output for each subject, trained by synchronous gradients.

The model judges sentences. A labelled document passes its labels on to its
sentences; those that are about nothing in particular occur under all labels
alike and so get small scores. After a first training each label is kept only
for the sentences of its document that bear it out, and training goes on with
those. A document has the subjects that enough of its sentences are about.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch
from . import kernels as K

BUCKETS, DIM = 1 << 16, 16
#: Features whose gradients are summed as one block.
BLOCK = 1 << 12
#: Labelled documents used for training at most, taken by the hash of their ids.
LABELLED_DOCS = 20_000
#: Labelled documents a feature must occur in to count.
MIN_DOCS = 3
#: Pull of the embeddings and outputs towards zero.
DECAY = 1e-5
#: Spread of the first embeddings, and the gradient below which a step is damped.
INIT, DAMPING = 0.01, 1e-5
#: From this chance on a sentence counts as about a subject.
CHANCE = 0.4

_SENTENCE = re.compile(r"\n+|(?<=[。！？])(?![”」』’])|(?<=[.!?])\s+(?=[^a-z0-9\s])|(?<=[.!]”)\s+(?=[^a-z0-9\s])")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; scraps with fewer than three letters aren't any."""
    if not text:
        return []
    parts = (p.strip() for p in _SENTENCE.split(text.replace("\r", "\n")))
    return [p for p in parts if sum(1 for _ in islice(filter(str.isalpha, p), 3)) == 3]


def _spread(x: np.ndarray) -> np.ndarray:
    return (K.mix(x, 9) >> np.uint64(64 - 16)).astype(np.int32)


_LETTER = np.zeros(0x3000, dtype=bool)
_LETTER[[c for c in range(0x3000) if chr(c).isalnum()]] = True
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, dtype=np.uint64), out=out[1:]) if n > 1 else None
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of the texts and the index of its text, in order:
    words, pairs of words and runs of 5 letters in alphabets; runs of 2 to 4
    characters in Chinese, Japanese and Korean."""
    cps, lengths = K.codepoints([unicodedata.normalize("NFKC", t).lower() for t in texts])
    n = len(cps)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    wide = (cps >= 0x3040) & ~((cps >= 0xFF00) & (cps < 0xFFA0))
    letter = ~wide & _LETTER[np.minimum(cps, 0x2FFF)]
    buckets, owners = [], []
    for k, mask, salt in ((2, wide, 11), (3, wide, 12), (4, wide, 13), (5, letter, 14)):
        if n < k:
            continue
        runs = np.concatenate(([0], np.cumsum(mask)))
        ok = (runs[k:] - runs[:-k] == k) & (owner[: n - k + 1] == owner[k - 1 :])
        at = np.flatnonzero(ok)
        buckets.append(_spread(K.mix(K.gram_hashes(cps, k)[at], salt)))
        owners.append(owner[at])
    edge = np.concatenate(([False], letter, [False]))
    turn = np.flatnonzero((edge[1:] != edge[:-1]) | np.concatenate(([False], (owner[1:] != owner[:-1]), [False])) & edge[1:] & edge[:-1])
    bounds = np.unique(turn)
    starts = bounds[np.append(letter, False)[np.minimum(bounds, n)] & (bounds < n)]
    if len(starts):
        ends = np.searchsorted(bounds, starts, side="right")
        ends = bounds[ends]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(cps.astype(np.uint64)) * _powers(_ODD, n), dtype=np.uint64)))
        word = (total[ends] - total[starts]) * _powers(_INVERSE, n)[starts]
        buckets.append(_spread(K.mix(word, 15)))
        owners.append(owner[starts])
        two = owner[starts[1:]] == owner[starts[:-1]]
        buckets.append(_spread(K.mix(word[:-1][two] * np.uint64(3) + word[1:][two], 16)))
        owners.append(owner[starts[:-1]][two])
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def _means(table: np.ndarray, b: np.ndarray, o: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table's rows of each text, and the number of features."""
    count = np.bincount(o, minlength=n)
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    some = np.flatnonzero(count)
    if len(b):
        out[some] = np.add.reduceat(table[b], np.cumsum(count[some]) - count[some], axis=0) / count[some, None]
    return out, count


def _known(known: np.ndarray, b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = known[b]
    return b[keep], o[keep]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, targets, feats = [], [], []
        for i, (text, labels) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            parts = sentences(text)
            b, o = features(parts)
            cut = np.searchsorted(o, np.arange(len(parts) + 1))
            for s in range(len(parts)):
                ids.append(batch.column(2)[i].as_py())
                targets.append(labels)
                feats.append(b[cut[s] : cut[s + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(targets, pa.list_(pa.int32())), pa.array(feats, pa.list_(pa.int32()))], ["doc", "labels", "features"])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _gradients(state, subjects: int):
    """block, part, sums of a partition: the embeddings' gradient in blocks of
    features and, in the last one, the outputs' and offsets' gradients and the
    number of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, w, c = state.value
        ge, gw, gc, n = np.zeros_like(e), np.zeros_like(w), np.zeros_like(c), 0
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            b, o = _lists(batch.column(2))
            label, row = _lists(batch.column(1))
            y = np.zeros((k, subjects), dtype=np.float32)
            y[row, label] = 1
            h, count = _means(e, b, o, k)
            d = _sigmoid(h @ w + c) - y
            gw += h.T @ d
            gc += d.sum(axis=0)
            dh = (d @ w.T) / np.maximum(count, 1)[:, None]
            order = np.argsort(b, kind="stable")
            sb = b[order]
            if len(sb):
                first = np.flatnonzero(np.concatenate(([True], sb[1:] != sb[:-1])))
                ge[sb[first]] += np.add.reduceat(dh[o[order]], first, axis=0)
            n += k
        part = TaskContext.get().partitionId()
        blocks = range(0, len(e), BLOCK)
        held = [ge[i : i + BLOCK].tobytes() for i in blocks] + [np.concatenate((gw.ravel(), gc, [n])).astype(np.float32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array(held, pa.binary())], ["block", "part", "sums"])

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks over all partitions, in their order: the same on every run."""
    held: dict[int, list] = {}
    for batch in batches:
        for block, part, x in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(block, []).append((part, x))
    if held:
        sums = [np.sum([np.frombuffer(x, np.float32) for _, x in sorted(parts)], axis=0).tobytes() for parts in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(sums, pa.binary())], ["block", "sums"])


def _compact(known: np.ndarray):
    """Features that are known, numbered among these."""
    number = np.cumsum(known) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = _lists(batch.column(2))
            b, o = _known(known, b, o)
            ends = np.concatenate(([0], np.cumsum(np.bincount(o, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(number[b].astype(np.int32)))], ["doc", "labels", "features"])

    return run


def _borne_out(state, subjects: int, keep: float):
    """Of each sentence those of its document's labels that the model gives at
    least this chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, w, c = state.value
        for batch in batches:
            k = batch.num_rows
            label, row = _lists(batch.column(1))
            p = _sigmoid(_means(e, *_lists(batch.column(2)), k)[0] @ w + c)
            good = p[row, label] >= keep
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[good], minlength=k)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(label[good].astype(np.int32))), batch.column(2)], ["doc", "labels", "features"])

    return run


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many labelled documents of a partition each feature occurs."""
    docs: dict[int, list] = {}
    for batch in batches:
        lists = batch.column(2)
        at, b = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        for i, d in enumerate(batch.column(0).to_pylist()):
            docs.setdefault(d, []).append(b[at[i] - at[0] : at[i + 1] - at[0]])
    counts = np.zeros(BUCKETS, dtype=np.int32)
    for parts in docs.values():
        counts[np.unique(np.concatenate(parts))] += 1
    yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])


class Model:
    """Embeddings (BUCKETS x DIM), outputs (DIM x subjects), their offsets, and
    which features occurred in enough labelled documents to be trusted."""

    def __init__(self, subjects: list[str], e: np.ndarray, w: np.ndarray, c: np.ndarray, known: np.ndarray) -> None:
        self.subjects, self.e, self.w, self.c, self.known = subjects, e, w, c, known


def _descend(spark, data: DataFrame, subjects: int, size: int, rounds: int, rate: float, seed: int, start: list[np.ndarray] | None = None, decay: float = DECAY) -> list[np.ndarray]:
    """Embeddings, outputs and offsets after so many rounds of full gradients,
    summed over all partitions (Adam)."""
    rng = np.random.default_rng(seed)
    params = start or [rng.normal(0, INIT, (size, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, subjects)).astype(np.float32), np.full(subjects, -2.0, dtype=np.float32)]
    params = [x.copy() for x in params]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(params)
        # summed in executors: what comes to the driver is as large as the model
        parts = data.mapInArrow(_gradients(shared, subjects), "block int, part int, sums binary").repartition(4, "block").mapInArrow(_total, "block int, sums binary")
        got = [np.frombuffer(x, np.float32) for _, x in sorted((r["block"], r["sums"]) for r in parts.collect())]
        shared.destroy()
        if not got or not got[-1][-1]:
            break
        n, rest = got[-1][-1], got[-1][:-1]
        cut = rest.size - params[2].size
        sums = [np.concatenate(got[:-1]).reshape(params[0].shape) if len(got) > 1 else np.zeros_like(params[0]), rest[:cut].reshape(params[1].shape).copy(), rest[cut:].copy()]
        for x, g, a, b in zip(params, sums, m, v):
            g /= n
            g += decay * x if x.ndim > 1 else 0
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + DAMPING)
    return params


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 24, rate: float = 0.1, seed: int = 7, labelled_docs: int = LABELLED_DOCS) -> Model:
    """The model of labels(id, subject) of docs for the listed subjects.

    At most labelled_docs labelled documents are used (chosen by hash). Labels
    that are null, unlisted or of unknown documents don't count. Without any
    label the model gives no subject to anything."""
    spark = docs.sparkSession
    names = sorted(r["subject"] for r in subjects.select("subject").filter("subject is not null").distinct().collect())
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)]) if names else None
    if not names:
        return Model([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, bool))
    some = labels.filter(F.col("subject").isin(names) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.sort_array(F.collect_set(number[F.col("subject")])).alias("labels"))
    scratch = Scratch(spark)
    some = scratch.keep(some.orderBy(F.xxhash64("key"), "key").limit(labelled_docs))
    partitions = max(2, some.count() // 2_500)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(some), "key").select("text", "labels", F.xxhash64("key").alias("doc"))
    data = scratch.keep(rows.mapInArrow(_prepare, "doc long, labels array<int>, features array<int>").repartition(partitions, "doc"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in data.mapInArrow(_doc_counts, "counts binary").collect():  # a row for each of the sample's partitions
        counts += np.frombuffer(r["counts"], np.int32)
    known = counts >= MIN_DOCS
    kinds = "doc long, labels array<int>, features array<int>"
    sentences_of = scratch.keep(data.mapInArrow(_compact(known), kinds))
    first = _descend(spark, sentences_of, len(names), int(known.sum()), rounds, rate, seed)
    teacher = spark.sparkContext.broadcast(first)
    kept = scratch.keep(sentences_of.mapInArrow(_borne_out(teacher, len(names), CHANCE), kinds))
    teacher.destroy()
    e, w, c = _descend(spark, kept, len(names), int(known.sum()), rounds, rate / 2, seed, start=first)
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    table[known] = e
    return Model(names, table, w, c, known)


def _score(state, names: list[str], chance: float, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, c, known = state.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                parts = [sentences(t) for t in part.column(1).to_pylist()]
                per = np.array([len(p) for p in parts])
                flat = [s for p in parts for s in p]
                counts = np.zeros((len(parts), len(names)))
                doc = np.repeat(np.arange(len(parts)), per)
                for a, z in K.chunks(flat):
                    b, o = features(flat[a:z])
                    about = _means(g, *_known(known, b, o), z - a)[0] + c > np.log(chance / (1 - chance))
                    np.add.at(counts, doc[a:z], about)
                d, s = np.nonzero((counts >= share * per[:, None]) & (per[:, None] > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([names[k] for k in s], pa.string())], ["id", "subject"])

    return run


def assign_subjects(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, share: float = 0.25) -> DataFrame:
    """id_col and subject: each subject that at least this share of a document's
    sentences are about; none for null, empty and blank texts. Repeated rows
    count once; null ids are left out; an empty input gives an empty frame."""
    # the model is linear: its embeddings are brought to the outputs beforehand
    shared = docs.sparkSession.sparkContext.broadcast((model.e @ model.w, model.c, model.known))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(shared, model.subjects, chance, share), f"id {kind}, subject string").distinct().withColumnRenamed("id", id_col)
