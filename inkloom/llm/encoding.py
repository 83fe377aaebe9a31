"""Encoding of a corpus with a public byte-pair tokenizer.

The frequent words of the corpus are compiled, with their ids, into a minimal
acyclic automaton: words share prefixes and suffixes, and the number of a word
among all, which the automaton yields on the way through it, says where its
ids are. The automaton is a few flat arrays in the folder all executors share,
mapped into memory by each worker. Words it doesn't hold are merged exactly.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Words in the lexicon at most. A word left out costs time, never a wrong id.
LEXICON_WORDS = 60_000
TOKENIZERS = "/opt/tokenizers"


class Lexicon:
    """A minimal acyclic automaton over bytes; word i has ids[offsets[i]:offsets[i + 1]].

    edges are ordered by state and byte: key = state * 256 + byte, to = next
    state, skipped = words that come before those beyond this edge; a state is
    accepting if accepts[state]."""

    FIELDS = ("keys", "to", "skipped", "accepts", "offsets", "ids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__ |= arrays

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        order = sorted(words)
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []
        sizes: list[int] = []
        path: list[list] = [[False, []]]  # unfinished states: accepting, edges

        def close(down_to: int) -> None:
            while len(path) - 1 > down_to:
                accepting, edges = path.pop()
                key = (accepting, tuple(edges))
                if key not in register:
                    register[key] = len(states)
                    states.append(key)
                    sizes.append(accepting + sum(sizes[t] for _, t in edges))
                path[-1][1][-1] = (path[-1][1][-1][0], register[key])

        last = b""
        for w in order:
            same = len(os.path.commonprefix([w, last]))
            close(same)
            for c in w[same:]:
                path[-1][1].append((c, -1))
                path.append([False, []])
            path[-1][0] = True
            last = w
        close(0)
        states.append((path[0][0], tuple(path[0][1])))
        root = len(states) - 1
        number = lambda s: 0 if s == root else s + 1  # noqa: E731 - the root is state 0
        edges = []
        for s, (accepting, out) in enumerate(states):
            before = int(accepting)
            for c, t in out:
                edges.append((number(s) * 256 + c, number(t), before))
                before += sizes[t]
        edges.sort()
        e = np.array(edges, dtype=np.int64).reshape(-1, 3)
        accepts = np.zeros(len(states), dtype=bool)
        accepts[[number(s) for s, (a, _) in enumerate(states) if a]] = True
        ids = [words[w] for w in order]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        return cls(keys=e[:, 0].copy(), to=e[:, 1].astype(np.int32), skipped=e[:, 2].astype(np.int32), accepts=accepts, offsets=offsets, ids=np.array([i for x in ids for i in x], dtype=np.int32))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those not held; all words advance
        together, a byte at a time."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.keys):
            return out
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        starts = np.cumsum(lengths) - lengths
        live, state, number, depth = np.flatnonzero(lengths > 0), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            key = state[live] * 256 + data[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            live, at = live[good], at[good]
            number[live] += self.skipped[at]
            state[live] = self.to[at]
            depth += 1
            done = lengths[live] == depth
            ended = live[done]
            ok = self.accepts[state[ended]]
            out[ended[ok]] = number[ended[ok]]
            live = live[~done]
        return out

    def save(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for f in self.FIELDS:
            np.save(f"{folder}/{f}.npy", getattr(self, f))

    @classmethod
    def load(cls, folder: str) -> Lexicon:
        return cls(**{f: np.load(f"{folder}/{f}.npy", mmap_mode="r") for f in cls.FIELDS})


@functools.cache
def tokenizer(folder: str, name: str):
    """(pattern of words, encoder) of <name>.tiktoken in the tokenizers' folder."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    return regex.compile(pattern), tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count_words(folder: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, _ = tokenizer(folder, name)
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(pattern.findall(t))
            if len(counts) > 500_000:  # what a bounded summary may forget: words met once
                counts = Counter({w: n for w, n in counts.items() if n > 1})
        often = [(w, n) for w, n in counts.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"])

    return run


def frequent_words(texts: DataFrame, folder: str, name: str, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most so many. A word counts where
    a partition holds it more than once."""
    counts = texts.mapInArrow(_count_words(folder, name), "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "word").limit(words)
    return [r["word"] for r in top.collect()]


@functools.lru_cache(maxsize=2)
def _mapped(folder: str) -> Lexicon:
    return Lexicon.load(folder)


def _encode(folder: str, name: str, where: str | None, shared, sizes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, encoder = tokenizer(folder, name)
        lexicon = _mapped(where) if where else Lexicon(**shared.value)
        merged: dict[str, list[int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                index: dict[str, int] = {}
                of_word: list[int] = []
                per_text = np.zeros(part.num_rows, dtype=np.int64)
                for i, t in enumerate(part.column(1).to_pylist()):
                    if t:
                        found = pattern.findall(t)
                        per_text[i] = len(found)
                        of_word += [index.setdefault(w, len(index)) for w in found]
                words = list(index)
                number = lexicon.numbers([w.encode("utf-8", "surrogatepass") for w in words])
                held = number >= 0
                length = np.zeros(len(words), dtype=np.int64)
                length[held] = lexicon.offsets[number[held] + 1] - lexicon.offsets[number[held]]
                new: list[int] = []
                if len(merged) > 200_000:
                    merged.clear()
                start = np.zeros(len(words), dtype=np.int64)
                start[held] = lexicon.offsets[number[held]]
                for k in np.flatnonzero(~held).tolist():
                    w = words[k]
                    ids = merged.get(w)
                    if ids is None:
                        ids = merged[w] = encoder._encode_single_piece(w.encode("utf-8", "surrogatepass"))
                    length[k], start[k] = len(ids), len(lexicon.ids) + len(new)
                    new += ids
                which = np.array(of_word, dtype=np.int64)
                each = length[which]
                upto = np.concatenate(([0], np.cumsum(each)))
                ends = upto[np.concatenate(([0], np.cumsum(per_text)))]
                if sizes_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends))], ["id", "n_tokens"])
                    continue
                pool = np.concatenate((np.asarray(lexicon.ids), np.array(new, dtype=np.int32)))
                flat = pool[np.repeat(start[which] - upto[:-1], each) + np.arange(upto[-1])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["id", "ids"])

    return run


def _ready(spark: SparkSession, texts: DataFrame, folder: str, name: str) -> tuple[str | None, object]:
    """The compiled lexicon: its folder where the shared one is a mounted file
    system, else a broadcast of its arrays (a few MB, bounded by LEXICON_WORDS)."""
    _, encoder = tokenizer(folder, name)
    words = [w.encode("utf-8", "surrogatepass") for w in frequent_words(texts, folder, name)]
    lexicon = Lexicon.build({w: encoder._encode_single_piece(w) for w in words if w})
    base = Scratch(spark).base
    if base.startswith("file:"):
        at = f"{base.removeprefix('file://').removeprefix('file:')}/lexicon"
        lexicon.save(at)
        return at, None
    return None, spark.sparkContext.broadcast({f: getattr(lexicon, f) for f in Lexicon.FIELDS})


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_col and ids (list of integers), one row per row of df, by the named
    tokenizer of the folder, without special tokens (their strings are ordinary
    text). Null and empty texts have an empty list; null ids and repeated rows
    are kept; an empty input gives an empty frame."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    where, shared = _ready(df.sparkSession, rows.select("text"), folder, name)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(folder, name, where, shared, False), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """id_col and n_tokens, as encode() with only the number of ids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    where, shared = _ready(df.sparkSession, rows.select("text"), folder, name)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_encode(folder, name, where, shared, True), f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
