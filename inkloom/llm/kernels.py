"""Vectorised text kernels shared by the llm operators.

Texts of an Arrow batch are laid end to end as one array of code points, so
that every step is a handful of numpy passes over some hundred thousand
characters instead of a Python loop over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points with the Unicode property White_Space.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(12290, dtype=bool)
_SPACE[list(WHITE_SPACE)] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (two multiply-xorshift rounds)."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, end to end, and the length of each text."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def chunks(texts: list[str], chars: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters each (one text at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars or i - start >= 60_000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def is_space(cps: np.ndarray) -> np.ndarray:
    return _SPACE[np.minimum(cps, 12289)]


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(cps: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each position on; len(cps) - k + 1 values.

    A polynomial hash put together by doubling: the hash of 2n characters is
    that of the first n, shifted, plus that of the last n."""
    n = len(cps) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    level = mix(cps.astype(np.uint64))
    width, out, have, rest = 1, None, 0, k
    while rest:
        if rest & 1:
            part = level[have:]
            out = part if out is None else out[: len(part)] * _power(width) + part[: len(out)]
            have += width
        rest >>= 1
        if rest:
            level = level[:-width] * _power(width) + level[width:]
            width *= 2
    return mix(out[:n])


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of w values; len(x) - w + 1 values."""
    width = 1
    while width * 2 <= w:
        x = op(x[:-width], x[width:])
        width *= 2
    return op(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def winnow(cps: np.ndarray, lengths: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window of w
    k-grams. Any k + w - 1 equal characters within two texts select at least
    one equal k-gram in both. Grams never span two texts."""
    n = len(cps) - k + 1
    if n < w:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    h = gram_hashes(cps, k)
    h[doc[:n] != doc[k - 1 :]] = _MAX
    least = _slide(h, w, np.minimum)
    padded = np.zeros(n + w - 1, dtype=np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    chosen = (_slide(padded, w, np.maximum) == h) & (h != _MAX)
    at = np.flatnonzero(chosen)
    return at, h[at]


def strip_spaces(cps: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points without white space, and the new length of each text."""
    keep = ~is_space(cps)
    ends = np.cumsum(lengths)
    kept = np.concatenate(([0], np.cumsum(keep)))
    new = kept[ends] - kept[ends - lengths]
    return cps[keep], new


def shingle_sets(cps: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-character shingles of each text: index of the text, 48-bit hash
    and count, ordered by text and hash. At most 65,536 texts."""
    n = len(cps) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    inside = doc[:n] == doc[k - 1 :]
    key = (doc[:n] << np.uint64(48)) | (gram_hashes(cps, k) >> np.uint64(16))
    key = np.sort(key[inside])
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), tf


def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
    """Bin of a 48-bit hash; monotone in the hash."""
    return ((h >> np.uint64(16)) * np.uint64(bins)) >> np.uint64(32)


def _variates(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of each shingle, from its hash: r, c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    scale, low = 1.0 / (1 << 32), np.uint64(0xFFFFFFFF)
    a, b, c = mix(h, 1), mix(h, 2), mix(h, 3)
    unit = lambda x: (x.astype(np.float64) + 0.5) * scale
    r = -np.log(unit(a >> np.uint64(32)) * unit(a & low))
    gamma = -np.log(unit(b >> np.uint64(32)) * unit(b & low))
    return r, np.log(gamma), unit(c & low)


def _rotate(out: np.ndarray) -> None:
    """Empty bins of each row borrow the value of the next bin that isn't empty."""
    rows = np.flatnonzero((out == 0).any(axis=1) & (out != 0).any(axis=1))
    if not len(rows):
        return
    some, bins = out[rows], out.shape[1]
    at = np.where(some != 0, np.arange(bins), 3 * bins)
    twice = np.concatenate((at, at + bins), axis=1)  # a full bin beyond the end is one of the start
    ahead = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :bins]
    row, empty = np.nonzero(some == 0)
    full = ahead[row, empty]
    some[row, empty] = mix(some[row, full % bins], 5) + (full - empty).astype(np.uint64)
    out[rows] = some


def icws_signatures(doc: np.ndarray, h: np.ndarray, samples: list[tuple[np.ndarray | None, int]], docs: int) -> list[np.ndarray]:
    """Improved consistent weighted sampling, one sample in each of the bins
    that the shingle hashes are dealt to; docs x bins values for each of the
    samples (weights, bins); without weights all shingles weigh the same.

    Two texts get the same value in a bin with the probability of their
    weighted Jaccard similarity within it. A text's shingles are met once, not
    once per sample, and all weightings share their variates. An empty bin borrows the
    value of the next bin that isn't empty (rotation). doc and h ordered as by
    shingle_sets()."""
    every = [np.zeros((docs, bins), dtype=np.uint64) for _, bins in samples]
    if not len(h):
        return every
    r, ln_c, beta = _variates(h)
    for out, (weight, bins) in zip(every, samples):
        slot = doc * bins + bin_of(h, bins).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        sizes = np.diff(np.append(first, len(slot)))
        t = np.zeros(len(h)) if weight is None else np.floor(np.log(weight) / r + beta)
        ln_a = ln_c - r * (t - beta) - r
        win = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, first), sizes))
        out.reshape(-1)[slot[win]] = mix(h[win] ^ (t[win].astype(np.int64).view(np.uint64) << np.uint64(48)), 4) | np.uint64(1)
        _rotate(out)
    return every


def band_hashes(signatures: np.ndarray, rows: int, salt: int = 0) -> np.ndarray:
    """docs x bands: a hash of so many signature values each. Bands of another
    salt never meet these. The values of a band lie as far apart as they can:
    neighbours in a short text are often borrowed from the same bin."""
    docs, bins = signatures.shape
    bands = bins // rows
    x = signatures[:, : bands * rows].reshape(docs, rows, bands)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(salt << 32), (docs, bands)).copy()
    for i in range(rows):
        out = mix(out ^ x[:, i], 6)
    return out


def same_counts(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ordered arrays of distinct values."""
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))
