"""What the two exact substring operators share: winnowed seeds, and the exchange that tells repeated ones.

Every window of `window` values holds window - gram + 1 grams; the least hash among these is the window's
seed. Equal windows have equal seeds, so only windows whose seed occurs elsewhere can be repeated. Documents
are packed into compressed blocks. A block sends its distinct hashes, sorted and cut into ranges of the hash
space, as arrays; the range that receives them answers each array with a bit for each hash. A hash that a
third of all documents hold is one value in each block, so no task sees more of it than there are blocks.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm._shared import U, grams, make_room, ranges_of, sliding

SENT = "part int, block int, hashes binary, flags binary"
ANSWER = "block int, step int, part int, bits binary"


def seeds(sums: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The seed of each window that starts here (0 where none fits), the grams' hashes, and which grams are seeds.

    sums are prefix sums of values; bounds are the documents' bounds in values.
    """
    n, width = len(sums) - 1, window - gram + 1
    g = grams(sums, gram)
    g[g == 0] = U(1)
    low = sliding(g, width, np.minimum)
    late = (bounds[1:, None] - np.arange(1, window)).ravel()  # begin in a document, or in one before it, and end after it
    low[late[(late >= 0) & (late < len(low))]] = U(0)
    room = np.zeros(n + width, np.uint64)
    room[width - 1 : width - 1 + len(low)] = low
    most = sliding(room, width, np.maximum)[: len(g)]
    return low, g, (most == g) & (most > 0)


def distinct(hashes: np.ndarray, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them occur twice here (in two owners, if these are given, which must ascend)."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    if owners is None:
        many = np.diff(np.r_[at, len(h)]) > 1
    else:
        o = owners[order]
        last = np.r_[at[1:], len(h)] - 1 if len(h) else at
        many = o[last] != o[at]
    return h[at], many


def sends(block: int, values: np.ndarray, many: np.ndarray, parts: int) -> pa.Table:
    """Rows of SENT: a block's sorted hashes, cut into ranges; many marks those that occur twice in the block itself."""
    cut = ranges_of(values, parts)
    rows = [(k, block, values[a:b].tobytes(), np.packbits(many[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "block", "hashes", "flags"])


def answers(sent: DataFrame, step: int) -> DataFrame:
    """Rows of ANSWER: for each array sent, which of its hashes occur twice or more in all."""

    def run(rows: pa.Table) -> pa.Table:
        make_room()
        blocks, parts = rows["block"].to_pylist(), rows["part"].to_pylist()
        arrays = [np.frombuffer(b, np.uint64) for b in rows["hashes"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(a)) for f, a in zip(rows["flags"].to_pylist(), arrays)]
        h = np.concatenate(arrays)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.r_[True, s[1:] != s[:-1]]
        group = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        many = (np.diff(np.r_[at, len(s)]) > 1) | (np.add.reduceat(np.concatenate(flags)[order].astype(np.int64), at) > 0)
        out = np.empty(len(h), np.uint8)
        out[order] = many[group]
        ends = np.cumsum([len(a) for a in arrays])
        bits = [np.packbits(out[a:b]).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
        return pa.table([pa.array(blocks, pa.int32()), pa.array([step] * len(blocks), pa.int32()), pa.array(parts, pa.int32()), pa.array(bits, pa.binary())], ["block", "step", "part", "bits"])

    return sent.groupBy("part").applyInArrow(run, ANSWER)


def told(replies: pa.Table, step: int, values: np.ndarray, parts: int) -> np.ndarray:
    """The answer for each of the sorted values that a block sent."""
    cut, out = ranges_of(values, parts), np.zeros(len(values), bool)
    for s, k, bits in zip(replies["step"].to_pylist(), replies["part"].to_pylist(), replies["bits"].to_pylist()):
        if s == step:
            a, b = cut[k], cut[k + 1]
            out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return out


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among the values; runs of equal x are looked up once."""
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    first = np.r_[True, x[1:] != x[:-1]]
    at = np.flatnonzero(first)
    some = x[at]
    k = np.minimum(np.searchsorted(sorted_values, some), len(sorted_values) - 1)
    return np.repeat(sorted_values[k] == some, np.diff(np.r_[at, len(x)]))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of width that begins at one of starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


