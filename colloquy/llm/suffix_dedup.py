"""Removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A window of WINDOW bytes goes by its seed (see `repeats`), so all windows with equal contents meet in one
place, and windows whose seed is in one document only are settled. Windows in a row with one seed travel as
one fragment, the bytes that they span. Where all fragments of a seed are equal, the smallest document id
decides. The different fragments of a seed are indexed together: on their Burrows-Wheeler transform the
intervals of strings of length 1, 2, 3 ... are found breadth first by backward extension, intervals of a
single suffix are dropped, and at WINDOW the expansion stops. An interval left holds the places of one
repeated string, and the smallest id among them decides about each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._shared import BYTE_VALUES, NO_ID, U, by_key, blocks_for, checkpoint, expand, make_room, packed, pieces, prefix, ranges_of, ready, release, spans, squeeze, table, unpacked
from colloquy.llm.repeats import ANSWER, SENT, answers, distinct, member, seeds, sends, told

WINDOW, GRAM = 50, 20
#: Bytes of text in a block, of text for each range of hashes, and of fragments in one transform.
BLOCK, PART, INDEX = 3 << 19, 4 << 20, 1 << 19
#: Windows of fragments of equal contents that are decided at once.
COPIES = 1 << 18
_FRAGMENTS = "part int, block int, seeds binary, ids binary, sizes binary, texts binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, stop: long>>, kept binary"


def suffix_order(text: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their suffixes, by length characters at least; a suffix ends at its stop, where text is 0."""
    n, depth = len(text), 7
    rank = np.zeros(n, np.int64)
    wide = np.concatenate([text.astype(np.int64), np.zeros(depth, np.int64)])
    left = stop - np.arange(n)
    for k in range(depth):
        rank = rank << 9 | np.where(left > k, wide[k : n + k], 0)
    while True:
        order = np.argsort(rank)
        if depth >= length:
            return order
        s = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[False, s[1:] != s[:-1]])
        more = np.zeros(n, np.int64)
        more[: n - depth] = fresh[depth:] + 1
        rank = fresh * (n + 1) + np.where(left > depth, more, 0)
        depth *= 2


def intervals(text: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, interval) of the places where a string of length begins that begins in another place too.

    text holds strings, each with a 0 at its end, which stop gives for each place. A step of backward extension
    takes the members of an interval to the places one letter before: those with one letter are an interval of
    the next length. A place with too little of its string before it to reach length is left out from the start.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(text, stop, length)
    row_of = np.empty(n, np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    place = np.arange(n)
    begin = np.r_[0, np.flatnonzero(text == 0) + 1][np.searchsorted(np.flatnonzero(text == 0), place)]
    some = place[(text > 0) & (place - begin >= length - 1)]
    at = np.sort(row_of[some])
    places = order[at].astype(np.int32)
    letters = text[places]
    new = np.r_[True, letters[1:] != letters[:-1]] if len(at) else np.zeros(0, bool)
    label = np.full(n, -1, np.int32)
    for size in range(1, length + 1):
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(places)])
        places = places[np.repeat(count > 1, count)]
        count = count[count > 1]
        if not len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        interval = np.repeat(np.arange(len(count), dtype=np.int32), count)
        if size == length:
            return places.astype(np.int64), interval
        to = row_of[places - 1]
        label[to] = interval
        at = np.sort(to)
        interval = label[at]
        places = order[at].astype(np.int32)
        letters = text[places]
        new = np.r_[True, (interval[1:] != interval[:-1]) | (letters[1:] != letters[:-1])]


class _Block:
    """The bytes and seeds of a block's documents."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        make_room()  # the block before is gone
        self.ids, self.data, self.off = unpacked(rows)
        self.window, self.width = window, window - gram + 1
        self.sums = prefix(BYTE_VALUES[self.data])
        self.low, g, chosen = seeds(self.sums, self.off, gram, window)
        at = np.flatnonzero(chosen)
        owner = np.searchsorted(self.off, at, "right") - 1
        self.seeds, self.many = distinct(g[at], self.ids[owner])

    def fragments(self, replies: pa.Table, parts: int):
        """Starts, ends, owners and seeds of all fragments, and the entry of each: distinct (seed, contents), the first owner's."""
        at = np.flatnonzero(member(self.seeds[told(replies, 0, self.seeds, parts)], self.low))
        owner = np.searchsorted(self.off, at, "right") - 1
        seed = self.low[at]
        new = np.r_[True, (np.diff(at) != 1) | (owner[1:] != owner[:-1]) | (seed[1:] != seed[:-1])] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        first = np.flatnonzero(nth % self.width == 0) if len(at) else first  # a long run is cut
        last = np.r_[first[1:], len(at)] - 1
        start, end = at[first], at[last] + self.window if len(at) else at[first]
        owner, seed = owner[first], seed[first]
        text = spans(self.sums, start, end)
        order = np.lexsort((text, seed))
        changed = np.r_[True, (seed[order][1:] != seed[order][:-1]) | (text[order][1:] != text[order][:-1])] if len(order) else np.zeros(0, bool)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(changed) - 1
        return start, end, owner, seed, entry, order[changed]  # places ascend, and so do owners: the first is the smallest


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return data[at]


def _decide(seed: np.ndarray, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """For each fragment, a bit for each of its windows: a smaller id has it."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.empty(len(sizes), np.uint64)
    for i, j in pieces(np.r_[0, ends], INDEX):
        at = starts[i]
        text[i:j] = spans(prefix(BYTE_VALUES[data[at : ends[j - 1]]]), starts[i:j] - at, ends[i:j] - at)
    order = np.lexsort((ids, text, seed))
    s, t = seed[order], text[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    rep = order[new]  # one fragment of each contents, with the smallest id
    n_windows = sizes - window + 1
    full = (U(1) << n_windows.astype(np.uint64)) - U(1)
    out = np.where(ids[rep][kind] < ids, full, U(0))
    # seeds with several contents: smaller ids may hold single windows of a fragment
    rs = seed[rep]
    several = np.r_[False, rs[1:] == rs[:-1]] if len(rs) else np.zeros(0, bool)
    several[:-1] |= several[1:].copy()
    ask = np.flatnonzero(several)
    if not len(ask):
        return out
    # a few seeds at a time, never parting the fragments of one
    total = np.cumsum(sizes[rep[ask]] + 1)
    cut, lo = [0], 0
    edge = np.flatnonzero(np.r_[True, rs[ask][1:] != rs[ask][:-1]])
    for e in edge[1:]:
        if total[e - 1] - lo > INDEX:
            cut.append(int(e))
            lo = total[e - 1]
    by_kind = np.argsort(kind, kind="stable")
    kinds = kind[by_kind]
    for a, b in zip(cut, [*cut[1:], len(ask)]):
        some = rep[ask[a:b]]
        size = sizes[some] + 1
        base = np.cumsum(size) - size
        joined = np.zeros(size.sum(), np.int32)
        at = np.repeat(base - (np.cumsum(sizes[some]) - sizes[some]), sizes[some]) + np.arange(sizes[some].sum())
        joined[at] = _joined(data, starts[some], ends[some]).astype(np.int32) + 1
        place, interval = intervals(joined, np.repeat(base + size - 1, size), window)
        if not len(place):
            continue
        which = np.searchsorted(base + size, place, "right")
        first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        least = np.minimum.reduceat(ids[some][which], first)[interval]
        bit = U(1) << (place - base[which]).astype(np.uint64)
        # each fragment of these contents compares by its own id
        entry = ask[a:b][which]
        lo, hi = np.searchsorted(kinds, entry, "left"), np.searchsorted(kinds, entry, "right")
        for x, y in pieces(np.r_[0, np.cumsum(hi - lo)], COPIES):
            many = hi[x:y] - lo[x:y]
            frag = by_kind[np.repeat(lo[x:y], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            hit = np.repeat(least[x:y], many) < ids[frag]
            np.bitwise_or.at(out, frag[hit], np.repeat(bit[x:y], many)[hit])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed), kept (the other bytes) of every row.

    A null text is empty; texts of fewer than window bytes lose none. Rows with equal ids do not remove each
    other's bytes, since neither id is smaller. A null id counts as greater than all others, and stays null.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = blocks_for(docs, "text", BLOCK, 16)
    parts = max(16, n * BLOCK // PART)

    def blocks() -> DataFrame:
        return packed(docs, n)

    def send_seeds(key: tuple, rows: pa.Table) -> pa.Table:
        b = _Block(rows, window, gram)
        return sends(key[0].as_py(), b.seeds, b.many, parts)

    first = checkpoint(answers(blocks().groupBy("block").applyInArrow(send_seeds, SENT), 0))
    release(spark)

    def send_fragments(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(rows, window, gram)
        start, end, owner, seed, _, entries = b.fragments(replies, parts)
        cut, out = ranges_of(seed[entries], parts), []
        for k, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
            if y > x:
                e = entries[x:y]
                out.append((k, key[0].as_py(), seed[e].tobytes(), squeeze(b.ids[owner[e]]), (end[e] - start[e]).astype(np.int32).tobytes(), squeeze(_joined(b.data, start[e], end[e]))))
        cols = list(zip(*out)) if out else [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["part", "block", "seeds", "ids", "sizes", "texts"])

    def decide(rows: pa.Table) -> pa.Table:
        make_room()
        seed = [np.frombuffer(x, np.uint64) for x in rows["seeds"].to_pylist()]
        ids = [expand(x, np.int64) for x in rows["ids"].to_pylist()]
        sizes = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["sizes"].to_pylist()]
        data = [expand(x) for x in rows["texts"].to_pylist()]
        masks = _decide(*(np.concatenate(x) for x in (seed, ids, sizes, data)), window)
        ends = np.cumsum([len(x) for x in seed])
        bits = [squeeze(masks[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends)]
        return pa.table([rows["block"], pa.array([1] * len(bits), pa.int32()), rows["part"], pa.array(bits, pa.binary())], ["block", "step", "part", "bits"])

    second = checkpoint(by_key(blocks(), first, "block", send_fragments, _FRAGMENTS).groupBy("part").applyInArrow(decide, ANSWER))
    release(spark)

    def finish(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(rows, window, gram)
        start, end, owner, seed, entry, entries = b.fragments(replies, parts)
        b.low = b.sums = None
        masks, cut = np.zeros(len(entries), np.uint64), ranges_of(seed[entries], parts)
        for s, k, z in zip(replies["step"].to_pylist(), replies["part"].to_pylist(), replies["bits"].to_pylist()):
            if s == 1:
                masks[cut[k] : cut[k + 1]] = expand(z, np.uint64)
        n_windows = end - start - window + 1
        mask = masks[entry] if len(entry) else masks
        smaller = b.ids[owner[entries[entry]]] < b.ids[owner] if len(entry) else np.zeros(0, bool)  # an earlier document of this block has it
        step = np.zeros(len(b.data) + 1, np.int32)
        for x, y in pieces(np.r_[0, np.cumsum(n_windows)], COPIES):
            many = n_windows[x:y]
            frag = np.repeat(np.arange(x, y), many)
            nth = np.arange(len(frag)) - np.repeat(np.cumsum(many) - many, many)
            gone = smaller[frag] | ((mask[frag] >> nth.astype(np.uint64)) & U(1)).astype(bool)
            at = (start[frag] + nth)[gone]
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
        removed = np.cumsum(step[:-1], dtype=np.int32) > 0
        out = []
        for i, (lo, hi) in enumerate(zip(b.off[:-1], b.off[1:])):
            own = removed[lo:hi]
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            kept = b.data[lo:hi] if not len(edge) else b.data[lo:hi][~own]
            out.append((None if b.ids[i] == NO_ID else int(b.ids[i]), int(hi - lo), int(own.sum()), len(edge) // 2, [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])], kept.tobytes()))
        cols = list(zip(*out)) if out else [[]] * 6
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, span, pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return by_key(blocks(), first.unionByName(second), "block", finish, _OUT)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
