"""Benchmark decontamination: CGK walks, bit-sampling tables over item-sized windows, exact edit distance.

Texts are compared as lower-cased bytes in which every run of other than letters, digits and non-ASCII
bytes is one space. A window begins at each word of a text, and at each word of an item that has room for it.
A CGK walk reads a window: a random function of step and byte says whether to go on to the next byte or to
read this one again, so two windows that are a few edits apart fall into step again and again, and edit
distance becomes Hamming distance. Tables keep a few sampled steps of a walk as a key; windows that share a
key in any table, and agree on enough steps of one walk, are candidates. Walks and tables are repeated until
copies at the full RATE are found (measured recall is in the README). What surrounds a candidate is searched,
bit-parallel, for the exact edit distance, which alone decides.

Items under WALK bytes are too short to be sampled. They are found by the grams that a copy must keep, counted
by shift (the q-gram lemma), which loses none.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._shared import BYTE_VALUES, LOWER, U, buffers, grams, pieces, prefix, ready, table, trimmed

#: Edits for each byte of an item up to which a window counts as a copy.
RATE = 0.15
#: Lengths of seeds, and how many of them an item should keep after so many edits for its seeds to be that long.
SEEDS, LEAST = (3, 4, 5, 6), 24
SLOTS, STRETCH = 1 << 19, 1 << 17
#: Shorter items (in normal form) are compared with the spaces around them, so that they match whole words.
SHORT = 40
#: Shorter items are found by grams. Windows have the greatest of these sizes that an item is twice as long as.
WALK, SIZES = 80, (40, 80)
#: Steps of a walk over a window of each size, and the share of one walk's steps on which a candidate agrees.
STEPS, AGREE = {n: 3 * n // 2 for n in SIZES}, {40: 0.6, 80: 0.5}
#: Walks, and tables for each walk and size.
WALKS, TABLES = 2, 16
#: Windows at once, and slots for each key, which are asked before a table is searched: a slot has a few more bits of its key, or SEVERAL.
CHUNK, SLOTS_EACH, SEVERAL = 1 << 14, 16, 255
#: Steps on which unrelated windows agree, and chance candidates of a window in all tables: they set how many steps a key has.
BY_CHANCE, CHANCE = 0.14, 0.02
_RNG = np.random.default_rng(20250607)
_GO_ON = _RNG.integers(0, 2, (WALKS, STEPS[SIZES[-1]], 256)).astype(np.int64)
#: For each byte: itself, and above it whether to go on at each of so many steps.
_AHEAD = 23
_WORDS = np.stack([[np.arange(256) + sum(_GO_ON[w, lo + j] << (8 + j) for j in range(min(_AHEAD, STEPS[SIZES[-1]] - lo))) for lo in range(0, STEPS[SIZES[-1]], _AHEAD)] for w in range(WALKS)]).astype(np.int32)
_ORDER = np.stack([_RNG.permutation(STEPS[n])[: STEPS[SIZES[0]]] for _ in range(WALKS * TABLES) for n in SIZES]).reshape(WALKS, TABLES, len(SIZES), -1)
#: Items that are broadcast at once; a longer benchmark is read in blocks of so many.
ITEMS = 20_000
_NORMAL = LOWER.copy()
_NORMAL[[i for i in range(128) if not chr(i).isalnum()]] = 32


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal form of texts, its offsets, and the place in data of each byte kept."""
    out = _NORMAL[data]
    keep = np.ones(len(out), bool)
    space = out == 32
    keep[1:] = ~(space[1:] & space[:-1])
    first = offsets[:-1][np.diff(offsets) > 0]
    keep[first] = ~space[first]
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, offsets), at


def edit_search(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of item to any part of text, and where the first such part ends (Myers)."""
    m = len(item)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def copies(item: bytes, text: bytes, limit: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance) of disjoint parts of text[lo:hi] within limit edits of item, the nearest one first."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < len(item) - limit:
            continue
        distance, end = edit_search(item, text[lo:hi])
        if distance > limit or not end:
            continue
        _, back = edit_search(item[::-1], text[lo : lo + end][::-1])
        start, end = lo + end - back, lo + end
        yield start, end, distance
        todo += [(lo, start), (end, hi)]


def begins(text: np.ndarray) -> np.ndarray:
    """Where windows begin: at every word, at every sign of three or more bytes (scripts without spaces), and at every
    byte from the 25th on of a run without a space."""
    edge = np.diff(np.r_[False, text != 32, False].astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = np.flatnonzero(last - first > 24)
    every = text >= 0xE0
    every[first] = True
    for a, z in zip(first[long].tolist(), last[long].tolist()):
        every[a + 24 : z] = True
    return np.flatnonzero(every)


def walked(text: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """[walk, step, window]: the bytes that the walks read; starts rise, and text must go on for steps bytes after the last one."""
    out = np.empty((WALKS, steps, len(starts)), np.uint8)
    if not len(starts):
        return out
    text, word, go = text[starts[0] : starts[-1] + steps].astype(np.int64), np.empty(len(starts), np.int32), np.empty(len(starts), np.int32)
    for w in range(WALKS):
        at = (starts - starts[0]).astype(np.int64)
        for lo in range(0, steps, _AHEAD):
            words = _WORDS[w, lo // _AHEAD].take(text, mode="clip")
            for j in range(min(_AHEAD, steps - lo)):
                np.take(words, at, out=word, mode="clip")
                out[w, lo + j] = word  # its lowest byte
                np.right_shift(word, 8 + j, out=go)
                np.bitwise_and(go, 1, out=go)
                np.add(at, go, out=at)
    return out


class Windows:
    """Tables over the windows of a block of items."""

    def __init__(self, forms: list[bytes], own: list[int]):
        self.classes, sized = [], [[i for i in own if n == max(x for x in SIZES if 2 * x <= len(forms[i]))] for n in SIZES]
        some = [(k, n, items) for k, (n, items) in enumerate(zip(SIZES, sized)) if items]
        self.steps = max((STEPS[n] for _, n, _ in some), default=0)
        for k, n, items in some:
            item, offset, read = [], [], []
            for i in items:
                text = np.frombuffer(forms[i], np.uint8)
                at = begins(text)
                at = at[at <= max(0, len(text) - n)]
                padded = np.r_[text, np.full(STEPS[n], 32, np.uint8)]
                item.append(np.full(len(at), i))
                offset.append(at)
                read.append(walked(padded, at, STEPS[n]))
            item, offset, read = np.concatenate(item), np.concatenate(offset), np.concatenate(read, axis=2)
            length = int(np.ceil(np.log(len(item) * WALKS * TABLES / CHANCE) / -np.log(BY_CHANCE)))
            sampled = np.sort(_ORDER[:, :, k, : max(8, length)], axis=2)
            tables, bits = [], max(16, (SLOTS_EACH * len(item)).bit_length())
            for w in range(WALKS):
                key = self.keys(read[w], sampled[w])
                slots = np.zeros(TABLES << bits, np.uint8)
                for t in range(TABLES):
                    at, tag = (key[t] >> U(64 - bits)).astype(np.int64) + (t << bits), self.tags(key[t], bits)
                    slots[at] = tag
                    slots[at[slots[at] != tag]] = SEVERAL
                key = self.in_table(key, np.arange(TABLES)[:, None]).ravel()
                order = np.argsort(key, kind="stable")
                tables.append((sampled[w], bits, slots, key[order], order % len(item)))
            self.classes.append((STEPS[n], AGREE[n] * STEPS[n], item, offset, read, tables))

    @staticmethod
    def keys(read: np.ndarray, sampled: np.ndarray) -> np.ndarray:
        """[table, window]: one value for the bytes that each window shows at a table's sampled steps, eight at least; its top bits are mixed."""
        packed = np.empty((len(sampled), read.shape[1], 8), np.uint8)
        for t, steps in enumerate(sampled[:, :8].tolist()):
            for i, k in enumerate(steps):
                packed[t, :, i] = read[k]
        key = packed.view(np.uint64)[:, :, 0] * U(0x9E3779B97F4A7C15)
        for k in range(8, sampled.shape[1]):
            key ^= read[sampled[:, k]]
            key *= U(0xBF58476D1CE4E5B9)
        return key

    @staticmethod
    def tags(key: np.ndarray, bits: int) -> np.ndarray:
        """What a slot says of a key: the bits after those that number the slot; neither 0, which is none, nor SEVERAL."""
        return ((key >> U(56 - bits) & U(255)) % U(SEVERAL - 1) + U(1)).astype(np.uint8)

    @staticmethod
    def in_table(key: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Keys in an order of tables; those that differ in their lowest bits only come as one, which can only add candidates."""
        return key >> U(TABLES.bit_length()) | table.astype(np.uint64) << U(64 - TABLES.bit_length())

    def candidates(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place of its first byte, as far as one can say): windows of text that a table joins to an item's."""
        starts = begins(text)
        padded = np.r_[text, np.full(self.steps, 32, np.uint8)]
        for lo in range(0, len(starts) if self.steps else 0, CHUNK):
            at = starts[lo : lo + CHUNK]
            read = walked(padded, at, self.steps)
            for steps, least, item, offset, known, tables in self.classes:
                pairs = []
                for w, (sampled, bits, slots, keys, order) in enumerate(tables):
                    key = self.keys(read[w], sampled)
                    slot = (key >> U(64 - bits)).view(np.int64)
                    slot += (np.arange(TABLES) << bits)[:, None]
                    tag = slots.take(slot.ravel(), mode="wrap")
                    some = np.flatnonzero(tag != 0)
                    key, tag = key.ravel()[some], tag[some]
                    same = (tag == SEVERAL) | (tag == self.tags(key, bits))
                    table, here = np.divmod(some[same], len(at))
                    key = self.in_table(key[same], table)
                    first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    many = last - first
                    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    pairs.append(np.repeat(here, many) << 32 | order[np.repeat(first, many) + nth])
                pairs = np.unique(np.concatenate(pairs))
                for a in range(0, len(pairs), 1 << 12):
                    here, there = pairs[a : a + (1 << 12)] >> 32, pairs[a : a + (1 << 12)] & 0xFFFFFFFF
                    agree = (read[:, :steps].take(here, axis=2) == known.take(there, axis=2)).sum(axis=1, dtype=np.uint8).max(axis=0) >= least
                    yield from zip(item[there[agree]].tolist(), (at[here[agree]] - offset[there[agree]]).tolist())


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]]):
        raw = [(t or "").encode() for _, t in items]
        off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
        data, off, _ = normal(np.frombuffer(b"".join(raw), np.uint8), off)
        forms = [data[off[i] : off[i + 1]].tobytes().rstrip() for i in range(len(items))]
        self.ids = [i for i, _ in items]
        self.limit = np.array([int(RATE * len(s)) for s in forms], np.int64)
        self.forms = [b" " + s + b" " if 0 < len(s) < SHORT else s for s in forms]
        self.walks = Windows(self.forms, [i for i, f in enumerate(self.forms) if len(f) >= WALK])
        total = sum(len(f) for f in self.forms if len(f) < WALK)
        # so many bytes of text at once that seeds make a bounded number of hits
        self.stretch = max(1 << 12, STRETCH * 40_000 // max(total, 40_000))
        self.lap = max((2 * len(f) + 4 for f in self.forms if len(f) < WALK), default=0)
        self.own_grams: dict[int, np.ndarray] = {}
        self.marks = np.zeros(SLOTS, bool)
        self.seeds = []
        for q in sorted(SEEDS, reverse=True):
            own = np.array([i for i, s in enumerate(self.forms) if 0 < len(s) < WALK and self.gram(i) == q], np.int64)
            if len(own):
                keys = np.concatenate([self.slots(np.frombuffer(self.forms[i], np.uint8), q) for i in own])
                size = np.array([len(self.forms[i]) for i in own])
                order = np.argsort(keys, kind="stable")
                start = np.zeros(SLOTS + 1, np.int32)
                np.cumsum(np.bincount(keys, minlength=SLOTS), out=start[1:])
                item = np.repeat(np.arange(len(own)), size - q + 1)[order]
                offset = np.concatenate([np.arange(n - q + 1) for n in size])[order]
                width = self.limit[own] + 2  # one more than limits need, for rounding
                first = np.r_[0, np.cumsum((self.stretch + 2 * self.lap + size) // width + 3)]  # an empty bucket at each end
                inverse = (1 / width)[item].astype(np.float32)
                self.seeds.append((q, own, start, offset, (first[:-1][item] + 1).astype(np.int32), inverse, ((size[item] - offset) / width[item]).astype(np.float32), width, size, first))

    def least(self, i: int, q: int) -> int:
        """Grams of q bytes that an item keeps after limit edits, as an edit changes q of them at most."""
        return len(self.forms[i]) - q + 1 - int(self.limit[i]) * q

    def gram(self, i: int) -> int:
        """The longest gram of which an item keeps several, or else some."""
        return next((q for enough in (LEAST, 1) for q in sorted(SEEDS, reverse=True) if self.least(i, q) >= enough))

    @staticmethod
    def slots(text: np.ndarray, q: int) -> np.ndarray:
        """A slot for each gram; grams that share a slot can only add windows."""
        return (grams(prefix(BYTE_VALUES[text]), q) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def may_hold(self, i: int, text: np.ndarray) -> bool:
        """Whether text has so many grams of an item that is sampled that a copy is possible (the q-gram lemma): false where none is."""
        if i not in self.own_grams:
            self.own_grams[i] = self.slots(np.frombuffer(self.forms[i], np.uint8), SEEDS[0])
        there = self.slots(text, SEEDS[0])
        self.marks[there] = True
        kept = np.count_nonzero(self.marks[self.own_grams[i]])
        self.marks[there] = False
        return kept >= self.least(i, SEEDS[0])

    def windows(self, text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end): parts of text that keep enough grams of an item at offsets that limit edits allow.

        The grams that a copy keeps lie at shifts that differ by limit at most, so in two neighbouring
        buckets; the counts of the two are added. Neighbouring windows come as one. A gram
        that repeats counts only as often as text and item both have it there.
        """
        for q, own, start, offset, base, inverse, ahead, width, size, first in self.seeds:
            h = self.slots(text, q)
            low = start[h]
            many = start[h + 1] - low
            total = int(many.sum())
            if not total:
                continue
            low -= np.cumsum(many, dtype=np.int32) - many
            hit = np.repeat(low, many)
            hit += np.arange(total, dtype=np.int32)
            place = np.repeat(np.arange(len(h), dtype=np.float32), many)
            key = inverse[hit]
            key *= place
            key += ahead[hit]
            key = key.astype(np.int32)
            key += base[hit]
            count = np.bincount(key, minlength=first[-1] + 1)
            least = np.array([self.least(i, q) for i in own])
            pair = np.flatnonzero(count[:-1] + count[1:] >= np.repeat(least, np.diff(first)))
            if not len(pair):
                continue
            # of grams that repeat, only so many count as can be matched one to one
            marked = np.zeros(first[-1] + 1, bool)
            marked[pair] = marked[pair + 1] = True
            some = np.flatnonzero(marked[key])
            key, place, where = key[some].astype(np.int64), place[some].astype(np.int64), offset[hit[some]]
            key = np.r_[key, key - 1]  # in the pair that a bucket begins, and in the one that it ends
            kept = np.minimum(*[np.bincount(np.unique(key << 32 | np.r_[x, x]) >> 32, minlength=first[-1] + 1)[pair] for x in (place, where)])
            which = np.searchsorted(first, pair, "right") - 1
            full = kept >= least[which]
            pair, which = pair[full], which[full]
            if not len(pair):
                continue
            new = np.flatnonzero(np.r_[True, (np.diff(pair) > 1) | (np.diff(which) > 0)])
            for a, z in zip(new, np.r_[new[1:], len(pair)] - 1):
                k = which[a]
                w, n = int(width[k]), int(size[k])
                lo, hi = (int(pair[x] - first[k]) - 1 + y for x, y in ((a, 0), (z, 2)))
                yield int(own[k]), max(0, lo * w - n - w), min(len(text), hi * w + 2 * w)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, start, end, distance) of each copy; start and end are bytes of the row's text.

        Texts are read in stretches of STRETCH bytes that overlap by more than any copy is long.
        """
        text, off, at = normal(data, offsets)
        # a space before and after each row
        text = np.insert(text, np.r_[off[:-1], off[1:]], 32) if len(off) > 1 else text
        pad = np.arange(len(off) - 1)
        begins, ends = off[:-1] + 2 * pad, off[1:] + 2 * pad + 2
        whole = text.tobytes()
        found, lo, n = [], 0, len(text)
        for i, a in set(self.walks.candidates(text)):  # a copy begins and ends at most limit edits from where its window says
            slack = int(self.limit[i]) + 1
            found.append((i, max(0, a - slack), min(n, a + len(self.forms[i]) + 2 * slack)))
        while lo < n and self.seeds:
            hi = min(n, lo + self.stretch + 2 * self.lap)
            found += [(i, lo + a, lo + b) for i, a, b in self.windows(text[lo:hi])]
            lo = hi - 2 * self.lap if hi < n else n
        # windows that overlap are searched as one, lest half a copy is taken for the nearest
        merged: list[list[int]] = []
        for i, a, b in sorted(found):
            if merged and merged[-1][0] == i and a <= merged[-1][2]:
                merged[-1][2] = max(b, merged[-1][2])
            else:
                merged.append([i, a, b])
        for i, a, b in merged:
            if len(self.forms[i]) >= WALK and not self.may_hold(i, text[a:b]):
                continue
            for row in range(int(np.searchsorted(begins, a, "right")) - 1, int(np.searchsorted(begins, b - 1, "right"))):
                for start, end, distance in copies(self.forms[i], whole, int(self.limit[i]), max(a, int(begins[row])), min(b, int(ends[row]))):
                    start += whole[start] == 32
                    end -= whole[end - 1] == 32
                    if end > start:
                        first, last = (int(at[x - 2 * row - 1] - offsets[row]) for x in (start, end - 1))
                        yield row, i, first, last + 1, distance


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_byte, end_byte, distance): a row for each place where a document copies an item.

    Null or empty texts and items, and items without a letter or digit, match nothing. A row that stands
    twice in docs is reported twice. The benchmark is read in blocks of ITEMS items.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start_byte long, end_byte long, distance int"
    out, block = None, []

    def search(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches):
            own = Items(shared.value)
            for batch in batches:
                data, off = buffers(batch.column(1))
                for i, j in pieces(off, 1 << 20):
                    found = list(own.find(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                    ids = batch.column(0)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i + f[0] for f in found], pa.int64())), pa.array([own.ids[f[1]] for f in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)], pa.array([f[4] for f in found], pa.int32())], ["doc_id", "item_id", "start_byte", "end_byte", "distance"])

        return docs.mapInArrow(trimmed(run), schema)

    for r in benchmark.select(F.col(item_col).cast("long"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == ITEMS:
            out, block = search(block) if out is None else out.union(search(block)), []
    if block or out is None:
        out = search(block) if out is None else out.union(search(block))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those whose text copies an item. Each row is judged by its text, so rows that share an id are judged apart; rows
    with a null text stay."""
    columns = docs.columns
    names = [f"_{i}" for i in range(len(columns))]  # positions for names, so that no column can clash
    rows = docs.toDF(*names).withColumn("_hash", F.xxhash64(F.col(names[columns.index("text")]).cast("string")))
    found = leaks(rows.select("_hash", F.col(names[columns.index("text")]).alias("text")).where("text is not null"), benchmark, id_col="_hash").select(F.col("doc_id").alias("_leaked")).distinct()
    return rows.join(found, F.col("_hash") == F.col("_leaked"), "left_anti").select(*names).toDF(*columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_byte, end_byte, distance of every copy of a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
