"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The hashes of all substrings of many words probe the sorted keys of all pieces; then the words advance together:
at each place the best of the pieces that end there is stored as a backpointer. For models of the unigram kind the
best step is the one of the greatest sum of scores. Models of the BPE kind have ranks for scores, whose sum
means nothing: there a step is allowed only if the piece and the one before it, joined and merged by rank,
come out as these two pieces. A segmentation is that of BPE exactly if all neighbours pass this test, so one
step is left at each place, and ids equal those of the reference library.

The model is read on the driver from a path that the caller gives, and broadcast (its size is fixed).
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm._shared import CACHES, U, mix, powers, prefix, ready, table, trimmed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Longer words (text without spaces) are cut where no piece of the model spans before they are searched.
LONG = 32
#: Words whose ids a worker remembers; a slot for each pair of pieces that it remembers, and for each piece of one length.
ROOM, PAIR_BITS, SLOT_BITS = 400_000, 21, 17


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message; integers, or bytes of nested messages."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _kind(proto: bytes) -> int:
    """The trainer's model type (1 unigram, 2 BPE): field 3 of field 2; unigram where it is left out."""
    return next((kind for n, spec in _fields(proto) if n == 2 for m, kind in _fields(spec) if m == 3), 1)


class Pieces:
    """A model's pieces, and its kind: unigram or bpe."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.unknown = sp.unk_id()
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.digest = hashlib.sha256(repr((self.piece, self.score.tolist())).encode()).digest()
        self.kind = {1: "unigram", 2: "bpe"}[_kind(sp.serialized_model_proto())]


class Coder:
    """Encodes and decodes with a model; keeps the words and the pairs of pieces that it has met."""

    def __init__(self, model: Pieces):
        self.model = model
        self.id = {model.piece[i]: i for i in model.normal}
        self.rank = {p: float(model.score[i]) for p, i in self.id.items()}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.slots: dict[int, np.ndarray] = {}
        by_length: dict[int, list[str]] = {}
        for p in self.id:
            by_length.setdefault(len(p), []).append(p)
        for n, ps in sorted(by_length.items()):
            keys = _hash(_matrix(ps), 0, n)
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array([self.id[p] for p in ps], np.int64)[order]
            self.slots[n] = np.zeros(1 << SLOT_BITS, bool)  # asked before a table is searched
            self.slots[n][keys >> U(64 - SLOT_BITS)] = True
        # a word may end where no piece crosses: before a space that follows something else, and around line ends
        crossed = any(SPACE in p.lstrip(SPACE) for p in self.id) or any("\n" in p and p != "\n" for p in self.id)
        self.words = re.compile(r"[\s\S]+" if crossed else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        # a word's number in the order of meeting; its ids lie between its place in starts and the next
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)
        # a pair's slot holds the pair that was asked for last
        self.pair, self.stay = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.as_bytes = [b""] * len(model.piece)
        for i in model.normal:
            self.as_bytes[i] = model.piece[i].replace(SPACE, " ").encode()
        for b, i in model.byte.items():
            self.as_bytes[i] = bytes([b])
        self.as_bytes[model.unknown] = " ⁇ ".encode()
        self.bytes = np.frombuffer(b"".join(self.as_bytes), np.uint8)
        self.sizes = np.array([len(x) for x in self.as_bytes], np.int64)

    def stays(self, left: str, right: str) -> bool:
        """Whether BPE of the two pieces together gives these two again: the neighbours of the best piece join, the leftmost first."""
        parts, rank, edge = list(left + right), self.rank, len(left)
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and r > best:
                    best, at = r, k
            if at < 0:
                break
            if at == edge - 1:  # across the edge
                return False
            edge -= at < edge
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) == 2

    def allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stays as it is under BPE; -1 before is the start or an unknown character."""
        out = before < 0
        ask = np.flatnonzero(~out)
        keys = before[ask] * len(self.model.piece) + piece[ask]
        slot = _slot(keys)
        ok, new = self.stay[slot], np.flatnonzero(self.pair[slot] != keys)
        if len(new):
            fresh, where = np.unique(keys[new], return_inverse=True)
            size, names = len(self.model.piece), self.model.piece
            found = np.array([self.stays(names[k // size], names[k % size]) for k in fresh.tolist()], bool)
            ok[new] = found[where]
            slot, last = np.unique(_slot(fresh), return_index=True)
            self.pair[slot], self.stay[slot] = fresh[last], found[last]
        out[ask] = ok
        return out

    def search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sums, inverse = prefix(mix(points.astype(np.uint64))), powers(len(points) + 1)[1]
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(points))
        room = (first + size)[word] - place
        bpe = self.model.kind == "bpe"
        # all pieces in the words: where they begin, and their number; the shortest first
        found = []
        for k, (keys, ids) in self.tables.items():
            start = np.flatnonzero(room >= k)
            h = mix((sums[start + k] - sums[start]) * inverse[start])
            some = np.flatnonzero(self.slots[k][h >> U(64 - SLOT_BITS)])
            start, h = start[some], h[some]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            found.append((start[hit], np.full(hit.sum(), k), ids[at[hit]]))
        start, length, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        # a node for each place of a word and for its end; steps by the place in the word where they end
        ends = start + length - first[word[start]]
        order = np.argsort(ends, kind="stable")
        source, length, piece = (start + word[start])[order], length[order], piece[order]
        longest = int(size.max(initial=0))
        cut = np.searchsorted(ends[order], np.arange(1, longest + 2))
        n = len(points) + len(words)
        last = np.full(n, -1, np.int64)  # the piece that ends here; -1 for an unknown character
        back = np.ones(n, np.int64)
        if not bpe:
            best = np.full(n, -np.inf)
            best[first + np.arange(len(words))] = 0
            floor = (self.model.score.min() if len(self.model.score) else 0.0) - 10.0
            by_place = np.argsort(place - first[word], kind="stable")
            node = (place + word + 1)[by_place]
            nodes = np.searchsorted((place - first[word])[by_place], np.arange(longest + 1))
        for i in range(1, longest + 1):
            a, b = cut[i - 1], cut[i]
            f, k, p = source[a:b], length[a:b], piece[a:b]
            if bpe:
                some = np.flatnonzero(self.allowed(last[f], p))[::-1]  # the shortest is set last
            else:
                gain = best[f] + self.model.score[p]
                some = np.lexsort((-k, gain))
            to = f[some] + k[some]
            last[to], back[to] = p[some], k[some]
            if not bpe:
                best[to] = gain[some]
                lost = node[nodes[i - 1] : nodes[i]]
                lost = lost[best[lost] == -np.inf]  # an unknown character
                best[lost] = best[lost - 1] + floor
        at, whose, steps = first + size + np.arange(len(words)), np.arange(len(words)), []
        while len(at):
            steps.append((whose, np.where(last[at] >= 0, last[at], whose - at)))  # below 0: less the place of an unknown character, and one
            at = at - back[at]
            more = at > (first + np.arange(len(words)))[whose]
            at, whose = at[more], whose[more]
        whose, ids = (np.concatenate(x)[::-1] for x in zip(*steps)) if steps else (np.zeros(0, np.int64),) * 2
        order = np.argsort(whose, kind="stable")
        whose, ids = whose[order], ids[order]
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            spelled = [self.unknown(chr(c)) for c in points[-ids[lost] - 1].tolist()]
            many = np.ones(len(ids), np.int64)
            many[lost] = [len(x) for x in spelled]
            ids, whose, own = np.repeat(ids, many), np.repeat(whose, many), np.repeat(ids < 0, many)
            ids[own] = list(chain.from_iterable(spelled))
        return ids.astype(np.int32), np.bincount(whose, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        """Remembers words that are not known, and their ids."""
        words.sort(key=len)
        sizes = np.cumsum([len(w) for w in words])
        lo, ids, many = 0, [self.ids], []
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 17), "right")))
            for x, y in zip((ids, many), self.search(words[lo:hi])):
                x.append(y)
            lo = hi
        if many:
            self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
            self.ids = np.concatenate(ids)
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.concatenate(many))]
            self.uses = np.r_[self.uses, np.zeros(len(words), np.int64)]

    def forget(self) -> None:
        """Keeps the half of ROOM that was used most, of words used more than once."""
        rank = np.argsort(-self.uses, kind="stable")[: ROOM // 2]
        keep = np.sort(rank[self.uses[rank] > 1])
        keep = keep[np.cumsum(np.diff(self.starts)[keep]) <= 4 * ROOM]
        ids, bounds = self.of(keep)
        here = np.zeros(len(self.uses), bool)
        here[keep] = True
        self.known = {w: i for i, w in enumerate(compress(self.known, here.tolist()))}
        self.ids, self.starts, self.uses = ids, bounds, np.zeros(len(keep), np.int64)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, and their bounds."""
        start, many = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        bounds = np.r_[0, np.cumsum(many)]
        return self.ids[np.repeat(start - bounds[:-1], many) + np.arange(bounds[-1])], bounds

    def uncrossed(self, word: str) -> list[str]:
        """A long word cut at the places that no piece of the model spans in it: no segmentation crosses these, so the parts can be searched apart."""
        sums, n = _matrix([word])[0], len(word)
        step = np.zeros(n + 2, np.int64)
        for k, (keys, _) in self.tables.items():
            if 2 <= k <= n:
                h = mix((sums[k:] - sums[:-k]) * powers(n + 1)[1][: n - k + 1])
                at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h)
                step[at + 1] += 1
                step[at + k] -= 1
        cuts = [0, *(np.flatnonzero(np.cumsum(step)[1:n] == 0) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def unknown(self, c: str) -> tuple[int, ...]:
        return tuple(self.model.byte[b] for b in c.encode("utf-8", "replace")) if len(self.model.byte) == 256 else (self.model.unknown,)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's. A null or empty text has none."""
        parts = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > ROOM or len(self.ids) > 8 * ROOM:
            self.forget()
        new = set(chain.from_iterable(parts)).difference(self.known)
        long = {w: self.uncrossed(w) for w in new if len(w) > LONG}
        if long:
            parts = [list(chain.from_iterable(long.get(w, (w,)) for w in p)) if not long.keys().isdisjoint(p) else p for p in parts]
            new = {x for w in new for x in long.get(w, (w,)) if x not in self.known}
        self.learn(list(new))
        ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, ends[-1])
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ids, bounds = self.of(numbers)
        return ids, bounds[ends]

    def round_trips(self, texts: list[str | None], ids: np.ndarray, bounds: np.ndarray) -> list[bool | None]:
        """Whether the ids of each text decode to it; null for a null text. Bytes of many texts are put together at once,
        and decoded as text where they are not those of the text behind its space."""
        size = self.sizes[ids]
        ends = np.r_[0, np.cumsum(size)]
        data = self.bytes[np.repeat((np.cumsum(self.sizes) - self.sizes)[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[bounds].tolist()
        return [None if t is None else data[x:y] == (b" " + t.encode("utf-8", "surrogatepass") if t else b"") or self.decode(ids[a:b].tolist()) == t for t, x, y, a, b in zip(texts, at[:-1], at[1:], bounds[:-1], bounds[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a space at its start is the one that encoding put there, unless it has no text at all."""
        s = b"".join(map(self.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * U(0x9E3779B97F4A7C15) >> U(64 - PAIR_BITS)).astype(np.int64)


def _matrix(words: list[str]) -> np.ndarray:
    """(words, length + 1) prefix sums of hashed characters."""
    n, size = len(words), len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(n, size)
    out = np.zeros((n, size + 1), np.uint64)
    np.cumsum(mix(points) * powers(size + 1)[0][:size], axis=1, out=out[:, 1:])
    return out


def _hash(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    return mix((sums[:, end] - sums[:, start]) * powers(sums.shape[1])[1][start])


_CODERS: dict[bytes, Coder] = CACHES.setdefault("sentencepiece", {})


def _coder(shared) -> Coder:
    """One coder for each worker process and broadcast model; its memory of words outlives tasks."""
    model = shared.value
    if model.digest not in _CODERS:
        _CODERS.clear()
        _CODERS[model.digest] = Coder(model)
    return _CODERS[model.digest]


def tokenize(docs: DataFrame, model: Pieces, text_col: str = "text") -> DataFrame:
    """docs with ids (array<int>, null for a null text) and round_trip: whether decoding the ids gives the text.

    Encoding puts a space before the text, as the model was trained. A text that has the model's own space
    mark (U+2581) decodes to a space there and has round_trip false. Columns of these names are replaced.
    """
    docs = docs.drop("ids", "round_trip")
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            lo, sizes = 0, np.cumsum([len(x) if x else 0 for x in batch.column(at).to_pylist()])
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 21))))
                some = batch.slice(lo, hi - lo)
                lo = hi
                texts = some.column(at).to_pylist()
                ids, bounds = coder.encode(texts)
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                lists = pa.compute.if_else(null, pa.scalar(None, lists.type), lists) if null.true_count else lists
                back = coder.round_trips(texts, ids, bounds)
                yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(back, pa.bool_())], [*batch.schema.names, "ids", "round_trip"])

    return docs.mapInArrow(trimmed(run, keep="sentencepiece"), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))


def detokenize(rows: DataFrame, model: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids have a null text."""
    rows = rows.drop(text_col)
    shared = ready(rows.sparkSession).sparkContext.broadcast(model)
    at = rows.columns.index(ids_col)

    def run(batches):
        coder = _coder(shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every document; a null text has null ids and n_tokens 0."""
    out = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), Pieces(model_path))
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
