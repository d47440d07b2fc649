"""Near-duplicate groups by HyperMinHash: banded compressed registers, collision-corrected estimates, exact confirmation.

A document's set holds its distinct five-word shingles. Its hashes fall into REGISTERS buckets; the least
hash of a bucket is kept as a byte, leading zeros (capped) above mantissa bits. Empty buckets copy a filled
one in an order that is the same for all documents, so that a register agrees as often as sets overlap.

Copies with equal sets are one class, represented by its smallest id. Classes that agree on a band of ROWS
registers are candidates. A bucket of many classes does not make all pairs: each member is compared with
three members first, and once the confirmed links are known, only members of different components are
compared. No link between components can be lost that way, and links inside one change nothing. Members that
share a centre are compared by what sets them apart from the set that is usual there, behind an exact prefix
filter (`near_pairs`), so many edited copies of one text do not make all their pairs. The estimate on a sketch
of registers, corrected for chance collisions, drops hopeless pairs: a link that shares a band is lost to it
with a probability of about 2e-8 (5.5 standard deviations). The rest are confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm._shared import BYTE_VALUES, LOWER, U, buffers, by_key, checkpoint, components, expand, grams, make_room, mix, pieces, prefix, ready, release, spans, squeeze, table, trimmed, words
from colloquy.llm.repeats import SENT, answers, distinct, sends, told

WORDS, PERCENT = 5, 75
REGISTERS, ROWS = 160, 4
BANDS = REGISTERS // ROWS
MANTISSA = 4
#: Registers of the sketch that an estimate reads, and how far below the threshold it may fall: over 5 standard deviations.
SKETCH, SLACK = 64, 0.3
#: Bytes of compressed texts in a block of those whose shingles are counted.
BLOCK = 1 << 20
#: Members up to which a bucket makes its pairs; larger ones go through `near_pairs`, which finds the same links.
FEW = 16
#: Members of a centre that its usual set is taken from.
TYPICAL = 31
#: Below so many shingles registers are copies of few hashes, and no estimate is made.
LEAST = 100
_FILL = np.argsort(np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1), axis=1)
_SKETCH = [f"s{i}" for i in range(SKETCH // 8)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles; fewer words than WORDS are one shingle, none are none."""
    data = LOWER[data]
    start, end, first = words(data, offsets)
    w = spans(prefix(BYTE_VALUES[data]), start, end)
    sums = prefix(w)
    g, out = grams(sums, WORDS), []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        out.append(np.unique(g[a : b - WORDS + 1]) if b - a >= WORDS else spans(sums, np.array([a]), np.array([b])) if b > a else g[:0])
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS bytes of a sorted, non-empty set."""
    h = mix(hashes ^ U(0xA5A5A5A55A5A5A5A))
    h.sort()
    bucket = ((h >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    filled = bucket[first]
    fresh = h[first] * U(REGISTERS)  # the place of the bucket's least hash within it, as a fraction of 2**64
    zeros = np.minimum(63 - np.floor(np.log2(fresh.astype(np.float64) + 1)), 15).astype(np.int64).clip(0, 15)
    mantissa = (fresh << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
    value = (zeros << MANTISSA | mantissa.astype(np.int64)).astype(np.uint8)
    out = np.zeros(REGISTERS, np.uint8)
    out[filled] = value
    empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
    if len(empty):
        out[empty] = value[np.argmin(_FILL[np.ix_(empty, filled)], axis=1)]
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, n_shingles, digest, registers): one row for each row of docs.

    The digest is of the whole set; mark is a hash of the text, which tells rows apart that share an id.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in pieces(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "mark", "n_shingles", "digest", "registers"],
                )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(trimmed(run), "doc_id long, mark long, n_shingles long, digest binary, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, rep): a row for each band of each class."""

    def run(batches):
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x2545F4914F6CDD1D))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                regs = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
                keys = mix(np.ascontiguousarray(regs).view(np.uint32)[:, :, 0].astype(np.uint64) + salt)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(some.column(0).to_numpy(), BANDS))], ["key", "rep"])

    return classes.select("rep", "registers").mapInArrow(trimmed(run), "key long, rep long")


def estimate(n_a: Column, n_b: Column, a: list[Column], b: list[Column]) -> Column:
    """Jaccard estimate from sketches of 8 registers a long, less what agrees by chance.

    Two different minima of sets of a and b hashes fall into one cell of the register with probability
    about ab / (a + b)**2 / (2 ln 2) / 2**MANTISSA.
    """
    differ = F.lit(0)
    for x, y in zip(a, b):
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))
    chance = n_a * n_b / ((n_a + n_b) * (n_a + n_b)) * (0.7213 / (1 << MANTISSA))
    return (1 - differ / float(SKETCH) - chance) / (1 - chance)


def _hopeful(left: str, right: str) -> Column:
    """Sizes allow the threshold, and the estimate is not far below it."""
    n_a, n_b = F.col(f"{left}.n"), F.col(f"{right}.n")
    guess = estimate(n_a, n_b, [F.col(f"{left}.{s}") for s in _SKETCH], [F.col(f"{right}.{s}") for s in _SKETCH])
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & ((F.least(n_a, n_b) < LEAST) | (guess >= PERCENT / 100 - SLACK))


def texts_of(reps: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, z): the compressed text of each representative. The digest tells rows apart that share an id; equal sets are one text here."""
    asked = checkpoint(reps.select("rep").distinct().join(classes.select("rep", "digest"), "rep"))

    def small(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for i, j in pieces(off):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([squeeze(data[off[k] : off[k + 1]]) for k in range(i, j)], pa.binary())], ["rep", "digest", "z"])

    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    found = texts.mapInArrow(trimmed(small), "rep long, digest binary, z binary").join(asked, ["rep", "digest"], "left_semi")
    return checkpoint(found.dropDuplicates(["rep"]).select("rep", "z"))


def _sets(column) -> list[np.ndarray]:
    raw = [expand(z).tobytes() for z in column.to_pylist()]
    off = np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)
    return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), off)


def confirm(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those pairs (a, b) of representatives whose sets overlap by PERCENT; compressed texts travel, sets are rebuilt."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                some = batch.slice(lo, 128)
                keep = []
                for x, y in zip(_sets(some.column(2)), _sets(some.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(keep))

    a = found.select(F.col("rep").alias("a"), F.col("z").alias("za"))
    b = found.select(F.col("rep").alias("b"), F.col("z").alias("zb"))
    return checkpoint(pairs.join(a, "a").join(b, "b").select("a", "b", "za", "zb").mapInArrow(trimmed(run), "a long, b long"))


def lone_shingles(found: DataFrame) -> DataFrame:
    """(rep, alone): how many shingles of each representative no other one of found has.

    Blocks of representatives send their distinct hashes and are told which occur twice (see `repeats`).
    """
    total = found.agg(F.sum(F.octet_length("z")).alias("n")).first()["n"] or 0
    n_blocks = int(max(16, -(-int(total) // BLOCK)))
    rows = found.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(n_blocks)).cast("int"))

    def pooled(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        make_room()
        sets = _sets(t.sort_by("rep")["z"])
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        return sets, *distinct(np.concatenate(sets), owners)

    def send(key: tuple, t: pa.Table) -> pa.Table:
        _, values, many = pooled(t)
        return sends(key[0].as_py(), values, many, n_blocks)

    def count(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        sets, values, _ = pooled(t)
        shared = told(replies, 0, values, n_blocks)
        return pa.table([t.sort_by("rep")["rep"], pa.array([int((~shared[np.searchsorted(values, s)]).sum()) for s in sets], pa.int64())], ["rep", "alone"])

    sent = rows.groupBy("block").applyInArrow(send, SENT)
    return checkpoint(by_key(rows, answers(sent, 0), "block", count, "rep long, alone long"))


def settled(rest: DataFrame) -> DataFrame:
    """rest (key, centre, rep, ...) with one centre for all buckets that meet in a common member's least centre.

    A bucket's centre is only a name that its members share, so any rule that gives each bucket one will do.
    Members of one large group share many buckets; this gives these the same name, and a member few names.
    """
    least = rest.groupBy("rep").agg(F.min("centre").alias("_least"))
    named = rest.select("key", "rep").join(least, "rep").groupBy("key").agg(F.min("_least").alias("_name"))
    return rest.join(named, "key").withColumn("centre", F.col("_name")).drop("_name")


def usual_sets(rest: DataFrame, found: DataFrame) -> DataFrame:
    """(centre, usual): the shingles that over half of some TYPICAL members of each centre have.

    Any set would do, as pairs are compared by what sets them apart from it; this one leaves little to compare.
    """
    rank = F.row_number().over(Window.partitionBy("centre").orderBy(F.xxhash64("rep"), "rep"))
    some = rest.select("centre", "rep").withColumn("_rank", rank).where(F.col("_rank") <= TYPICAL).drop("_rank").join(found, "rep")

    def usual(key: tuple, t: pa.Table) -> pa.Table:
        make_room()
        sets = _sets(t["z"])
        values, many = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([squeeze(values[2 * many > len(sets)])], pa.binary())], ["centre", "usual"])

    return some.select("centre", "z").groupBy("centre").applyInArrow(usual, "centre long, usual binary")


def near_pairs(rest: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of rest (centre, rep, n, component) that share a centre, are of different
    components, and can link; among them every pair that does.

    Sets that link differ in (100 - PERCENT) / (100 + PERCENT) of the sum of their sizes at most (`room`). Both
    are taken as what sets them apart from the usual set of their centre, which leaves that number as it is. If
    two such differences have s and s' members, they must share T = (s + s' - room) / 2 of them, so they share
    one of the first s - T + 1 and s' - T + 1, the rarest first. In a group of many edited copies of one text
    these are the edits, so a member meets only those with one of its own rare edits. The larger of two
    differences shows at most room + 1 of its members, the smaller at most room / 2 + 1. Where T is none, all
    meet on one value.
    """
    spread = (100 - PERCENT) / PERCENT

    def differences(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = _sets(part.column(2))
                apart = [np.setxor1d(x, expand(u, np.uint64), assume_unique=True) for x, u in zip(sets, part.column(3).to_pylist())]
                size = np.array([len(x) for x in apart], np.int32)
                most = (part.column(4).to_numpy() * spread).astype(np.int64) + 1
                # those that can be apart from each other only as far as room goes meet on 0
                values = [np.r_[x, U(0)] if k <= m else x for x, k, m in zip(apart, size, most)]
                many = [len(x) for x in values]
                cols = [np.repeat(part.column(k).to_numpy(), many) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64), np.repeat(size, many))], ["centre", "rep", "t", "s"])

    held = rest.join(found, "rep").join(usual_sets(rest, found), "centre").select("centre", "rep", "z", "usual", "n")
    apart = checkpoint(held.mapInArrow(trimmed(differences), "centre long, rep long, t long, s int"))
    counts = apart.groupBy("centre", "t").agg(F.count("*").alias("f")).where("f > 1")
    # what one member alone has comes first in its order, and joins nothing: s and the number of the others say how many that are
    shared = apart.join(counts, ["centre", "t"])
    w = Window.partitionBy("centre", "rep")
    order = F.row_number().over(w.orderBy(F.desc(F.col("t") == 0), "f", "t"))
    others = F.count(F.when(F.col("t") != 0, 1)).over(w)
    zero = F.max((F.col("t") == 0).cast("int")).over(w)
    at = F.when(F.col("t") == 0, -1).otherwise(F.col("s") - others + order - zero - 1).cast("int")
    main = rest.groupBy("centre", "component").agg(F.count("*").alias("m")).groupBy("centre").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    members = rest.join(main, "centre").select("centre", "rep", "n", "component", (F.col("component") == F.col("main")).alias("common"))
    shown = checkpoint(shared.select("centre", "rep", "t", "s", at.alias("at")).join(members, ["centre", "rep"]).where(F.col("at") <= F.col("n") * spread + 1))
    room = F.floor((F.col("l.n") + F.col("r.n")) * (100 - PERCENT) / (100 + PERCENT))
    least = F.ceil((F.col("l.s") + F.col("r.s") - room) / 2)
    meets = F.when(F.col("l.at") < 0, (F.col("r.at") < 0) & (least <= 0)).otherwise((F.col("l.at") <= F.col("l.s") - least) & (F.col("r.at") <= F.col("r.s") - least) & (least > 0))
    sizes = (100 * F.least("l.n", "r.n") >= PERCENT * F.greatest("l.n", "r.n")) & (F.abs(F.col("l.s") - F.col("r.s")) <= room)
    brief = F.col("at") <= F.col("n") * spread / 2 + 1
    odd = shown.where("not common")
    same = (F.col("l.centre") == F.col("r.centre")) & (F.col("l.t") == F.col("r.t")) & (F.col("l.component") != F.col("r.component")) & sizes & meets
    pair = (F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
    down = odd.alias("l").join(shown.where(brief).alias("r"), same & (F.col("l.s") >= F.col("r.s"))).select(*pair)
    up = odd.where(brief).alias("l").join(shown.alias("r"), same & (F.col("l.s") < F.col("r.s"))).select(*pair)
    return down.union(up).distinct()


def _long(registers: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(registers, 1 + 8 * at, 8)), 16, -10).cast("long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, mark) of every row of docs; mark is a hash of the text.

    Rows without words or with a null text have an empty set and link with nothing. A null id has no
    component (null) and is kept. Rows with equal ids and equal texts agree in everything; equal ids with
    different texts are separate documents under one name, each with its own component.
    """
    spark = ready(docs.sparkSession)
    every = checkpoint(signatures(docs, id_col, text_col))
    sketch = [_long(F.col("registers"), i).alias(s) for i, s in enumerate(_SKETCH)]
    classes = every.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = checkpoint(classes.select("digest", "low", F.col("low").alias("rep"), "n", "registers", *sketch))
    shared = checkpoint(classes.groupBy(F.col("low").alias("shared")).agg(F.count("*").alias("m")).where("m > 1").select("shared"))
    ambiguous = not shared.isEmpty()
    if ambiguous:  # different texts under one id: each class needs a name of its own
        classes = checkpoint(classes.join(shared, F.col("low") == F.col("shared"), "left").withColumn("rep", F.when(F.col("shared").isNotNull(), F.xxhash64("digest")).otherwise(F.col("low"))).drop("shared"))
    brief = classes.select("rep", "n", *_SKETCH)
    release(spark)

    keyed = bands(classes)
    mixed = lambda c: F.xxhash64(F.lit("centre"), c)
    centres = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("c0"), F.max("rep").alias("c1"), F.min(F.struct(mixed("rep").alias("h"), F.col("rep").alias("rep"))).alias("c2")).where("m > 1")
    members = checkpoint(keyed.join(centres.select("key", "c0", "c1", F.col("c2.rep").alias("c2")), "key"))
    star = members.select("rep", F.explode(F.array_distinct(F.array("c0", "c1", "c2"))).alias("c")).where("rep <> c").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
    star = checkpoint(star.join(brief.alias("l"), F.col("a") == F.col("l.rep")).join(brief.alias("r"), F.col("b") == F.col("r.rep")).where(_hopeful("l", "r")).select("a", "b"))
    release(spark)
    ends = lambda pairs: pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
    links = confirm(star, texts_of(ends(star), docs, classes, id_col, text_col))
    known = components(links)
    release(spark)

    part = brief.join(known, brief["rep"] == known["node"], "left").select(brief["*"], F.coalesce("component", "rep").alias("component"))
    placed = checkpoint(members.select("key", F.col("c2").alias("centre"), "rep").join(part.select("rep", "n", "component"), "rep"))

    def mixed_buckets(rows: DataFrame) -> DataFrame:
        """rows of buckets with several components."""
        counts = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
        return rows.join(counts.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key"), "key")

    # what no other member of such buckets has cannot overlap: it bounds every overlap from above
    doubtful = mixed_buckets(placed).select("rep").distinct()
    found = texts_of(doubtful, docs, classes, id_col, text_col)
    release(spark)
    rest = placed.join(lone_shingles(found), "rep").where(100 * F.col("alone") <= (100 - PERCENT) * F.col("n"))
    rest = mixed_buckets(rest)
    sizes = rest.groupBy("key").agg(F.count("*").alias("members"))
    rest = checkpoint(rest.join(sizes, "key"))
    # a bucket of few members can make its pairs: their number grows with the rows only
    few = rest.where(F.col("members") <= FEW)
    room = F.least(F.col("l.n") - F.col("l.alone"), F.col("r.n") - F.col("r.alone"))
    possible = (100 + PERCENT) * room >= PERCENT * (F.col("l.n") + F.col("r.n"))
    met = few.alias("l").join(few.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.component") < F.col("r.component")) & possible)
    pairs = met.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"))
    many = checkpoint(settled(rest.where(F.col("members") > FEW)).select("centre", "rep", "n", "component").distinct())
    if not many.isEmpty():
        pairs = pairs.union(near_pairs(many, found))
    cross = pairs.distinct().join(star, ["a", "b"], "left_anti")
    cross = checkpoint(cross.join(brief.alias("l"), F.col("a") == F.col("l.rep")).join(brief.alias("r"), F.col("b") == F.col("r.rep")).where(_hopeful("l", "r")).select("a", "b"))
    release(spark)
    if not cross.isEmpty():
        more = confirm(cross, found)
        if not more.isEmpty():
            known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.select("digest", "low", "rep").join(known, F.col("rep") == F.col("node"), "left").select("digest", "low", "rep", F.coalesce("component", "rep").alias("component_id"))
    if ambiguous:
        named = checkpoint(named)
        renamed = named.join(named.where("rep <> low").select("component_id").distinct(), "component_id", "left_semi").groupBy("component_id").agg(F.min("low").alias("least"))
        named = named.join(renamed, "component_id", "left").withColumn("component_id", F.coalesce("least", "component_id"))
    named = checkpoint(named.select("digest", "component_id"))
    full = every.where("n_shingles > 0 and doc_id is not null").join(named, "digest").select("doc_id", "n_shingles", "component_id", "mark")
    empty = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "mark")
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one row of each near-duplicate group.

    Rows with a null id stay. Of rows with equal ids and equal texts one stays; different texts under one id are
    judged each by itself. Other columns, whatever their names, pass through.
    """
    columns = docs.columns
    kept = checkpoint(groups(docs, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    names = [f"_{i}" for i in range(len(columns))]  # positions for names, so that no column can clash
    at, text = names[columns.index(id_col)], names[columns.index(text_col)]
    rows = docs.toDF(*names).withColumn("_key", F.col(at).cast("long")).withColumn("_hash", F.xxhash64(F.col(text).cast("string")))
    chosen = rows.where(F.col("_key").isNotNull()).join(kept, (F.col("_key") == F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left_semi").dropDuplicates(["_key", "_hash"])
    return chosen.unionByName(rows.where(F.col("_key").isNull())).select(*names).toDF(*columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("mark")
