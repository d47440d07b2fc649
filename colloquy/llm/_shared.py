"""Helpers of the training-data operators: sessions, Arrow text buffers, rolling hashes, blocks of packed texts.

Texts are handled as one byte buffer with offsets, in pieces of bounded size, so that numpy does the
work of many documents at once and a worker's memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
TOP = U(0xFFFFFFFFFFFFFFFF)
#: An odd base and a random odd value for each byte make a polynomial hash over 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
ROOT = str(Path(__file__).resolve().parents[2])


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, and names a checkpoint folder where the cluster names none."""
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)
    if spark.conf.get(_BATCH) == "10000":  # Spark's own value: 10,000 whole texts in each buffer on both sides of a pipe
        spark.conf.set(_BATCH, "2000")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:  # one machine, as in tests; executors elsewhere could not read it
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder; lost executors then cost nothing that came before."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What workers hold from task to task, by operator.
CACHES: dict[str, dict] = {}


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, where the C library can: workers go on to other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def make_room(keep: str = "") -> None:
    """Drops what other operators hold in this worker, and trims its memory."""
    for name, cache in CACHES.items():
        if name != keep:
            cache.clear()
    trim()


def trimmed(run, keep: str = ""):
    """run, a function of batches, that makes room at its start, and trims the worker's memory at its end."""

    def out(batches):
        make_room(keep)
        yield from run(batches)
        trim()

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, at least."""
    if len(_POWERS[0]) < n:
        m = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * BASE**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal for equal contents wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(len(sums))[1][:n])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    n, step = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    out = values
    while 2 * step <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[:n], out[width - step : width - step + n]) if step < width else out[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, and the index of the first word of each row (one more at the end)."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = step[: n + 1] == 1, step[: n + 1] == -1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word ends where its row ends
    starts[cuts], ends[cuts] = True, True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def ranges_of(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n equal ranges of the hash space in a sorted array."""
    return np.searchsorted(sorted_hashes >> U(16), np.array([(i << 48) // n for i in range(n + 1)], np.uint64))


def squeeze(array: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes())


def expand(blob: bytes, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), dtype)


#: Rows that are packed together.
PACKED = 10_000
BLOCK_SCHEMA = "block int, ids binary, lengths binary, texts binary"
#: Stands for a null doc_id within a block; such rows sort last.
NO_ID = np.iinfo(np.int64).max


def blocks_for(docs: DataFrame, text: str, size: int, least: int) -> int:
    """How many blocks of about size bytes the texts make."""
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return int(max(least, -(-int(total) // size)))


def packed(docs: DataFrame, n_blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of BLOCK_SCHEMA: the documents of a block that were read together, compressed.

    A row's block follows from its id and text, so every run deals alike. Compression comes before the
    shuffle: the texts cross the network at about a third of their size.
    """

    def gathered(batches):
        """Batches of PACKED rows or more, however small those that Spark sends are: a block's rows should travel together."""
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    def pack(batches):
        for batch in gathered(batches):
            block = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            rows = batch.take(pa.array(order))
            data, off = buffers(rows.column(1))
            ids = rows.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            block = block[order]
            at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, int)
            ends = np.r_[at[1:], len(block)]
            out = [(int(block[i]), ids[i:j].tobytes(), np.diff(off[i : j + 1]).tobytes(), squeeze(data[off[i] : off[j]])) for i, j in zip(at, ends)]
            for lo in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 500]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "ids", "lengths", "texts"])

    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), block).mapInArrow(trimmed(pack), BLOCK_SCHEMA)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a block's documents, ordered by id and then text."""
    ids, texts = [], []
    for i, n, z in zip(rows["ids"].to_pylist(), rows["lengths"].to_pylist(), rows["texts"].to_pylist()):
        ids.append(np.frombuffer(i, np.int64))
        ends = np.cumsum(np.frombuffer(n, np.int64))
        raw = expand(z).tobytes()
        texts += [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    ids = ids[order]
    texts = [texts[k] for k in order]
    return ids, np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def by_key(left: DataFrame, right: DataFrame, key: str, func, schema: str) -> DataFrame:
    """func(left rows, right rows) for every value of key."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(func, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of edges (a, b).

    Alternating large-star and small-star steps: edges never grow in number, hot nodes are folded by
    partial aggregation, and each round is checkpointed so that lineage stays short.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")) if not large else e.select("a", "b").union(e.select("b", "a")).toDF("u", "v")
        if not large:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return moved.where("a <> b").distinct()

    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    was = None
    while True:  # the labels only fall, so this ends
        edges = checkpoint(star(star(edges, True), False))
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == was or not now["n"]:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
