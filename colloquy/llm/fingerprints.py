"""SimHash fingerprints of 128 bits, and all fingerprints within a Hamming radius by permuted block tables.

Terms are pairs of neighbouring lower-cased words (bytes in threes for texts of fewer than three words);
longer, hence rarer, terms weigh more. Each bit is the sign of the weighted votes of all terms.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._shared import BYTE_VALUES, LOWER, U, checkpoint, mix, partitions, pieces, prefix, ready, spans, words

BITS = 128
#: Differing bits up to which fingerprints count as near, and the equal parts that they are cut into.
RADIUS, BLOCKS = 3, 4


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """16 bytes for each text; a text without words has zeros only."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    off = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    for i, j in pieces(off, 1 << 20):
        data = LOWER[np.frombuffer(b"\n".join(texts[i:j]) + b"\n", np.uint8)]
        local = off[i : j + 1] - off[i]
        start, end, first = words(data, local)
        sums = prefix(BYTE_VALUES[data])
        h = spans(sums, start, end)
        pair = mix(h[:-1] * U(3) + h[1:]) if len(h) > 1 else h[:0]
        weight = np.minimum((end - start)[:-1] + (end - start)[1:], 24).astype(np.float32)
        for k in range(i, j):
            a, b = first[k - i], first[k - i + 1]
            if b - a >= 3:
                terms, w = pair[a : b - 1], weight[a : b - 1]
            elif b > a:
                lo, hi = start[a], end[b - 1]
                cut = np.arange(lo, max(lo + 1, hi - 2))
                terms = spans(sums, cut, np.minimum(cut + 3, hi))
                w = np.ones(len(terms), np.float32)
            else:
                continue
            votes = np.zeros(BITS, np.float64)
            for lo in range(0, len(terms), 1 << 14):  # the bits of so many terms at once
                some = terms[lo : lo + (1 << 14)]
                bits = np.unpackbits(np.stack([some, mix(some + U(0x5851F42D4C957F2D))], 1).view(np.uint8), axis=1)
                votes += w[lo : lo + (1 << 14)] @ bits.astype(np.float32)
            out[k] = np.packbits(votes * 2 > w.sum(dtype=np.float64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next text's.

    The next document is that of the next smaller id; after the last comes the first. Rows with equal ids
    follow by text, null ids come last, a null text is empty, and a single row is its own next. The ids are
    cut into ranges; each range is sorted and streamed, and gets one row more, the first of the range below.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 2 * partitions(spark)
    cuts = sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)), reverse=True)
    # a few hundred bounds: as many as twice the shuffle partitions, whatever the input
    place = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(place))
    # a part's first row has its greatest id, and of these the least text, which a hash stands for
    first = F.min_by(F.xxhash64("text"), F.struct(-F.col("doc_id"), "text"))
    heads = {r["part"]: (r["head"], r["mark"]) for r in docs.groupBy("part").agg(F.max("doc_id").alias("head"), first.alias("mark")).collect()}
    order = sorted(heads)
    carry = [(order[i - 1], *heads[p], p) for i, p in enumerate(order)]  # the head of part p follows the last row of the part before
    extra = spark.createDataFrame(carry or [(0, 0, 0, -1)], "to int, head long, mark long, part int")
    head = (docs["part"] == extra["part"]) & docs["doc_id"].eqNullSafe(extra["head"]) & (F.xxhash64(docs["text"]) == extra["mark"])
    moved = docs.join(F.broadcast(extra), head).select(docs["doc_id"], "text", extra["to"].alias("part"), F.lit(1).alias("carried"))
    rows = docs.withColumn("carried", F.lit(0)).unionByName(moved).repartition(n, "part").sortWithinPartitions("part", "carried", F.desc_nulls_last("doc_id"), "text")

    def run(batches):
        held = None  # (part, id, text) whose next is not yet known

        def done(pairs):
            for lo in range(0, len(pairs), 512):
                some = pairs[lo : lo + 512]
                changed = [edited(t, nxt).encode() for _, t, nxt in some]
                prints = fingerprints([t.encode() for _, t, _ in some] + changed + [nxt.encode() for _, _, nxt in some])
                m = len(some)
                a, b, c = prints[:m], prints[m : 2 * m], prints[2 * m :]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array([len(x[1]) for x in some], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]), pa.array([x.tobytes().hex() for x in a]), pa.array([x.tobytes().hex() for x in b]), pa.array(likeness(a, b)), pa.array(likeness(a, c))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                pairs = []
                some = batch.slice(lo, 1024)
                for i, t, part, carried in zip(*(some.column(k).to_pylist() for k in range(4))):
                    if held and held[0] == part:
                        pairs.append((held[1], held[2], t))
                    held = None if carried else (part, i, t)
                yield from done(pairs)

    return rows.select("doc_id", "text", "part", "carried").mapInArrow(run, _PAIRED)


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, distance, copies): the distinct fingerprints within radius of each distinct query.

    prints and queries have a column fingerprint of 32 hex digits; nulls match nothing. By the pigeonhole
    principle fingerprints within a radius below BLOCKS agree on one block; there is a table for each block,
    equal fingerprints are one row in it, and a pair is made by the first block on which it agrees.
    """
    if radius >= BLOCKS:
        raise ValueError(f"radius must be below {BLOCKS}")
    width = BITS // 4 // BLOCKS

    def tables(df: DataFrame, names: list[str]) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*[F.substring(names[0], 1 + width * b, width) for b in range(BLOCKS)])).alias("block", "key"))

    p = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("copies"))
    q = queries.where("fingerprint is not null").select(F.col("fingerprint").alias("query")).distinct()
    joined = tables(p, ["fingerprint"]).join(tables(q, ["query"]), ["block", "key"])
    word = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word("fingerprint", k).bitwiseXOR(word("query", k))) for k in range(4)), F.lit(0))
    first = [F.when(F.substring("fingerprint", 1 + width * b, width) == F.substring("query", 1 + width * b, width), b) for b in range(BLOCKS)]
    return joined.where(F.coalesce(*first) == F.col("block")).select("query", "fingerprint", distance.alias("distance"), "copies").where(F.col("distance") <= radius)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: for ids divisible by 100, the documents whose fingerprint is within RADIUS of theirs, itself included (else null)."""
    out = checkpoint(with_next(ready(spark).read.parquet(f"{sf_dir}/documents.parquet")))
    near = within_radius(out, out.where("doc_id % 100 = 0")).groupBy("query").agg(F.sum("copies").alias("n_near"))
    asked = out.where("doc_id % 100 = 0").join(near, F.col("fingerprint") == F.col("query"), "left").select(*out.columns, "n_near")
    return out.where("doc_id is null or doc_id % 100 <> 0").withColumn("n_near", F.lit(None).cast("long")).unionByName(asked)
