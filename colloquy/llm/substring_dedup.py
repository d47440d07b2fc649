"""Removal of repeated passages of words: seed and extend.

Seeds are winnowed anchors of GRAM words. Documents meet on the anchors that occur more than once. Each such
anchor is extended both ways to WINDOW words, in every division between left and right, and the extensions
(the windows around it) meet by hash in turn. Those that occur twice, wherever they start, are repeats;
neighbouring ones join into maximal repeats, which are removed. Pairs of documents are never listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._shared import BYTE_VALUES, NO_ID, by_key, blocks_for, checkpoint, grams, packed, prefix, ready, release, spans, table, unpacked, words
from colloquy.llm.repeats import SENT, answers, covered, distinct, member, seeds, sends, told

WINDOW, GRAM = 35, 12
#: Bytes of text in a block, and of text for each range of hashes.
BLOCK, PART = 3 << 20, 12 << 20
_OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, kept string"


class _Block:
    """The words and seeds of a block's documents."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.ids, self.data, off = unpacked(rows)
        self.start, self.end, self.first = words(self.data, off)
        self.sums = prefix(spans(prefix(BYTE_VALUES[self.data]), self.start, self.end))
        self.low, g, chosen = seeds(self.sums, self.first, gram, window)
        self.seeds, self.many = distinct(g[chosen])
        self.window = window

    def windows(self, replies: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows whose seed is repeated."""
        at = np.flatnonzero(member(self.seeds[told(replies, 0, self.seeds, parts)], self.low))
        return at, grams(self.sums, self.window)[at]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges removed), kept (the other words, one space between) of every row.

    Words are [^\\x20\\x09-\\x0D]+. A null text has no words; texts of fewer than window words lose none. Rows
    that stand twice in docs are two documents, so their windows repeat each other. A null id stays null.
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

    def send_windows(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(rows, window, gram)
        return sends(key[0].as_py(), *distinct(b.windows(replies, parts)[1]), parts)

    second = checkpoint(answers(by_key(blocks(), first, "block", send_windows, SENT), 1))
    release(spark)

    def finish(key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
        b = _Block(rows, window, gram)
        at, h = b.windows(replies, parts)
        values, _ = distinct(h)
        gone = covered(at[told(replies, 1, values, parts)[np.searchsorted(values, h)]] if len(h) else at, window, len(b.start))
        raw, out = b.data.tobytes(), []
        for i, (lo, hi) in enumerate(zip(b.first[:-1], b.first[1:])):
            own = gone[lo:hi]
            keep = np.flatnonzero(~own) + lo
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            kept = b" ".join([raw[x:y] for x, y in zip(b.start[keep].tolist(), b.end[keep].tolist())])
            out.append((None if b.ids[i] == NO_ID else int(b.ids[i]), int(hi - lo), int(own.sum()), [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])], kept.decode("utf-8", "replace")))
        cols = list(zip(*out)) if out else [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.string()))], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return by_key(blocks(), first.unionByName(second), "block", finish, _OUT)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


