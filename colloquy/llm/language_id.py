"""Language identification: known words first, then ever shorter character n-grams.

A word of the model scores by its log frequency in each language. A word that the model does not know
is read position by position: the longest known n-gram (4, 3, 2, then 1 characters) counts. Training counts words and n-grams on executors over a bounded sample of
labelled rows; the model's size is bounded by its vocabulary limits, so it is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm._shared import grams, mix, prefix, ready, trim, trimmed

#: Labelled documents of each language that a model is fitted on, in expectation.
SAMPLE = 1500
#: Words, and n-grams of each length, that the model keeps for each language, most frequent first.
WORDS, GRAMS = 20_000, 6_000
LENGTHS = (1, 2, 3, 4)
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: A run of more letters is no word, but text without spaces; it is read in pieces of so many, each with the letters after it that its last n-grams need.
LONG, PIECE = 24, 8


@dataclass
class LanguageModel:
    """words and grams give rows of weights: a row has a log frequency for each language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    weights: np.ndarray


class Reader:
    """A model in use by one task, with the rows of words that it has met; these are forgotten beyond a bound."""

    ROOM = 200_000

    def __init__(self, model: LanguageModel):
        self.model = model
        by_length: dict[int, list[tuple[str, int]]] = {n: [] for n in LENGTHS}
        for gram, row in model.grams.items():
            by_length[len(gram)].append((gram, row))
        self.tables = {}
        for n, pairs in by_length.items():
            keys = grams(prefix(_points("".join(g for g, _ in pairs))), n)[::n]
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array([r for _, r in pairs], np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.at = dict(self.model.words)
        self.rows = np.concatenate([self.model.weights, np.zeros((self.ROOM, len(self.model.languages)), np.float32)])
        self.free = len(self.model.weights)

    def learn(self, new: list[str]) -> None:
        """Backs off for unknown words: at each position the longest n-gram known counts. A discount for each step back would be the same in every language, and is left out."""
        points = _points(" " + " ".join(new) + " ")
        space = np.flatnonzero(points == _points(" ")[0])
        place = np.arange(len(points) - 1)
        left = np.repeat(space[1:], np.diff(space)) + 1 - place  # characters up to the space after the word
        row, sums = np.full(len(place), -1, np.int64), prefix(points)
        for n in sorted(LENGTHS, reverse=True):
            keys, rows = self.tables[n]
            todo = np.flatnonzero((row < 0) & (left >= n))
            if len(keys) and len(todo):
                h = grams(sums, n)[todo]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[k] == h
                row[todo[hit]] = rows[k[hit]]
        got = np.where(row[:, None] >= 0, self.model.weights[row], 0)
        got = np.add.reduceat(got, space[:-1]) * (2.0 / np.diff(space))[:, None]
        self.rows[self.free : self.free + len(new)] = got
        self.at.update(zip(new, range(self.free, self.free + len(new))))
        self.free += len(new)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        parts = [[p for w in _WORD.findall(text.lower()) for p in ((w,) if len(w) <= LONG or w in self.model.words else pieces(w))] if text else [] for text in texts]
        together = [w for found in parts for w in found]
        if len(together) < self.ROOM // 2 and self.model.languages:
            self.codes(together)
        for found in parts:
            if not found or not any(c.isalpha() for w in found for c in w) or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = np.zeros(len(self.model.languages))
            for lo in range(0, len(found), self.ROOM // 2):
                total += self.rows[self.codes(found[lo : lo + self.ROOM // 2])].sum(axis=0, dtype=np.float64)
            total = (total - total.max()) / np.sqrt(len(found))
            p = np.exp(total)
            best = int(np.argmax(p))
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out

    def codes(self, found: list[str]) -> list[int]:
        new = list({w for w in found if w not in self.at})
        if new:
            if self.free + len(new) > len(self.rows):
                self.forget()
                new = list({w for w in found if w not in self.at})
            self.learn(new)
        at = self.at
        return [at[w] for w in found]


def pieces(run: str) -> list[str]:
    """A long run, so that each place of it begins one n-gram at least and it weighs as so many words."""
    return [run[i : i + PIECE + LENGTHS[-1] - 1] for i in range(0, len(run), PIECE)]


def _points(s: str) -> np.ndarray:
    return mix(np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64))


def _counted(batches):
    """Rows (kind, lang, gram, n) of each batch; kind is 0 for words, else the length of n-grams."""
    from collections import Counter

    for batch in batches:
        counts: dict[tuple[int, str], Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault((0, lang), Counter()).update(_WORD.findall(text.lower()))
        for _, lang in list(counts):
            for n in LENGTHS:
                to = counts[n, lang] = Counter()
                for w, k in counts[0, lang].items():
                    s = f" {w} "
                    for i in range(len(s) - n + 1):
                        to[s[i : i + n]] += k
        for (kind, lang), c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.int32()), pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["kind", "lang", "gram", "n"])


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model of labelled's languages. Rows whose text or language is null are not used; no rows give an empty model.

    Each language keeps its rows by a hash of their id, sample of them in expectation: memory and time
    do not depend on the table's size.
    """
    ready(labelled.sparkSession)
    labelled = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = labelled.groupBy(lang_col).count().collect()
    if not rows:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(v) for r in rows for v in (r[lang_col], min(1.0, sample / r["count"]))])
    place = F.pmod(F.xxhash64(F.lit("language sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(place < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = chosen.mapInArrow(_counted, "kind int, lang string, gram string, n long").groupBy("kind", "lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("total", F.sum("n").over(Window.partitionBy("kind", "lang"))).withColumn("r", F.row_number().over(Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "gram")))
    kept = ranked.where((F.col("r") <= F.when(F.col("kind") == 0, WORDS).otherwise(GRAMS)) & ((F.col("kind") > 0) | (F.col("n") > 1))).drop("r").toPandas()
    languages = sorted(r[lang_col] for r in rows)
    at = {x: i for i, x in enumerate(languages)}
    tables: list[dict[str, int]] = [{}, {}]
    totals = {(k, x): float(v) for k, x, v in kept[["kind", "lang", "total"]].drop_duplicates().itertuples(index=False)}
    kept["row"] = kept.groupby(["kind", "gram"]).ngroup()
    weights = np.zeros((int(kept["row"].max()) + 1 if len(kept) else 0, len(languages)), np.float32)
    for kind, group in kept.groupby("kind"):
        weights[group["row"]] = [np.log(0.5 / (totals.get((kind, x), 0.0) + 1.0)) for x in languages]
        tables[min(1, int(kind))].update(zip(group["gram"], group["row"]))
        weights[group["row"], group["lang"].map(at)] = np.log((group["n"] + 0.5) / (group["lang"].map(lambda x: totals[kind, x]) + 1.0))
    return LanguageModel(languages, *tables, weights)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. A null text, or one without a letter, is `und` with score 0.

    Other columns pass through as they are; columns of docs that have these two names are replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = Reader(shared.value)
        for batch in batches:
            out = [x for lo in range(0, batch.num_rows, 200) for x in own.predict(batch.column(at).slice(lo, 200).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*batch.schema.names, "lang_pred", "score"])
        del own
        trim()  # the worker goes on to other stages

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(trimmed(run), schema)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id's decimal text, modulo of; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. A null doc_id is neither held out nor learned from."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(remainder("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
