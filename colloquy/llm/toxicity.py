"""Toxicity: a learned lexicon read through a Levenshtein automaton, and the windows around its hits.

The lexicon holds words and stems (open at the end) that labelled toxic documents have far more often
than others. Its trie is intersected with the Levenshtein automaton of one edit or swap; the product is
determinised as words are met, so a word costs a table look-up for each letter and most die after a few.
A window of words around each hit tells abuse (other hits close by, a second person) from quotation
(quotation marks, words of reporting). A logistic regression joins these into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm._shared import ready, table
from colloquy.llm.language_id import remainder

#: Labelled documents of each class that training reads, in expectation, and terms that the lexicon keeps.
SAMPLE, TERMS = 5000, 400
#: Lengths of stems; from so many letters on a term may be misspelled; words of the window to each side.
STEMS, FUZZY, WINDOW = (4, 5, 6, 7), 5, 8
#: From so many letters on a term may have two letters swapped or a digit for a letter.
SWAPPED = 4
_WORD = re.compile(r"[^\W_]+")
#: Second persons and words of reporting, in English, French, German and Spanish (fixed values).
ADDRESS = set("you your youre yourself tu toi te vous votre du dich dir ihr euch tú ti usted ustedes vosotros eres".split())
REPORT = set("said says called quote quoted quotes word words term insult slur dit mot cité sagte wort zitat zitiert dijo palabra cita citado".split())
_QUOTES = "\"'“”«»„‘’"
FEATURES = 10


@dataclass
class ToxicityModel:
    terms: dict[str, float]  # a term with a * at its end is a stem; weights are log odds
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Automaton:
    """The trie of terms, intersected with at most one edit; states are made when first reached.

    An edit is another letter, a letter too many or missing (not the first), or two letters swapped. Terms
    of SWAPPED to FUZZY letters take only swaps and digits for letters. A state is a node and its edits, or
    the letter that must follow to end a swap.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.word: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.fuzzy: dict[int, bool] = {0: any(len(t) >= FUZZY and not t.endswith("*") for t in terms)}
        self.swapped: set[int] = set()
        for term, weight in terms.items():
            at, letters = 0, term.rstrip("*")
            for c in letters:
                at = self.children[at].setdefault(c, len(self.children))
                if at == len(self.children):
                    self.children.append({})
                if len(letters) >= FUZZY and not term.endswith("*"):
                    self.fuzzy[at] = True
                if len(letters) >= SWAPPED and not term.endswith("*"):
                    self.swapped.add(at)
            (self.stem if term.endswith("*") else self.word)[at] = weight
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.state(frozenset([(0, 0)]))

    def state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
        return self.states[s]

    def step(self, at: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[at]:
            if isinstance(edits, str):
                if c == edits:
                    out.add((node, 1))
                continue
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits == 0:
                if self.fuzzy.get(node):
                    out.add((node, 1))  # a letter too many
                for letter, child in self.children[node].items():
                    if self.fuzzy.get(child) or (child in self.swapped and c.isdigit()):
                        out.add((child, 1))  # another letter
                    swap = self.children[child].get(c)
                    if swap is not None:
                        if node and self.fuzzy.get(child):
                            out.add((swap, 1))  # a letter missing
                        if swap in self.swapped and letter != c:
                            out.add((swap, letter))  # two letters swapped
        self.moves[at][c] = to = self.state(frozenset(out))
        return to

    def look(self, w: str) -> tuple[int, float] | None:
        """(0 exact, 1 stem, 2 misspelled; weight) of the best term that w may be."""
        at, stem = self.start, None
        for c in w:
            to = self.moves[at].get(c)
            at = self.step(at, c) if to is None else to
            if not self.sets[at]:
                break
            for node, edits in self.sets[at]:
                if edits == 0 and node in self.stem:
                    stem = max(stem or 0.0, self.stem[node])
        else:
            exact = [self.word[n] for n, e in self.sets[at] if e == 0 and n in self.word]
            if exact:
                return 0, max(exact)
            if stem is None:
                close = [self.word[n] for n, e in self.sets[at] if e == 1 and n in self.word and n in self.swapped]
                close += [self.word[k] for n, e in self.sets[at] if e == 0 for k in self.children[n].values() if n and k in self.word and self.fuzzy.get(k)]
                if close:
                    return 2, max(close)
        return None if stem is None else (1, stem)


class Reader:
    ROOM = 500_000

    def __init__(self, terms: dict[str, float]):
        self.automaton = Automaton(terms)
        self.known: dict[str, tuple[int, float] | None] = {}

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[8] = 1.0
        lower = (text or "").lower()
        found = _WORD.findall(lower)
        out[7] = math.log1p(len(found))
        if len(self.known) > self.ROOM:
            self.known.clear()
            self.automaton = Automaton(self.automaton_terms())
        known, look = self.known, self.automaton.look
        for w in set(found):
            if w not in known:
                known[w] = look(w)
        hit = {i: known[w] for i, w in enumerate(found) if known[w] is not None}
        if not hit:
            return out
        kinds, total, quoted, dense, best = [0, 0, 0], 0.0, 0, 0, 0.0
        places = [m.span() for m in _WORD.finditer(lower)]
        at = sorted(hit)
        for k, i in enumerate(at):
            kind, weight = hit[i]
            a, b = places[i]
            near = found[max(0, i - WINDOW) : i + WINDOW + 1]
            others = (k > 0 and i - at[k - 1] <= WINDOW) + (k + 1 < len(at) and at[k + 1] - i <= WINDOW)
            said = (a > 0 and lower[a - 1] in _QUOTES and lower[b : b + 2].strip(".,")[:1] in tuple(_QUOTES)) or any(x in REPORT for x in near)
            abuse = others > 0 or any(x in ADDRESS for x in near)
            kinds[kind] += 1
            total += weight * (0.3 if said and not abuse else 1.0)
            quoted += said and not abuse
            dense += abuse
            best = max(best, weight)
        out[:3] = np.log1p(kinds)
        out[3] = 100 * total / (len(found) + 20)
        out[4], out[5], out[6], out[9] = math.log1p(total), math.log1p(quoted), math.log1p(dense), best
        return out

    def automaton_terms(self) -> dict[str, float]:
        """Spelled back from the trie, for a fresh automaton without the states made so far."""
        out, todo = {}, [(0, "")]
        while todo:
            node, s = todo.pop()
            if node in self.automaton.word:
                out[s] = self.automaton.word[node]
            if node in self.automaton.stem:
                out[s + "*"] = self.automaton.stem[node]
            todo += [(child, s + c) for c, child in self.automaton.children[node].items()]
        return out


def _evidence(batches):
    """Rows (term, toxic, n, twice): documents that have a term, and that have it twice or more."""
    for batch in batches:
        counts: dict[int, tuple[Counter, Counter]] = {0: (Counter(), Counter()), 1: (Counter(), Counter())}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own: Counter = Counter()
            for w, n in Counter(_WORD.findall((text or "").lower())).items():
                own[w] += n
                for k in STEMS:
                    if len(w) > k:
                        own[w[:k] + "*"] += n
            counts[toxic][0].update(own.keys())
            counts[toxic][1].update(w for w, n in own.items() if n > 1)
        for toxic, (n, twice) in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([toxic] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([twice[w] for w in n], pa.int64())], ["term", "toxic", "n", "twice"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model of labels (0 or 1). Null labels and ids are not used; a document labelled twice counts by its highest label.

    Each class keeps its labels by a hash of the id, sample of them in expectation, so the labels that are
    broadcast have a bound. Without both classes the model scores every document 0.
    """
    ready(docs.sparkSession)
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    empty = ToxicityModel({}, np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.zeros(8), -30.0, 0.0])
    if len(size) < 2:
        return empty
    place = F.pmod(F.xxhash64(F.lit("toxicity sample"), "labelled_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(place < F.when(F.col("toxic") == 1, min(1.0, sample / size[1])).otherwise(min(1.0, sample / size[0])))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))  # no other column of docs can clash
    known = texts.join(F.broadcast(chosen), F.col("_id") == F.col("labelled_id")).select("text", "toxic")
    counts = known.mapInArrow(_evidence, "term string, toxic int, n long, twice long").groupBy("term").agg(*[F.sum(F.when(F.col("toxic") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("n", "twice") for y in (0, 1)])
    n1, n0 = float(min(sample, size[1])), float(min(sample, size[0]))
    odds = lambda c: F.log((F.col(f"{c}1") + 0.5) / n1) - F.log((F.col(f"{c}0") + 0.5) / n0)
    rated = counts.where("n1 >= 3").withColumn("weight", F.greatest(odds("n"), F.when(F.col("twice1") >= 3, odds("twice")).otherwise(0.0)))
    terms = rated.where("weight >= 1.6").orderBy(F.desc(F.col("weight") * F.sqrt("n1")), "term").limit(TERMS).collect()
    lexicon = {r["term"]: float(r["weight"]) for r in terms}

    def read(batches):
        own = Reader(lexicon)
        for batch in batches:
            f = np.array([own.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in f], pa.list_(pa.float64())), batch.column(1)], ["f", "toxic"])

    rows = known.mapInArrow(read, "f array<double>, toxic int").collect()
    x, y = np.array([r["f"] for r in rows]).reshape(-1, FEATURES), np.array([r["toxic"] for r in rows], float)
    if len(set(y)) < 2:
        return empty
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[8], scale[8] = 0.0, 1.0
    x, w = (x - mean) / scale, np.zeros(FEATURES)
    own = np.where(y == 1, size[1] / (y == 1).sum(), size[0] / (y == 0).sum())  # as frequent as they are among all labels
    own /= own.mean()
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (own * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(FEATURES)
        step = np.linalg.solve(h, x.T @ (own * (y - p)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(lexicon, mean, scale, w)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts score as texts without a hit; columns of these names are replaced."""
    ready(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)

    def run(batches):
        own = Reader(model.terms)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                f = np.array([own.features(t.as_py()) for t in some.column(at)])
                p = 1 / (1 + np.exp(-np.clip((f - model.mean) / model.scale @ model.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0))
    out = score(docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
