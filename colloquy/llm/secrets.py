"""Secret scans: candidate strings, judged by a random forest that is a column expression.

Candidates are long strings with a digit, and values assigned to a name such as token or password. The
forest reads a candidate's length, its characters and the changes between their kinds, how much of it
common words cover, whether it is part of a path, and the words around it. It is trained on labelled
findings, written by the rules of `labelled`, and its trees become nested CASE expressions: scanning is
DataFrame functions only, and needs no shuffle.
"""

from __future__ import annotations

import json
import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm._shared import ready, table

#: Trees, their depth, labelled findings, and the share of votes from which a candidate is a secret.
TREES, DEPTH, FINDINGS, THRESHOLD = 15, 5, 3000, 0.5
MASK = "[secret]"
#: Candidates: an assigned value of 8 or more characters, or a run of 16 or more with a digit anywhere.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])(?:(?<=[:=][\"' ]{0,2})(?<=(?i:key|token|secret|passwd|password|pwd|auth)[\"' ]{0,2}[:=][\"' ]{0,2})[A-Za-z0-9+/_\-.!@#$%^&*]{8,}"
    r"|(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,})={0,2}"
)
#: Common words of identifiers and file names (fixed values).
DICTIONARY = (
    "account address admin agent alert answer archive article asset author backup batch before block board book browser buffer build button cache camera channel chapter "
    "chart check class client clone cloud cluster color column comment commit common compile config connect content control copy count course cover create current custom "
    "data date debug default delete design detail device digest direct document domain download draft edit email encode engine entry error event example export false "
    "field file filter final folder form format frame front gallery game general global graph green group handle header height hello home host house icon image import "
    "index info input insert invoice item journal label language large last layout level library light line link list load local location login lower mail main manager "
    "master media member memory menu message method mobile model module month movie music name network news node note number object office online open option order "
    "package page panel parent part patch path people person phone photo picture plain player point popup post price print private process product profile program project "
    "public query queue random range read record release remote render report request reset response result return review right sample save scale scan schedule school "
    "screen script search section select send server service session setting shadow share short sign simple size small social sort source space stack start state static "
    "status step storage store stream string style submit support switch system table target task team temp template test text theme thumb ticket time title tool topic "
    "track trade train transfer tree true type under unit update upload user value vector version video view visit volume wait watch water weather week white width window "
    "word work world write year zone"
).split()
_WORDS = "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"
FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "changes", "hex", "grouped", "covered", "path", "extension", "named", "assigned", "quoted", "benign"]


def _features(c: Column, before: Column, after: Column) -> list[Column]:
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: condition.cast("double")
    return [
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        F.regexp_count(c, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n,
        flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        flag(c.rlike("^[0-9A-Fa-f]{4,8}(-[0-9A-Fa-f]{4}){2,}|^[0-9]{2,4}([-/_][0-9]{1,4}){2,}|^[0-9]+$")),
        1 - F.length(F.regexp_replace(F.lower(c), _WORDS, "")) / n,
        flag(c.rlike("^/|/[A-Za-z]{2,}/|^[a-z]+(/[a-z0-9_\\-]+){2,}") | before.rlike("[./:\\\\~]$")),
        flag(after.rlike("^\\.[A-Za-z]{2,4}\\b")),
        flag(before.rlike("(?i)(key|token|secret|passwd|password|pwd|auth|credential|bearer)[\\w\"' ]{0,12}[:=]?[\"' ]{0,3}$")),
        flag(before.rlike("[:=][\"' ]{0,3}$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        flag(before.rlike("(?i)(commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|etag|revision|order|invoice|card|isbn|phone|tracking|serial|build|version)\\W{0,4}\\w{0,8}\\W{0,4}$")),
    ]


def let(value: Column, body) -> Column:
    """body of value, which is computed once: an expression that a lambda uses is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(text: Column) -> Column:
    """A text's candidates, and what lies between them; null where there are none."""
    text = F.coalesce(text, F.lit(""))
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.when(text.rlike(CANDIDATE), F.struct(values.alias("values"), F.split(text, CANDIDATE, -1).alias("between")))


def _read_cut(cut: Column) -> Column:
    """array<struct<value, at, features...>> of a cut; at is the candidate's place among the candidates."""
    seen = F.transform(cut["values"], lambda c, i: F.struct(c.alias("value"), i.alias("at"), F.substring(F.get(cut["between"], i), -48, 48).alias("before"), F.substring(F.get(cut["between"], i + 1), 1, 24).alias("after")))
    full = lambda x: F.struct(x["value"].alias("value"), x["at"].alias("at"), *[f.alias(name) for name, f in zip(FEATURES, _features(x["value"], x["before"], x["after"]))])
    return F.transform(seen, full)


def _start(cut: Column, at: Column) -> Column:
    """Where a candidate begins, from 0 in code points: after what lies between the earlier ones, and these."""
    steps = F.transform(F.slice(cut["between"], F.lit(1), at + 1), lambda x, j: F.length(x) + F.when(j < at, F.length(F.get(cut["values"], j))).otherwise(0))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, n: acc + n)


def candidates(text: Column) -> Column:
    """array<struct<value, at, features...>> of a text; null for texts without any, null or empty."""
    return let(_cut(text), lambda cut: F.when(cut.isNotNull(), _read_cut(cut)))


def labelled(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int]]:
    """Texts with one candidate each, and 1 where it is a secret: credentials of common shapes against look-alikes."""
    r = random.Random(seed)
    hexa, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    s = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    with_digit = lambda chars, k: s(chars, k - 3) + s(string.digits, 1) + s(chars, 2)
    prose = lambda: " ".join(r.choice(["the", "of", "and", "der", "que", "les", "about", "where", "nicht", "pour", "para"]) for _ in range(r.randint(1, 4)))
    names = ["token", "secret", "api_key", "apikey", "password", "passwd", "client_secret", "auth_token", "access_key", "SECRET_KEY", "Authorization: Bearer", "credential"]
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            value = r.choice([lambda: s(hexa, r.choice([32, 40, 48, 64])), lambda: with_digit(alnum, r.randint(20, 48)), lambda: with_digit(b64, r.choice([24, 32, 40, 44, 64])), lambda: "AK" + s(string.ascii_uppercase + string.digits, 18), lambda: r.choice(["sk_live_", "ghx_", "xoxb-", "pk-"]) + with_digit(alnum, r.randint(20, 40)), lambda: with_digit(alnum + "!#%&*", r.randint(10, 18))])()
            q = r.choice(['"', "'", ""])
            how = r.choice([" = ", "=", ": ", ":"])
            name = r.choice(names)
            lone = r.random() < 0.15 and len(value) >= 32 and not set(value) <= set(hexa)
            text = f"{prose()} {value} {prose()}" if lone else f"{prose()} {name}{' ' if 'Bearer' in name else how}{q}{value}{q} {prose()}"
            out.append((text, 1))
        else:
            words = lambda k: [r.choice(DICTIONARY) for _ in range(k)]
            text = r.choice([
                lambda: f"{prose()} {s(hexa, 8)}-{s(hexa, 4)}-{s(hexa, 4)}-{s(hexa, 4)}-{s(hexa, 12)} {prose()}",
                lambda: f"{prose()} {r.choice(['commit', 'sha1:', 'sha256:', 'checksum', 'md5', 'etag', 'digest ', 'revision'])} {s(hexa, r.choice([32, 40, 64]))} {prose()}",
                lambda: f"{prose()} {s(string.digits, r.randint(16, 19))} {prose()}",
                lambda: f"{prose()} /{'/'.join(words(3))}/{r.choice(words(1))}{s(string.digits, r.randint(1, 4))}.{r.choice(['png', 'html', 'js'])} {prose()}",
                lambda: f"{prose()} {'_'.join(words(3))}{s(string.digits, 2)} {prose()}",
                lambda: f"{prose()} {''.join(w.title() for w in words(3))}{s(string.digits, 3)} {prose()}",
                lambda: f"{prose()} {2000 + r.randint(0, 30)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{s(string.digits, 6)} {prose()}",
                lambda: f"{prose()} token = {r.choice(['example', 'changeme', 'placeholder', 'your_token_here', 'undefined'])} {prose()}",
                lambda: f"{prose()} key: {'-'.join(words(3))} {prose()}",
                lambda: f"{prose()} {r.choice(['order', 'invoice', 'tracking', 'serial', 'version'])} {s(string.ascii_uppercase + string.digits, 8)}{s(string.digits, 10)} {prose()}",
                lambda: f"{prose()} {s('etaoinshr', 18)}{r.randint(1, 9)} {prose()}",
            ])()
            out.append((text, 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A tree: a share of ones, or (feature, bound, at most, above)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 8 or p in (0.0, 1.0):
        return p
    best, found = 1e-9, None
    whole = p * (1 - p)
    for f in rng.choice(x.shape[1], 5, replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
            left = x[:, f] <= t
            n = int(left.sum())
            if 4 <= n <= len(y) - 4:
                a, b = y[left].mean(), y[~left].mean()
                gain = whole - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
                if gain > best:
                    best, found = gain, (int(f), float(t), left)
    if found is None:
        return p
    f, t, left = found
    return f, t, _grow(x[left], y[left], depth - 1, rng), _grow(x[~left], y[~left], depth - 1, rng)


def _read(spark: SparkSession, rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of labelled texts, by the columns that scanning uses."""
    given = F.from_json(F.lit(json.dumps([{"text": t, "y": y} for t, y in rows])), "array<struct<text: string, y: int>>")
    read = spark.range(1).select(F.explode(given).alias("r")).select("r.y", F.explode(candidates(F.col("r.text"))).alias("c")).select("y", *[f"c.{f}" for f in FEATURES])
    got = np.array([tuple(r) for r in read.collect()], np.float64)
    return got[:, 1:], got[:, 0]


@lru_cache(maxsize=4)
def _trees(spark: SparkSession, n: int, seed: int) -> tuple:
    x, y = _read(spark, labelled(n, seed))
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(TREES):
        some = rng.integers(0, len(y), len(y))
        out.append(_grow(x[some], y[some], DEPTH, rng))
    return tuple(out)


def _votes(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(c[FEATURES[f]] <= t, _votes(low, c)).otherwise(_votes(high, c))


def findings(spark: SparkSession, text: Column, n: int = FINDINGS, seed: int = 11) -> Column:
    """array<struct<value, start, score>> of the candidates that the forest takes for secrets."""
    trees = _trees(spark, n, seed)
    score = lambda c: sum((_votes(t, c) for t in trees), F.lit(0.0)) / len(trees)
    pick = lambda cut: F.filter(F.transform(_read_cut(cut), lambda c: F.struct(c["value"].alias("value"), c["at"].alias("at"), score(c).alias("score"))), lambda c: c["score"] >= THRESHOLD)
    # only for what was found does the place matter
    placed = lambda cut: F.transform(pick(cut), lambda c: F.struct(c["value"].alias("value"), _start(cut, c["at"]).alias("start"), c["score"].alias("score")))
    return let(_cut(text), lambda cut: F.when(cut.isNotNull(), placed(cut)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every secret replaced by MASK, wherever it stands in the text; a null text stays null, n_chars (if present) is counted anew."""
    found = F.coalesce(findings(ready(docs.sparkSession), F.col(text_col)), F.array().cast("array<struct<value: string, start: bigint, score: double>>"))
    # the longest first: a value may be part of another
    found = F.transform(F.reverse(F.array_sort(F.transform(found, lambda c: F.struct(F.length(c["value"]).alias("n"), c["value"].alias("value"))))), lambda c: F.struct(c["value"].alias("value")))
    out = docs.withColumn(text_col, F.aggregate(found, F.col(text_col), lambda t, c: F.replace(t, c["value"], F.lit(MASK))))
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each secret of each document: doc_id, start, n_chars of the value, its sha256, a masked form, score.

    Null and empty texts have none; rows that stand twice are reported twice; a null doc_id stays null.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.explode(findings(spark, F.col("text"))).alias("f"))
    value = F.col("f.value")
    return rows.select("doc_id", F.col("f.start").alias("start"), F.length(value).cast("long").alias("n_chars"), F.sha2(value, 256).alias("value_sha256"), F.concat(F.substring(value, 1, 4), F.lit("…")).alias("masked"), F.col("f.score").alias("score"))
