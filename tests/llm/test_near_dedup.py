"""Near-duplicate groups against brute force on one large group of edited copies, and rows that share an id."""

import random

from colloquy.llm import near_dedup
from tests.llm.test_llm import shingles


def edited_copies(n, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(14)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice(([f"x{r.randrange(10**6)}"], [], [w[k], f"y{r.randrange(40)}"]))
        out.append((i, " ".join(w)))
    return out


def test_one_group_of_edited_copies_equals_all_pairs(spark, monkeypatch):
    rows = edited_copies(700, 3)
    sets, up, links = {i: shingles(t) for i, t in rows}, {}, 0

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
                links += 1
    met = []
    whole = near_dedup.near_pairs

    def counted(rest, found):
        pairs = whole(rest, found)
        met.append((pairs.count(), rest.select("rep").distinct().count()))
        return pairs

    monkeypatch.setattr(near_dedup, "near_pairs", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in sets}
    assert 100 < len(set(got.values())) < 600 and links > 10_000
    pairs, members = met[0]
    assert members > 200 and pairs < 5 * members  # all pairs of different components are some 100 times as many


def test_pairs_that_share_no_difference_are_met(spark):
    """Two sets so close to the usual one that they need not share any difference from it."""
    rest = [(1, i, 40, i) for i in range(6)]
    texts = []
    for i in range(6):
        w = [f"a{k}" for k in range(44)]
        w[43 if i % 2 else 0] = f"z{i}"
        texts.append((i, near_dedup.squeeze(" ".join(w).encode())))
    pairs = near_dedup.near_pairs(spark.createDataFrame(rest, "centre long, rep long, n long, component long"), spark.createDataFrame(texts, "rep long, z binary"))
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for b in range(6) for a in range(b)}


def test_texts_under_one_id_are_judged_apart(spark):
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "p q r s t u v")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "z"), (6, b, "u"), (7, c, "v"), (None, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = {(r["doc_id"], r["text"], r["kept_id"]) for r in near_dedup.near_dedup(docs).collect()}
    assert kept == {(1, a, "x"), (5, b, "z"), (7, c, "v"), (None, a, "w")}
    assert near_dedup.near_dedup(docs).count() == 4
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_dedup.groups(docs).collect())
    assert got == [(0, 0), (1, 1), (5, 1), (5, 5), (5, 5), (6, 5), (7, 7)]
