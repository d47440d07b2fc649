"""The training-data operators against brute force, round trips and held-out labels, and on the odd tables that every one must take."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, fingerprints, html_text, language_id, near_dedup, secrets, sentencepiece, substring_dedup, suffix_dedup, toxicity
from colloquy.llm._shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, words="the of and thing anea thontion edible erthin restes ouentha handon bleshti wherean tingly".split()):
    return " ".join(r.choice(words) + r.choice(["", "", "", "s", "er", "ing", "."]) for _ in range(n))


def corpus(seed=3):
    """Documents with exact and near copies, shared passages, a chain of edits, periodic text, and odd rows."""
    r = random.Random(seed)
    base = [prose(r, r.randint(40, 160)) for _ in range(12)]
    passage, out = prose(r, 45), []
    for i, t in enumerate(base):
        out.append(t)
        if i % 3 == 0:
            out.append(t)
        w = t.split()
        for k in range(4):
            w = list(w)
            w[r.randrange(len(w))] = f"edit{i}{k}"
            out.append(" ".join(w))
        out.append(prose(r, 20) + " " + passage + "\n" + prose(r, 15))
    out += ["For " * 120, "For " * 90 + "end", "", None, "one", "two words", "É" * 70, "日本語テキスト " * 12, prose(r, 3000)]
    return [(i * 7 % 1009, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]


ODD = [(None, "the of and thing anea", None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "the of and thing", "en", "s", 3), (3, "the of and thing", "en", "s", 3), (4, " \n\t ", "fr", None, 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    extra = spark.createDataFrame(ODD, SCHEMA)
    return extra.withColumns({c: F.lit("x") for c in ("component_id", "kept", "score", "lang_pred", "ids", "z", "block", "key", "rep", "digest", "part")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_dedup_equals_all_pairs(docs, odd, empty):
    sets = {i: shingles(t) for i, t, *_ in corpus()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    few = near_dedup.groups(odd).collect()
    assert len(few) == len(ODD) and all(r["component_id"] == r["doc_id"] for r in few if r["doc_id"] not in (None, 3)) and near_dedup.groups(empty).count() == 0
    assert near_dedup.near_dedup(odd.select(*SCHEMA.replace(",", "").split()[::2])).count() == 5


def test_registers_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
        a, b = np.unique(x[:600]), np.unique(x[100:])
        agree.append((near_dedup.registers(a) == near_dedup.registers(b)).mean())
    assert abs(np.mean(agree) - 500 / 700) < 0.03


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)}


def test_substring_dedup_equals_all_windows(docs, odd, empty):
    words = {i: WORD.findall(t or "") for i, t, *_ in corpus()}
    seen = {}
    for w in words.values():
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    expected = {}
    for i, w in words.items():
        gone = set().union(*[range(k, k + 35) for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1])
        expected[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == expected and sum(x[1] for x in expected.values()) > 500
    assert substring_dedup.remove_repeats(odd).count() == len(ODD) and substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_equals_all_strings(docs, odd, empty):
    raw = {i: (t or "").encode() for i, t, *_ in corpus()}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    expected = {}
    for i, t in raw.items():
        gone = set().union(*[range(k, k + 50) for k in range(len(t) - 49) if first[t[k : k + 50]] < i])
        runs = sum(k - 1 not in gone for k in gone)
        expected[i] = (len(t), len(gone), runs, bytes(c for k, c in enumerate(t) if k not in gone))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == expected and sum(x[1] for x in expected.values()) > 1000
    assert suffix_dedup.remove_repeats(odd).count() == len(ODD) and suffix_dedup.remove_repeats(empty).count() == 0


def test_intervals_equal_grouping():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(60)]
    joined = np.array([c for t in texts for c in [*(ord(x) for x in t), 0]], np.int32)
    stop = np.repeat(np.cumsum([len(t) + 1 for t in texts]) - 1, [len(t) + 1 for t in texts])
    for length in (1, 3, 8, 15):
        groups = {}
        for k in range(len(joined)):
            if stop[k] - k >= length:
                groups.setdefault(tuple(joined[k : k + length]), []).append(k)
        place, interval = suffix_dedup.intervals(joined, stop, length)
        got = {}
        for p, i in zip(place.tolist(), interval.tolist()):
            got.setdefault(i, []).append(p)
        assert sorted(sorted(v) for v in got.values()) == sorted(v for v in groups.values() if len(v) > 1)


def test_decontamination(spark, odd, empty):
    r = random.Random(9)
    items = [(i, prose(r, 40)) for i in range(6)] + [(6, "short unique item"), (7, ""), (8, None)]
    edited = items[1][1].split()
    edited[5], edited[20] = "changed", "other"
    rows = [(10, prose(r, 50) + "\n" + items[0][1].upper() + ". " + prose(r, 50)), (11, prose(r, 30) + " " + " ".join(edited)), (12, prose(r, 200)), (13, "a SHORT  unique, item!"), (14, items[2][1][: len(items[2][1]) // 3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(10, 0), (11, 1), (13, 6)}
    hit = next(x for x in found if x["doc_id"] == 10)
    assert rows[0][1].encode()[hit["start_byte"] : hit["end_byte"]].decode() == items[0][1].upper().rstrip(".") and hit["distance"] == 0
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == len(ODD)


def test_decontamination_beside_a_refrain():
    r = random.Random(10)
    items = [(i, prose(r, 30)) for i in range(20)]
    refrains = [t + (" " + t[-25:].strip()) * 200 for _, t in items]
    own = decontaminate.Items(items)
    raw = [t.encode() for t in refrains]
    off = np.r_[0, np.cumsum([len(t) for t in raw])]
    got = {(row, item): (start, distance) for row, item, start, _, distance in own.find(np.frombuffer(b"".join(raw), np.uint8), off)}
    assert all(got.get((i, i)) == (0, 0) for i in range(20))


def test_decontamination_finds_every_copy_within_the_rate():
    r = random.Random(11)
    items = [(i, prose(r, 200)[:n].strip()) for i, n in enumerate([8, 14, 25, 39, 41, 50, 60, 80, 100, 200, 400])]
    own = decontaminate.Items(items)
    limits = [int(decontaminate.RATE * len(f.strip())) for f in own.forms]
    texts, planted = [], []
    for i, t in items:
        n = limits[i]
        for kind in range(6):
            w = list(t)
            if kind == 0:  # one substitution every so many letters
                for k in range(n):
                    w[(2 * k + 1) * len(w) // (2 * n)] = "0"
            else:
                for k in range(n):
                    at = r.randrange(len(w))
                    w[at : at + 1] = r.choice([["9"], [w[at], "9"]] + [[]] * (" " not in w[max(0, at - 1) : at + 2]))
            planted.append(i)
            texts.append(prose(r, 20) + " " + "".join(w) + " " + prose(r, 20))
    raw = [t.encode() for t in texts]
    off = np.r_[0, np.cumsum([len(t) for t in raw])]
    got = {(row, item) for row, item, *_ in own.find(np.frombuffer(b"".join(raw), np.uint8), off)}
    forms = own.forms
    near = {(row, i) for row, t in enumerate(raw) for i in range(len(items)) if decontaminate.edit_search(forms[i], b" " + decontaminate.normal(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes() + b" ")[0] <= limits[i]}
    assert got == near and sum((row, i) in near for row, i in enumerate(planted)) >= 60


def test_edit_search_is_exact():
    r = random.Random(2)
    for _ in range(60):
        a, t = "".join(r.choice("abc") for _ in range(r.randint(1, 12))), "".join(r.choice("abc") for _ in range(r.randint(0, 25)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(a, 1):
            prev, row = row, [i]
            for j, d in enumerate(t, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d)))
        assert decontaminate.edit_search(a.encode(), t.encode())[0] == min(row)


def test_language_identification(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op4_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    model = language_id.train(docs)
    few = language_id.identify(odd, model).collect()
    assert [r["lang_pred"] for r in few if not (r["text"] or "").strip()] == ["und"] * 4 and len(few) == len(ODD)
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}


def test_language_of_long_runs():
    own = language_id.Reader(language_id.LanguageModel(["a", "b"], {}, {"x": 0, "y": 1}, np.array([[-1, -6], [-6, -1]], np.float32)))
    found = own.predict(["x" * 70 + "y" * 300, "xx xx " + "y" * 300, "½ ½ ½ ½ ½", "½ ½ ½ ½ x"])
    assert [x for x, _ in found] == ["b", "b", "und", "a"]


def test_toxicity(spark, sf, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op7_toxicity(spark, sf).join(labels, "doc_id").where("not held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.9 * len(got)
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    none = toxicity.score(odd, toxicity.train(empty, labels.limit(0))).collect()
    assert all(r["predicted"] == 0 for r in none)


def test_toxicity_of_documents_it_never_learnt_from(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.op7_toxicity(spark, folder).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits, said, real = sum(r["predicted"] and r["toxic"] for r in got), sum(r["predicted"] for r in got), sum(r["toxic"] for r in got)
    print("held out:", len(got), "toxic:", real, "found:", hits, "said:", said)
    assert real > 50 and hits >= 0.85 * real and hits >= 0.95 * said


def test_automaton_finds_one_edit():
    a = toxicity.Automaton({"moron": 2.0, "scum": 1.0, "achlich*": 3.0})
    assert a.look("moron") == (0, 2.0) and a.look("achlichst") == (1, 3.0) and a.look("scum") == (0, 1.0)
    assert all(a.look(w) == (2, 2.0) for w in ("mor0n", "moronn", "moro", "mron", "morxon")) and all(a.look(w) is None for w in ("scam", "oron", "marxn", "the", ""))


def test_automaton_finds_first_letters_and_swaps():
    a = toxicity.Automaton({"idiot": 2.0, "stupid": 2.0, "scum": 2.0})
    assert all(a.look(w) == (2, 2.0) for w in ("1diot", "5tupid", "idoit", "diiot", "xidiot", "stupdi", "scmu", "5cum", "sc0m"))
    assert all(a.look(w) is None for w in ("idtoi", "scam", "sum", "scuma"))
    long = "a" * 40 + "b"
    assert toxicity.Reader({"a" * 40: 2.0, "c" + long: 2.0}).features("c" + long)[0] > 0


def test_quotation_weighs_less_than_abuse():
    own = toxicity.Reader({"moron": 2.0})
    quoted, plain = own.features('he said the word "moron" was quoted here'), own.features("well you moron are here again now")
    assert quoted[5] > 0 and plain[5] == 0 and quoted[3] < plain[3]


def test_sentencepiece_equals_the_library(spark, odd, empty, docs):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    model = sentencepiece.Pieces()
    got = sentencepiece.tokenize(docs, model).collect()
    assert all(r["ids"] == (None if r["text"] is None else sp.encode(r["text"])) for r in got) and all(r["round_trip"] for r in got if r["text"] is not None)
    back = sentencepiece.detokenize(sentencepiece.tokenize(docs, model).select("doc_id", "text", "ids"), model).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert sentencepiece.tokenize(odd, model).count() == len(ODD) and sentencepiece.tokenize(empty, model).count() == 0


def test_fingerprints(spark, docs, odd, empty):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        e = fingerprints.edited(t, nxt)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = fingerprints.fingerprints([t.encode(), e.encode(), nxt.encode()])
        assert r["fingerprint"] == a.tobytes().hex() and r["edited_fingerprint"] == b.tobytes().hex()
        assert r["near_next"] == 1 - bin(int(a.tobytes().hex(), 16) ^ int(c.tobytes().hex(), 16)).count("1") / 128
    assert fingerprints.with_next(odd).count() == len(ODD) and fingerprints.with_next(empty).count() == 0


def test_all_fingerprints_within_radius(spark):
    r = random.Random(4)
    prints = [r.getrandbits(128) for _ in range(60)]
    prints += [p ^ sum(1 << r.randrange(128) for _ in range(k)) for p in prints[:20] for k in (1, 3, 4)] + prints[:5]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    got = {(x["query"], x["fingerprint"]): x["copies"] for x in fingerprints.within_radius(df, df).collect()}
    distinct = set(prints)
    assert got == {(f"{a:032x}", f"{b:032x}"): prints.count(b) for a in distinct for b in distinct if bin(a ^ b).count("1") <= 3}


def test_secrets(spark, odd, empty):
    x, y = secrets._read(spark, secrets.labelled(400, 77))
    trees = secrets._trees(spark, secrets.FINDINGS, 11)

    def vote(t, row):
        while not isinstance(t, float):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    assert np.mean([(np.mean([vote(t, row) for t in trees]) >= 0.5) == label for row, label in zip(x, y)]) > 0.97
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'a token = "{value}" b {value}'), (2, f"commit {value} done"), (3, "id 123e4567-e89b-12d3-a456-426614174000 here"), (4, "/static/images/photo2024/gallery12.png")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["f"]["start"]) for r in df.select("doc_id", F.explode(secrets.findings(spark, F.col("text"))).alias("f")).collect()}
    assert (1, 11) in found and not any(i > 1 for i, _ in found)
    assert secrets.redact(df).where("doc_id = 1").first()["text"] == 'a token = "[secret]" b [secret]'
    assert secrets.redact(odd).count() == len(ODD) and secrets.redact(empty).count() == 0


def test_redaction_of_a_value_within_another(spark):
    short = "q7Zr9Kx2Lw5Tn8Vb3Mp6"
    rows = [(1, f'token = "{short}" and secret = "{short}Hd4Js1Gf0Yc7Ra9"')]
    assert secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).first()["text"] == 'token = "[secret]" and secret = "[secret]"'


def test_page_text(spark):
    menu, ad = "<div class=x>Home News Contact</div>", "<div class=x>Buy pills now</div>"
    plain = lambda body: f"<html><body>{menu}{ad}<div class=x>{body}</div></body></html>"
    marked = "<body><nav>menu</nav><div class=ad>ad</div><article><h1>T &amp; U</h1><p><b>One\n two<br><p>three</article><div id=comments><p>me too</div><footer>f"
    rows = [(1, "http://a.b/x/1", plain("first story")), (2, "http://www.a.b/x/2?q=1", plain("second story")), (3, "http://c.d/y", marked), (4, "http://c.d/z", marked), (5, None, None), (6, "http://e.f/", ""), (7, "::bad", plain("alone")), (2, "http://www.a.b/x/2?q=1", plain("second story"))]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [t for i, t, _ in got] == ["first story", "second story", "second story", "T & U\nOne two\nthree", "T & U\nOne two\nthree", "", "", "Home News Contact\nBuy pills now\nalone"] and all(n == len(t) for _, t, n in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_text_differences_marked_pages(spark):
    page = lambda k: f"<body><div>Menu of all</div><main><div>Read our notice first</div><p>story {k} is told at some length here</p></main></body>"
    rows = [(1, "http://a.b/x/1", page(1)), (2, "http://a.b/x/2", page(2)), (3, "http://a.b/x/3", "<body><div>Menu of all</div><div>plain story</div></body>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "story 1 is told at some length here", 2: "story 2 is told at some length here", 3: "plain story"}


def test_wrappers_do_not_drop_the_article():
    article = "<article><header class='entry-header'><h1>Head</h1></header><p>story</article>"
    for wrapper in ("<div class=has-sidebar>", "<div class='page no-sidebar'>", "<form>", "<div class=sidebar>", "<div class=legal-analysis>"):
        assert [t for z, t in html_text.blocks(f"<body>{wrapper}{article}") if z == 2] == ["Head", "story"]
    assert html_text.blocks("<body><form><p>all of a page</form>") == [(1, "all of a page")]
    rest = "<div class=site-footer>f</div><div id=comments><article>me too</article></div><div class='share-buttons'>s</div><form>mail</form>"
    assert html_text.blocks(f"<body>{article}{rest}") == [(2, "Head"), (2, "story")]


def test_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(50):
        a, b = ([r.randrange(5) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        keep = html_text.shared(np.array(a, np.uint64), np.array(b, np.uint64))
        assert keep.sum() == table[-1][-1]


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        assert name == "sentencepiece" or docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]
    none = spark.createDataFrame([], spark.read.parquet(f"{sf}/documents.parquet").schema)
    assert all(stage(spark, none, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)


def _field(number, kind, payload):
    """A field of a protocol buffer message."""
    head = bytes([number << 3 | kind])
    if kind == 2:
        size, out = len(payload), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return head + out + bytes([size]) + payload
    return head + payload


def unigram_model(path, pieces):
    """A model of the unigram kind without normalisation, written by hand."""
    import struct

    body = b""
    for text, score, kind in pieces:
        body += _field(1, 2, _field(1, 2, text.encode()) + _field(2, 5, struct.pack("<f", score)) + _field(3, 0, bytes([kind])))
    body += _field(2, 2, _field(3, 0, bytes([1])))
    body += _field(3, 2, _field(1, 2, b"identity") + _field(3, 0, b"\1") + _field(4, 0, b"\0") + _field(5, 0, b"\1"))
    path.write_bytes(body)
    return str(path)


def test_unigram_model_equals_the_library(tmp_path):
    import sentencepiece as sp

    r = random.Random(8)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1)] + [(c, -3.5 - i / 7, 1) for i, c in enumerate("abcde日本")]
    pieces += [(w, -r.uniform(2, 9), 1) for w in sorted({"".join(r.choice("abcde") for _ in range(r.randint(2, 6))) for _ in range(90)})]
    pieces += [(w, -r.uniform(2, 9), 1) for w in ("▁ab", "▁cd", "▁e", "日本", "本日")]
    path = unigram_model(tmp_path / "u.model", pieces)
    library, coder = sp.SentencePieceProcessor(model_file=path), sentencepiece.Coder(sentencepiece.Pieces(path))
    assert coder.model.kind == "unigram"
    texts = ["".join(r.choice("abcde  日本") for _ in range(r.randint(1, 90))) for _ in range(300)] + ["".join(r.choice("abcde") for _ in range(3000))]
    ids, bounds = coder.encode(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        mine, theirs = ids[a:b].tolist(), library.encode(text)
        score = lambda x: sum(pieces[i][1] for i in x)
        assert mine == theirs or abs(score(mine) - score(theirs)) < 1e-4  # equal sums may be reached in two ways


def test_text_without_spaces_is_cut_where_no_piece_spans():
    r = random.Random(4)
    import sentencepiece as sp

    library = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    coder = sentencepiece.Coder(sentencepiece.Pieces())
    texts = ["".join(r.choice("日本語文字化学生命abcdefgh") for _ in range(n)) for n in (10, 33, 200, 4000)] + ["x" * 500, "ab" * 300]
    ids, bounds = coder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t) for t in texts]
    assert max(len(x) for x in coder.uncrossed("▁" + texts[3])) < 400


def test_decontamination_reaches_its_recall_against_edit_distance():
    """Copies with random and evenly spread edits at 5, 10 and 15 %, of items of 48 to 400 bytes: what the tables find of what edit distance finds."""
    r = random.Random(21)
    items = [(i, prose(r, 120)[: r.choice([48, 60, 80, 100, 140, 200, 300, 400])].strip()) for i in range(120)]
    own = decontaminate.Items(items)
    for spread in (False, True):
        for rate in (0.05, 0.10, 0.15):
            texts = []
            for i, t in items:
                w, n = list(t), int(rate * len(t))
                places = [(2 * k + 1) * len(w) // (2 * n) for k in range(n)] if spread else sorted(r.sample(range(len(w)), n))
                for at in reversed(places):
                    w[at : at + 1] = r.choice([["9"], [w[at], "9"], []])
                texts.append((prose(r, 20) + " " + "".join(w) + " " + prose(r, 20)).encode())
            off = np.r_[0, np.cumsum([len(t) for t in texts])]
            got = {(row, item) for row, item, *_ in own.find(np.frombuffer(b"".join(texts), np.uint8), off)}
            near = 0
            for i, t in enumerate(texts):
                form = decontaminate.normal(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()
                if decontaminate.edit_search(own.forms[i], b" " + form + b" ")[0] <= own.limit[i]:
                    near += 1
            found = sum((i, i) in got for i in range(len(items)))
            assert near > 40 and found >= 0.9 * near, (spread, rate, found, near)


def test_texts_of_pages_are_not_kept_on_disk(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(html_text, "checkpoint", lambda df: kept.append(set(df.columns)) or df.checkpoint())
    rows = [(i, f"http://a.example/{i}", f"<p>menu</p><p>story {i}</p>") for i in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((x["page_id"], x["text"]) for x in got) == [(i, f"story {i}") for i in range(3)]
    assert kept and not any({"html", "z"} & columns for columns in kept)


def test_every_word_begins_a_window():
    r = random.Random(6)
    some = [w for w in (a + b + c for a in "abcdehilmnoprst" for b in "aeiou" for c in ("ng", "rest", "lla", "n")) if not (ord(w[0]) * 31 + ord(w[1])) * 0x9E37 >> 7 & 1]
    items = [(i, " ".join(r.choice(some) for _ in range(40))[:n].strip()) for i, n in enumerate([90, 150, 240])]
    for i, t in items:
        text = np.frombuffer(t.encode(), np.uint8)
        assert set(decontaminate.begins(text).tolist()) == {m.start() for m in re.finditer(r"\S+", t)}
    own = decontaminate.Items(items)
    raw = [f"{prose(r, 30)} {t} {prose(r, 30)}".encode() for _, t in items]
    found = list(own.find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]))
    assert [(row, item, distance) for row, item, _, _, distance in sorted(found)] == [(i, i, 0) for i in range(3)]
    assert all(raw[row][start:end].decode() == items[item][1] for row, item, start, end, _ in found)
    run = np.frombuffer(("x" * 30 + "abcdefghij" * 5).encode(), np.uint8)
    assert decontaminate.begins(run).tolist() == [0, *range(24, len(run))]


def test_rows_that_share_an_id_are_decontaminated_apart(spark):
    r = random.Random(5)
    item = prose(r, 40)
    rows = [(1, "x " + item), (1, prose(r, 30)), (None, item), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit(1)).withColumn("leaked", F.lit(2))
    kept = decontaminate.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(x["doc_id"], x["text"]) for x in kept} == {rows[1], rows[3]} and kept[0].asDict().keys() == {"doc_id", "text", "_hash", "leaked"}


def test_a_digit_far_into_a_run_makes_it_a_candidate(spark):
    value = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRS9f3b7c1d2e4a"
    got = spark.createDataFrame([(f"see {value} and " + "x" * 30,)], "text string").select(secrets.candidates(F.col("text")).alias("c")).first()["c"]
    assert [c["value"] for c in got] == [value]


def test_open_elements_are_closed_however_deep():
    deep = "<ul><li>one" + "<span>" * 30 + "a<li>two</ul>"
    assert [t for _, t in html_text.blocks(f"<article>{deep}</article>")] == ["onea", "two"]
    assert [t for _, t in html_text.blocks("<article><ul><li>one<ul><li>inner</ul>more</ul></article>")] == ["one", "inner", "more"]


def test_null_ids_and_long_texts_of_fingerprints(spark):
    rows = [(None, f"null text {i % 3} here") for i in range(9)] + [(5, "five words are in here"), (4, "four " * 200_000)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 11 and sorted(x["n_chars"] for x in got)[-1] == 1_000_000
    by = {x["doc_id"]: x for x in got if x["doc_id"] is not None}
    assert by[4]["edited_sha256"] == hashlib.sha256(fingerprints.edited("four " * 200_000, "null text 0 here").encode()).hexdigest()


def test_columns_that_clash(spark):
    """Operators take tables with columns of the names that they use themselves."""
    r = random.Random(6)
    names = ["labelled_id", "toxic", "kept_id", "mark", "_hash", "row", "host", "lines", "lang_pred", "score", "ids"]
    docs = spark.createDataFrame([(i, prose(r, 30)) for i in range(8)], "doc_id long, text string").withColumns({n: F.lit("x") for n in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 8
    assert near_dedup.near_dedup(docs).columns == docs.columns
    pages = spark.createDataFrame([(1, "http://a.b/x", "<main><p>one</main>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").withColumns({n: F.lit("x") for n in names})
    got = sorted((x["page_id"], x["text"], x["n_chars"]) for x in html_text.extract(pages).collect())
    assert got == [(1, "one", 3), (2, "", 0), (2, "", 0)] and html_text.extract(pages.limit(0)).count() == 0


def test_frequent_words_outlive_a_full_memory(monkeypatch):
    import sentencepiece as sp

    monkeypatch.setattr(sentencepiece, "ROOM", 40)
    library, coder = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL), sentencepiece.Coder(sentencepiece.Pieces())
    searched, search = [], coder.search
    monkeypatch.setattr(coder, "search", lambda words: searched.extend(words) or search(words))
    for i in range(6):
        texts = [f"often and often again {'x' * k}{i}y{k}\n \U0001f9ff {chr(0x4E00 + 40 * i + k)} naïve" for k in range(30)] + ["", None, " ", "漢字" * 50]
        ids, at = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) if t else [] for t in texts]
        assert coder.round_trips(texts, ids, at) == [None if t is None else True for t in texts]
        assert len(coder.known) <= 200
    assert searched.count("▁often") == 1
    assert coder.round_trips(["a▁b"], *coder.encode(["a▁b"])) == [False]


def test_memory_for_many_copies_of_similar_fragments():
    import tracemalloc

    rng, n = np.random.default_rng(5), 60_000
    kinds = np.tile(rng.integers(97, 123, 70).astype(np.uint8), (4, 1))
    kinds[np.arange(4), 65 + np.arange(4)] = 48
    which, ids = rng.integers(0, 4, n), rng.permutation(n).astype(np.int64)
    tracemalloc.start()
    got = suffix_dedup._decide(np.full(n, 7, np.uint64), ids, np.full(n, 70, np.int64), kinds[which].ravel(), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    least = {}
    for k in range(4):
        for p in range(21):
            w = kinds[k][p : p + 50].tobytes()
            least[w] = min(least.get(w, n), int(ids[which == k].min()))
    for i in range(0, n, 997):
        assert int(got[i]) == sum((least[kinds[which[i]][p : p + 50].tobytes()] < ids[i]) << p for p in range(21))


def test_operators_drop_what_others_hold():
    from colloquy.llm import _shared

    sentencepiece._CODERS[b"x"] = None
    assert list(_shared.trimmed(lambda batches: batches, keep="sentencepiece")([1])) == [1] and b"x" in sentencepiece._CODERS
    assert list(_shared.trimmed(lambda batches: batches)([1])) == [1] and not sentencepiece._CODERS


def test_gram_filter_keeps_all_within_the_rate():
    rng = np.random.default_rng(3)
    items = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (80, 131, 240)]
    own = decontaminate.Items(list(enumerate(items)))
    for i, item in enumerate(items):
        step = len(item) / own.limit[i]
        gone = {int(k * step) for k in range(own.limit[i])}  # edits as far from each other as they can be
        assert own.may_hold(i, np.frombuffer("".join(c for k, c in enumerate(item) if k not in gone).encode(), np.uint8))
        assert own.may_hold(i, np.frombuffer("".join("#" if k in gone else c for k, c in enumerate(item)).encode(), np.uint8))
        assert not own.may_hold(i, rng.integers(97, 123, 300).astype(np.uint8)) and not own.marks.any()
