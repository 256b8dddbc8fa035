"""The training-data operators against brute force, on small tables with awkward rows."""

import base64
import collections
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "rho", "tau", "phi"]) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = words(rng, 120)
    texts = [None, "", "   \n\t ", "one", "One", "a b c d", base, base, base + " extra", base.replace("alpha", "ALPHA"), words(rng, 119) + " " + base]
    parts = base.split()
    for k in range(4):
        texts.append(" ".join(parts[: 118 - k]) + f" tail{k}")
    texts += ["é" * 3 + " 日本語   x " + "!" * 50, "x" * 700, "ab " * 400, "ab " * 400 + "!", words(rng, 30)]
    texts += [words(rng, 60) for _ in range(20)]
    rows = [(i, t, "en", None if i % 11 == 3 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    return [*rows, rows[6]]  # one row repeats


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names used inside
    return spark.createDataFrame(corpus(), DOCS).withColumns({"size": F.lit(1), "node": F.lit("n"), "ids": F.lit(0)})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def text_of():
    return [(r[0], r[1] or "") for r in corpus()]


# 1 ----------------------------------------------------------------------------------------------
def test_bpe_matches_tiktoken(spark, docs, none):
    import public_tokenizers
    import tiktoken

    from latmix.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tables = bpe.Tables(spark, path)
    for most in (0, 4, 1 << 12):  # a table that holds almost nothing gives the same
        out = bpe.encode(docs, tables, public_tokenizers.PATTERN, "doc_id", "text", most=most)
        got = out.withColumn("back", bpe.decode(F.col("ids"), tables)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r["ids"] == enc.encode_ordinary(r["text"] or "") and bytes(r["back"]) == (r["text"] or "").encode()
    d = {r["doc_id"]: r for r in bpe.encode(docs, tables, public_tokenizers.PATTERN, "doc_id", digests=True).collect()}
    for i, t in text_of():
        ids = enc.encode_ordinary(t)
        assert d[i]["n_tokens"] == len(ids) and d[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and d[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(none, tables, public_tokenizers.PATTERN, "doc_id").count() == 0


def test_bpe_classes_are_the_engines(spark, monkeypatch):
    import public_tokenizers
    import tiktoken

    from latmix.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = tiktoken.Encoding("cut", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    # letters and numbers that newer versions of Unicode have
    odd = [chr(c) + "'s 12" + chr(c) for c in (0x1DF00, 0x31350, 0x1E4D0, 0xA7D0, 0x10D40)]
    # every character, after and before letters, numbers, signs and white space; a block's words are few
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 20_000):
        odd.append("".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}'s " for c in every[k : k + 20_000]))
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(8)
    got = dict(map(tuple, rows.select("doc_id", bpe.pre_tokens(spark, F.col("text"), public_tokenizers.PATTERN)).collect()))
    for i, t in enumerate(odd):
        assert "".join(got[i]) == t and [len(w.encode()) for w in got[i]] == _lengths(cut, t)
    monkeypatch.setattr(bpe, "PART", 7)
    ids = dict(map(tuple, bpe.encode(rows.where("doc_id < 5"), bpe.Tables(spark, path), public_tokenizers.PATTERN, "doc_id").collect()))
    assert all(ids[i] == enc.encode_ordinary(odd[i]) for i in range(5))


def test_bpe_table_finds_its_words(spark):
    import public_tokenizers
    import pyarrow as pa

    from latmix.llm import bpe

    own = [f"w{k}é" for k in range(2000)]
    rows = spark.createDataFrame([(" ".join(own[k::3]),) for k in range(3)] * 2, "text string").repartition(3)
    known = bpe.known_words(rows, bpe.Tables(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, 1 << 14)
    at = known.find(pa.array([" w", "é", "none", "199", ""]))
    assert (np.diff(known.hashes) > 0).all() and (at[[0, 1, 3]] >= 0).all() and (at[[2, 4]] == -1).all()
    assert len(bpe.known_words(rows, bpe.Tables(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, 5).hashes) <= 5


def _lengths(cut, text):
    """Byte lengths of the engine's words: regular expressions of the same version, word by word."""
    from latmix.llm import bpe

    letters, numbers, white = (bpe.of_engine(k) for k in (r"\p{L}", r"\p{N}", r"\s"))
    assert bytes(cut.encode_ordinary(text)) == text.encode()
    # the pattern by hand, over classes of characters
    out, i, n = [], 0, len(text)
    kind = lambda c: "L" if c in letters else "N" if c in numbers else "s" if c in white else "o"
    while i < n:
        j = i
        short = next((e for e in ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d") if text.startswith(e, i)), None)
        if short:
            j = i + len(short)
        else:
            k = i + 1 if text[i] == " " and i + 1 < n and kind(text[i + 1]) != "s" else i
            what = kind(text[k])
            j = k
            while j < n and kind(text[j]) == what:
                j += 1
            if what == "s" and j < n and j - k > 1:
                j -= 1
        out.append(len(text[i:j].encode()))
        i = j
    return out


# 2 and 8 ------------------------------------------------------------------------------------------
SECRETS = ["", None, "PassWord = 'hunter2hunter2' tail", "token:short", "api_key=abcdefgh,apikey: ZZZZZZZZ", "AKIA" + "A" * 16, "AKIA12", "f" * 40 + "g", "é日 secret=\"" + "a" * 40 + '"', "password  password=abcdefghi"]
PII = ["", None, "mail a.b@c.de now", "x@y", "a@b.c_d@e.fg", "1.2.3.4 and 1.2.3.400 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 ok", "4111-1111-1111-1112", "call +1 (212) 555-0100.", "+12", "IBAN GB82WEST12345698765432 x", "GB82WEST12345698765433", "a@b..c@d.e", "é 日 001.02.3.4"]


def brute_spans(text, kinds):
    import re

    out = []
    for order, (kind, pattern, ok) in enumerate(kinds):
        out += [(order, m.start(), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    return out


def test_secrets(spark, tmp_path):
    from latmix.llm import secrets

    kinds = [
        ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)] * 2, "doc_id long, text string")
    ledger = str(tmp_path / "ledger")
    got = secrets.scan_documents(spark, rows, ledger).collect()
    assert len(got) == 2 * len(SECRETS)
    for r in got:
        want = ",".join(f"{k}:{a}:{b}" for a, o, b, k in sorted((a, o, b, k) for o, a, b, k in brute_spans(SECRETS[r["doc_id"]] or "", kinds)))
        assert r["spans"] == want and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    scanned = spark.read.parquet(ledger).count()
    assert scanned == len({t or "" for t in SECRETS})  # one of each blob
    secrets.scan_documents(spark, rows, ledger)
    assert spark.read.parquet(ledger).count() == scanned  # seen pairs are not scanned again
    assert secrets.scan_documents(spark, rows, ledger, "base-2").count() == len(got) and spark.read.parquet(ledger).count() == 2 * scanned
    marked = {r["doc_id"]: r["text"] for r in secrets.redact(spark, rows.distinct()).collect()}
    assert marked[2] == "[secret]' tail" and marked[0] == "" and marked[1] is None and marked[6] == SECRETS[6]
    assert secrets.scan_documents(spark, rows.where("false")).count() == 0


def test_pii(spark):
    from latmix.llm import pii

    def luhn(m):
        d = [int(c) for c in m[0] if c.isdigit()]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(reversed(d))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
    ]
    rng = random.Random(2)
    noise = ["".join(rng.choice("a1.@- +_(%é") for _ in range(60)) for _ in range(300)]
    texts = [*PII, *noise, "a." * 20_000 + "@x", "1" * 50_000, "a@" + "b." * 20_000 + "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).select("doc_id", "pii").collect():
        base = [(s["order"], s["start"], s["stop"], s["kind"]) for s in r["pii"] if s["kind"] != "iban"]
        assert base == sorted(brute_spans(texts[r["doc_id"]] or "", kinds)), texts[r["doc_id"]]
    spans = {r["doc_id"]: r["pii"] for r in pii.find(df).where("doc_id < 14").collect()}
    assert [s["kind"] for s in spans[10]] == ["iban"] and spans[11] == [] and spans[10][0]["score"] > 0.9


def test_pii_context(spark):
    from latmix.llm import pii

    def scores(text):
        df = spark.createDataFrame([(1, text, "own")], "doc_id long, text string, pii string")
        return [(s["kind"], round(s["score"], 3)) for s in pii.find(df).head()["pii"]]

    assert scores("the ship 10.0.0.1") == [("ip", 0.6)] and scores("IP 10.0.0.1") == [("ip", 0.9)]
    assert scores("hotel +1 212 555 0100") == [("phone", 0.6)] and scores("Tel.+1 212 555 0100") == [("phone", 0.9)]
    # words are near within 40 code points, and after the proposal before
    assert scores("call" + "é" * 36 + "+1 212 555 0100") == [("phone", 0.9)] and scores("call" + " " * 37 + "+1 212 555 0100") == [("phone", 0.6)]
    assert scores("x" + "call" + " " * 36 + "+1 212 555 0100") == [("phone", 0.6)]
    assert scores("server 10.0.0.1, 10.0.0.2") == [("ip", 0.9), ("ip", 0.6)]
    assert scores("") == scores(None) == []
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert [len(r["pii"]) for r in pii.find(same).collect()] == [1, 1]


# 3 and 6 --------------------------------------------------------------------------------------------
def test_toxicity_learns_a_word(spark):
    from latmix.llm import toxicity

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, words(rng, 40) + (" you scumword" if bad else "") + " " + words(rng, 5)))
        if i < 300:
            labels.append((i, 1, int(bad)))
    rows += [(400, None), (401, ""), (402, "word " * 20_000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(got) == 403 and all(got[i]["is_toxic"] == (i % 5 == 0) for i in range(400)) and not got[401]["is_toxic"] and not got[400]["is_toxic"]
    assert toxicity.toxicity(docs, lab.where("false")).where("is_toxic").count() == 0
    assert toxicity.toxicity(docs.where("false"), lab).count() == 0


def test_toxicity_uses_every_word_that_tells(spark):
    from latmix.llm import toxicity

    # 300 words that speak for toxic, each in 6 of 60 toxic rows: all pass LEAST_G2
    rng = random.Random(2)
    telling = [f"scum{k}x" for k in range(300)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        own = " ".join(w for k, w in enumerate(telling) if (k + i // 5) % 10 == 0) if bad else ""
        rows.append((i, f"{words(rng, 40)} {own}"))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert set(telling) <= set(toxicity.train(docs, lab).place)


def test_toxicity_needs_only_the_labels_it_uses(spark):
    from latmix.llm import toxicity

    rng = random.Random(6)
    rows = [(i, words(rng, 30) + (" scumword" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flagged = lambda lab: {r[0] for r in toxicity.toxicity(docs, lab).where("is_toxic").select("doc_id").collect()}
    want = {i for i in range(300) if i % 5 == 0}
    labels = lambda quality: spark.createDataFrame([(i, quality(i), int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    assert flagged(labels(lambda i: 1).withColumn("note", F.lit(None).cast("string"))) == want
    # every toxic row lacks a quality
    assert flagged(labels(lambda i: None if i % 5 == 0 else 1)) == want
    odd = spark.createDataFrame([(1, None, 1), (1, 0, None), (2, None, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in toxicity.memberships(odd, toxicity.CATEGORIES, 9).collect()}
    assert got == {(1, 1, 1, 0), (2, None, 0, 0)}


def test_logistic_converges():
    from latmix.llm import learn

    rng = np.random.default_rng(4)
    dense = rng.normal(size=(3000, 3)) * [1.0, 0.01, 30.0]
    found = [np.flatnonzero(rng.random(40) < 0.1) for _ in range(3000)]
    y = (rng.random(3000) < learn.sigmoid(dense @ [1.0, 80.0, 0.02] + [len(f) - 6.0 for f in found])).astype(float)
    used = rng.random(3000) < 0.8
    w = learn.fit_logistic(learn.Rows(found, 40, dense), y, used)
    x = np.zeros((3000, 44))
    for i, f in enumerate(found):
        x[i, f] = 1
    x[:, 40:43], x[:, 43] = dense, 1
    gradient = x.T @ (used * (learn.sigmoid(x @ w) - y)) + 0.3 * np.append(w[:-1], 0)
    assert np.abs(gradient).max() <= 1.01e-6 * used.sum()  # a row
    assert (learn.fit_logistic(learn.Rows([], 40, np.zeros((0, 3))), np.zeros(0))[:-1] == 0).all()


def test_quality_held_out(spark, sf):
    from latmix.llm import quality

    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs.union(docs.limit(1)), labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and got.score.between(0, 1).all()
    # what is held out tells the model nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.where("doc_id < 200")
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(few, x).collect()} for x in (labels, flipped))
    assert a == b
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert quality.score(odd, labels.where("false")).count() == 2 and quality.score(odd.where("false"), labels).count() == 0


# 4 and 5 ----------------------------------------------------------------------------------------------
def vectors(n=160, d=10):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d))
    x[40:80] = x[0] + 0.12 * rng.normal(size=(40, d))  # a group of near copies
    x[90:95] = x[3]
    rows = [(i, [float(v) for v in r], int(i % 3 == 1)) for i, r in enumerate(x)]
    return [*rows, (1000, None, 1), (1001, [0.0] * d, 1), (1002, [float("nan")] + [1.0] * (d - 1), 1), (1003, [None] + [1.0] * (d - 1), 1), (1004, rows[3][1], None), (1005, [1.0, 2.0], 1), (1006, [float("inf")] * d, 0)]


def test_embedding_links(spark, monkeypatch):
    from latmix.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "TILE", 16)
    rows = vectors()
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: l for i, _, l in rows}
    link = collections.defaultdict(set)
    for a in good:
        for b in good:
            if a != b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.93:
                link[a].add(b)
    for i in label:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(link[i]), min(seen), min(seen) == i)
    assert embed_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("false")).count() == 0
    monkeypatch.setattr(embed_dedup, "GROUP", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("g", "tile", "rows", "ok", "d")})
    assert {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark, df).collect()} == got


def test_huge_vectors(spark):
    from latmix.llm import ann, embed_dedup

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    x[20:30] = x[0] * np.logspace(-300, 300, 10)[:, None] / 4  # one direction at every length
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(100 + i, [float(v) for v in r], 1) for i, r in enumerate(rng.normal(size=(30, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(spark, df).collect()}
    assert all(got[i]["component_id"] == 0 and got[i]["n_links"] >= 10 for i in range(20, 30))
    near = collections.defaultdict(list)
    for r in ann.search(spark, df, F.col("vec_id") % 20 == 0).collect():
        near[r["query_id"]].append(r["vec_id"])
    # each length is searched by itself
    assert set(near) == {0, 20, 40, 100, 120} and all(len(v) == 20 and all((i >= 100) == (q >= 100) for i in v) for q, v in near.items())
    assert 29 in near[0]


def test_neighbours_recall(spark, sf):
    from latmix.llm import ann

    e = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in ann.search(spark, e, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    hits = total = 0
    for q, near in got.items():
        want = sorted(((-(x[q] @ v), i) for i, v in x.items() if i != q))[:20]
        assert len(near) == 20 and all(abs(s - x[q] @ x[i]) < 1e-9 for i, s in near) and q not in [i for i, _ in near]
        hits += len({i for _, i in want} & {i for i, _ in near})
        total += 20
    assert len(got) == sum(i % 20 == 0 for i in x) and hits / total >= 0.9
    odd = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    few = ann.search(spark, odd.where("vec_id IN (0, 1, 2, 1000, 1001, 1002, 1003)"), F.col("vec_id") % 20 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, 1), (0, 2)}
    assert ann.search(spark, odd.where("false"), F.lit(True)).count() == 0


# 7 --------------------------------------------------------------------------------------------------
def shingle_set(t):
    w = t.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_components(spark, docs, none):
    from latmix.llm import jaccard

    rng = random.Random(9)
    base = words(rng, 100).split()
    near = []
    for k in range(60):  # copies of one original, many of them too far from each other
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        near.append((100 + k, " ".join(t), "en", "s", 0))
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(near, DOCS))
    got = jaccard.similar(spark, df).collect()
    sets = {i: shingle_set(t) for i, t in [*text_of(), *((r[0], r[1]) for r in near)]}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(got) == df.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
    kept = [r["doc_id"] for r in jaccard.keep_one(spark, docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(i for i in {r[0] for r in corpus()} if find(i) == i)
    assert jaccard.similar(spark, none).count() == 0


def test_jaccard_long_lists(spark, monkeypatch):
    from latmix.llm import jaccard

    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "PER_SALT", 5)
    rng = random.Random(31)
    rows = []
    for f in range(3):  # families around one passage, of several lengths, many members too far from each other
        base = words(rng, 90).split()
        for k in range(40):
            t = base[: 60 + k]
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10**6)}"
            rows.append((f * 100 + k, " ".join(t)))
    rows += [(None, rows[0][1]), (900, rows[0][1]), (901, " ".join(base) * 40)]
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    at = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
        if all(at[at[a]] == at[a] for a in at) and all(at[a] == at[b] for a in sets for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
            break
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard.similar(spark, df).collect()]
    assert sorted(got, key=str) == sorted([*at.items(), (None, None)], key=str)
    monkeypatch.setattr(jaccard, "MOST_BITS", 0)  # stands for more entries than the filter may hold
    assert sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar(spark, df).collect()), key=str) == sorted(got, key=str)


def test_keep_one_of_clashing_and_null_ids(spark):
    from latmix.llm import jaccard

    rng = random.Random(14)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    rows = [(1, a), (2, a + " copy"), (2, b), (2, c), (None, d), (None, d + " copy"), (None, c + " copy"), (3, None), (3, None), (None, "")]
    got = [tuple(r) for r in jaccard.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda rs: sorted(map(repr, rs))
    assert len([r for r in got if r in rows[4:6]]) == 1
    assert key(r for r in got if r not in rows[4:6]) == key([(1, a), (2, b), (2, c), (3, None), (None, "")])


# 9 --------------------------------------------------------------------------------------------------
def test_repeats_removed(spark, docs, none):
    from latmix.llm import suffix

    rng = random.Random(3)
    passage = words(rng, 90)
    more = [(200 + i, words(rng, 50) + passage + words(rng, 50), "en", "s", 0) for i in range(6)] + [(300, words(rng, 20) + passage[:450] + "é" + passage[450:] * 2, "en", "s", 0)]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, DOCS))
    got = suffix.remove_repeats(spark, df).collect()
    rows = [(r[0], (r[1] or "").encode()) for r in [*corpus(), *more]]
    seen = collections.Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))
    want = {}
    for i, b in rows:
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = True
        want[i] = (len(b), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]
    assert suffix.remove_repeats(spark, none).count() == 0


def test_repeats_without_ids(spark):
    from latmix.llm import suffix

    rng = random.Random(12)
    fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two, three = fill(500), fill(500), fill(500)
    texts = [
        (None, fill(100) + one + fill(50)), (None, fill(70) + one + fill(80)), (None, fill(650)), (None, None), (1, fill(20) + two + fill(99)),
        # equal lengths under one doc_id
        (7, fill(60) + two + fill(60)), (7, fill(30) + three + fill(90)), (7, fill(620)), (8, fill(44) + three + fill(12)), (None, fill(9) + three + fill(200)),
    ]
    texts += [(None, texts[2][1] + one)] * 2  # copies without an id
    rows = [(t or "").encode() for _, t in texts]
    seen = collections.Counter(b[k : k + 400] for b in rows for k in range(len(b) - 399))
    want = collections.Counter()
    for (i, _), b in zip(texts, rows):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = True
        want[i, len(b), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()] += 1
    got = suffix.remove_repeats(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize("most", [2, 7])
def test_repeats_around_a_frequent_passage_are_split(spark, most):
    """An anchor with more contexts than a task may hold: its columns are halved, over several rounds, and no row differs."""
    from latmix.llm import suffix

    rng = random.Random(23)
    fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, lefts, rights = fill(110), [fill(330) for _ in range(4)], [fill(330) for _ in range(4)]
    texts = [
        (i, fill(rng.randrange(300)) + rng.choice(lefts)[-rng.randrange(1, 330) :] + phrase + rng.choice(rights)[: rng.randrange(1, 330)] + fill(rng.randrange(300)))
        for i in range(60)
    ]
    texts += [(100, lefts[0] + phrase), (101, phrase + rights[0]), (102, phrase), (103, None), (104, fill(50) + texts[0][1]), (105, lefts[1] + phrase + rights[1]), (105, lefts[1] + phrase + rights[1])]
    rows = [(t or "").encode() for _, t in texts]
    seen = collections.Counter(b[k : k + 400] for b in rows for k in range(len(b) - 399))
    want = collections.Counter()
    for (i, _), b in zip(texts, rows):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                cover[k : k + 400] = True
        want[i, len(b), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()] += 1
    assert sum(k[2] > 0 for k in want) > 20
    got = suffix.remove_repeats(spark, spark.createDataFrame(texts, "doc_id long, text string"), most).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_contexts_of_a_frequent_passage_meet_in_no_task(spark):
    """One anchor with a large part of all contexts: no task reads more than a few times its share of a shuffle's rows."""
    from latmix.llm import suffix

    rng = random.Random(31)
    fill = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = fill(300)
    texts = [(i, fill(rng.randrange(380, 500)) + phrase + fill(rng.randrange(380, 500))) for i in range(500)]
    texts += [(i, texts[i - 500][1][:600]) for i in range(500, 510)]
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    core, no_quantiles = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        core.listenerBus().waitUntilEmpty()
        found = core.statusStore().stageList(None, False, False, no_quantiles, None)
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before_it = set(stages())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = suffix.remove_repeats(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(8), 40).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n_removed"] == 600 for r in got) == sum(r["n_removed"] > 0 for r in got) == 20
    uneven = []
    for k, stage in stages().items():
        if k not in before_it and stage.shuffleReadRecords() >= 900:
            tasks = core.statusStore().taskList(k, stage.attemptId(), 1000)
            most = max(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))
            uneven.append((most / stage.shuffleReadRecords(), most, k))
    assert len(uneven) > 3 and max(uneven)[0] < 0.12, sorted(uneven)


# 10 -------------------------------------------------------------------------------------------------
def test_mixing(spark, docs, none, sf):
    from latmix.llm import mixing

    got = mixing.mix(spark, docs).collect()
    again = mixing.mix(spark, docs.repartition(3)).collect()
    key = lambda rows: sorted((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again) and len(got) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got) == sum(len(t.encode().split()) for _, t in text_of())
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect():
        by[r["source_size"], r["target"]][0] += r["taken"]
    for (size, target), (taken, _) in by.items():
        assert abs(taken - target) <= max(0.05 * target, 64), (size, target, taken)
    assert mixing.mix(spark, none).count() == 0
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    assert set(mixing.copies(spark, plain).columns) == set(plain.columns)


def test_mixing_blocks_do_not_grow_with_the_corpus(spark, monkeypatch):
    from latmix.llm import mixing

    rng = random.Random(8)
    rows = [(i, words(rng, 50), "en", "b" if i < 60 else "a" if i < 1000 else "c", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    taken = lambda: sorted((r["doc_id"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(spark, df).collect())
    want = taken()
    monkeypatch.setattr(mixing, "MOST_SLOTS", 64, raising=False)  # stood for a corpus of far more words; nothing reads it now
    got = taken()
    assert got == want
    small = [r for r in got if r[1] == 3000]
    assert abs(sum(r[3] for r in small) - small[0][2]) <= 0.02 * small[0][2]
    big = 40 * 10**9
    frame = spark.createDataFrame([(big - 1, big, big // 16)], "p long, source_size long, blocks long")
    got = frame.select(mixing.block_of("p").alias("k"), mixing.block_edge("blocks - 1").alias("e")).head()
    assert tuple(got) == (((big - 1) * (big // 16) + big // 16 - 1) // big, big - 16)


# all ------------------------------------------------------------------------------------------------
def plain_scores(chain, text):
    """The chain's probabilities, summed word by word."""
    from latmix.llm import toxicity

    found, style = toxicity.words_and_style(text)
    given = list(style)
    for w in chain.models:
        z = w[-1] + sum(w[chain.place[x]] for x in found if x in chain.place) + sum(a * b for a, b in zip(given, w[len(chain.place) : -1]))
        given.append(1 / (1 + np.exp(-z)))
    return given[len(style) :]


def plain_kept(rows):
    """The rows that stay of each component of documents that link, found by counting common shingles."""
    sets, parent, lists = [shingle_set(r["text"] or "") for r in rows], list(range(len(rows))), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = collections.Counter(j for g in own for j in lists[g])
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in own:
            lists[g].append(i)
    least = {}
    for i, r in enumerate(rows):
        key = find(i) if sets[i] else (r["doc_id"], r["text"])
        least[key] = min(least.get(key, i), i, key=lambda k: rows[k]["doc_id"])
    return sorted(repr(rows[i]) for i in least.values())


def plain_redacted(text):
    import re

    spans = [m.span() for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    secret = [0] * (len(text) + 1)  # 1: inside a secret; 2: a secret that touches none before it begins
    for start, stop in spans:
        secret[start:stop] = [x or 1 for x in secret[start:stop]]
    for start, _ in spans:
        if not any(a < start < b for a, b in spans):
            secret[start] = 2
    return "".join("[secret]" if k == 2 else "" if k else c for c, k in zip(text, secret))


def test_pipeline_stages(spark, sf):
    """Every stage against a plain version of it, each on what the stage before kept."""
    import duckdb
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from latmix.llm import mixing, toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(10**6, None, None), (10**6 + 1, "", None), (10**6 + 2, "token = abcdefgh12345678, " + "0" * 40, "odd"), (10**6 + 2, "word " * 3000, "odd"), (10**6 + 3, "word " * 3000 + "end", "odd")]
    docs = docs.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scan", "mixing", "bpe"]
    before, kept = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        got = out.collect()
        if name == "toxicity":
            chain = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            p = [plain_scores(chain, r["text"] or "")[chain.cats.index("toxic")] for r in kept]
            assert min(abs(x - 0.5) for x in p) > 1e-9
            assert sorted(map(repr, got)) == sorted(repr(r) for r, x in zip(kept, p) if x < 0.5)
            scored = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, sf).collect()}
            assert len(scored) == len(kept) - len(extra)
            own = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            for r in kept[: -len(extra)]:
                want = plain_scores(own, r["text"] or "")
                assert np.allclose([scored[r["doc_id"]][f"p_{c}"] for c in own.cats], want, atol=1e-9)
        elif name == "ngram_jaccard":
            assert sorted(map(repr, got)) == plain_kept(kept)
        elif name == "secret_scan":
            want = [r.asDict() | {"text": r["text"] and plain_redacted(r["text"])} for r in kept]
            assert sorted(repr(r.asDict()) for r in got) == sorted(map(repr, want)) and any("[secret]" in (r["text"] or "") for r in got)
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", before.toPandas().astype({"doc_id": "int64"}))
            want = collections.Counter()
            for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE_SQL})").fetchall():
                want[i] += int(taken / size + 0.5) if size else 1
            assert +collections.Counter(r["doc_id"] for r in got) == +want
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = [(r["doc_id"], r["source"], enc.encode_ordinary(r["text"] or "")) for r in kept]
            assert sorted(map(repr, ((r["doc_id"], r["source"], r["ids"]) for r in got))) == sorted(map(repr, want))
            break
        assert out.columns == docs.columns, name
        assert {repr(r) for r in got} <= {repr(r) for r in kept} or name == "secret_scan"
        before, kept = spark.createDataFrame(got, docs.schema), got
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_oracles(spark, sf):
    import duckdb

    from latmix.llm import registry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name


def clashing(df):
    """Columns with the names that operators use inside."""
    return df.withColumns({c: F.lit(f"own {c}") for c in ("blob", "spans", "whole", "rid", "n", "i", "h", "digest", "pii", "p_toxic", "p_junk", "is_toxic", "component", "link", "rank", "score", "d", "x", "block", "__rid")})


def test_clashing_columns_stay(spark):
    from latmix.llm import jaccard, mixing, secrets, toxicity

    rng = random.Random(21)
    rows = [(i, words(rng, 30) + (f" password = hunter2hunter{i}" if i % 4 == 0 else ""), f"s{i % 2}") for i in range(40)] + [(90, None, None), (91, "", "s1")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    for out in (secrets.redact(spark, df), mixing.copies(spark, df), jaccard.keep_one(spark, df), toxicity.without_toxic(df, labels)):
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in df.columns if c not in ("doc_id", "text", "source"))
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark, df).collect()}
    assert len(got) == 42 and got[90] is None and got[91] == ""
    assert all((got[i] == rows[i][1]) == (i % 4 > 0) and "hunter" not in got[i] for i in range(40))
    none = df.where("false")
    assert secrets.redact(spark, none).count() == mixing.copies(spark, none).count() == 0


def test_copies_do_not_follow_partitions(spark):
    from latmix.llm import mixing

    rng = random.Random(22)
    rows = [(i % 150 if i % 7 else None, words(rng, rng.randrange(1, 60)), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.copies(spark, df).collect()))
    for parts in (1, 3, 7):
        assert sorted(map(repr, mixing.copies(spark, df.repartition(parts, F.rand(parts))).collect())) == want


def test_many_spans_in_one_text(spark):
    import re

    from latmix.llm import spans

    text = "".join(f"é{'a' * (k % 5 + 1)} " for k in range(3000))
    got = spark.createDataFrame([(text,), ("",), (None,), ("zzz",)], "t string").select(spans.matches(F.col("t"), "(a+)").alias("m")).collect()
    assert [(m["start"], m["stop"], m["part"]) for m in got[0]["m"]] == [(m.start(), m.end(), m[1]) for m in re.finditer("(a+)", text)]
    assert [len(r["m"]) for r in got[1:]] == [0, 0, 0]


def test_components_of_chains_and_stars(spark):
    from latmix.llm import graph
    from latmix.llm.common import Scratch

    for n, limit in ((50, 12), (3000, 22)):
        edges = [(i, i + 1) for i in range(n)] + [(10**6, 10**6 + k) for k in range(1, 200)] + [(7 * 10**6, 8 * 10**6), (5, 5)]
        scratch = Scratch(spark, "test-graph")
        rounds, keep = [], scratch.keep
        scratch.keep = lambda df, name: (rounds.append(name), keep(df, name))[1]
        got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3), scratch, "g").collect()))
        assert all(got[i] == 0 for i in range(n + 1)) and all(got[10**6 + k] == 10**6 for k in range(200)) and got[8 * 10**6] == 7 * 10**6
        assert sum("-to" in r for r in rounds) <= limit
