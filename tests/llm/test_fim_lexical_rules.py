"""Fill-in-the-middle, ranked search and quality rules against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import DOCS, corpus

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["has <P> in it", "<", "<S", "é<M>", "日本語 \U0001f600 x", "a\nb\n\nb\n \nb", "#1 $2 & <b> |" * 9, "x" * 30_000 + " y", "A_b-C9é Ａ b a b a b a b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*corpus(), *((100 + i, t, None, "s0", 0) for i, t in enumerate(ODD)), (None, "no id at all", "de", "s1", 0), (None, None, None, None, None)]
    clash = {c: F.lit(1) for c in ("n", "form", "output", "rank", "score", "term", "shard", "value", "rule", "kept", "n_words", "_lang", "_text", "whole")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


# 11 -----------------------------------------------------------------------------------------------
def fim(doc_id, t):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim(spark, docs):
    from latmix.llm import fim as op

    made = op.transform(docs, "doc_id", "text", "n").withColumn("back", op.restore(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r["doc_id"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == collections.Counter((i, *fim(i, t)) for i, t in rows_of(docs))
    assert all(r["back"] == (r["text"] or "") and r["n"] == 1 for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert op.transform(docs.where("false"), "doc_id").count() == 0


def test_fim_units(spark, docs):
    from latmix.llm import fim as op

    edges = {"word": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}
    for unit, pattern in edges.items():
        made = op.transform(docs, "text", unit=unit, cut=100, seed=3).withColumn("back", op.restore(F.col("output"), F.col("form"))).collect()
        for r in made:
            t = r["text"] or ""
            assert r["back"] == t
            places = {0, *(m.end() for m in re.finditer(pattern, t))}
            assert list(op.boundaries(op.code_points(t), unit)) == sorted(places)
            if r["form"] != "plain":
                assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= places
    with pytest.raises(ValueError):
        op.boundaries(op.code_points("x"), "page")


# 12 -----------------------------------------------------------------------------------------------
def ranked(docs, items, k):
    """(item, text) -> scores of all documents, by hand."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(i, TERM.findall(lower(t))) for i, t in docs]
    docs = [(i, ts) for i, ts in docs if ts]
    n_docs, n_words = len(docs), sum(len(ts) for _, ts in docs)
    df = collections.Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text in items:
        got = []
        for i, ts in docs:
            tf, m, score = collections.Counter(ts), 75 + 25 * len(ts) * n_docs // n_words, 0
            for t in TERM.findall(lower(text)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                got.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, docs, small, monkeypatch):
    from latmix.llm import lexical as op
    from latmix.llm.common import Scratch

    if small:  # many shards of several rows, blocks of a few postings, many blocks of queries
        for name, value in {"SHARD_BYTES": 3000, "SHARD_DOCS": 5, "QUERY_BYTES": 60, "SINGLE": 1, "LONGEST": 3, "RUN": 4, "STEP": 1}.items():
            monkeypatch.setattr(op, name, value)
    items = [(1, "alpha1 BETA2 gamma3 alpha1"), (1, "one two"), (2, "nothing-here zzz"), (3, None), (4, "..."), (5, "x b é A_B"), (5, "x b é A_B"), (None, "delta7 tau9 phi3"), (6, " ".join(f"rho{k}" for k in range(40)))]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumns({"query": F.lit(1), "term": F.lit("")})
    index, n_docs = op.build(docs.repartition(3), Scratch(spark, "test"))
    distinct = [i for i in dict.fromkeys(items) if i[1]]
    for k in (1, 3, 20, 500):
        got = op.search(spark, index, n_docs, frame, k)
        assert sorted(repr(tuple(r)) for r in got.collect()) == ranked(rows_of(docs), distinct, k)
    none = op.build(docs.where("false"), Scratch(spark, "test"))
    assert op.search(spark, *none, frame).count() == 0 and op.search(spark, index, n_docs, frame.where("false")).count() == 0


def test_block_cuts_are_the_best(monkeypatch):
    from latmix.llm import lexical as op

    monkeypatch.setattr(op, "LONGEST", 5)
    monkeypatch.setattr(op, "PRICE", 40)
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 60, n) for n in (1, 2, 9, 17, 30, 30)]

    spots = [np.sort(rng.choice(90, len(x), replace=False)) for x in lists]

    def cost(x, at, ends):
        return sum(int(x[a:b].max() * (at[b - 1] + 1 - at[a])) + 40 for a, b in zip([0, *ends], ends))

    def least(x, at):
        best = [0]
        for i in range(1, len(x) + 1):
            best.append(min(best[j] + int(x[j:i].max() * (at[i - 1] + 1 - at[j])) + 40 for j in range(max(0, i - 5), i)))
        return best[-1]

    for x, at, ends in zip(lists, spots, op.cuts(lists, spots)):
        assert ends[-1] == len(x) and (np.diff(np.append(0, ends)) > 0).all() and np.diff(np.append(0, ends)).max() <= 5
        assert cost(x, at, list(ends)) == least(x, at)
    assert op.cuts([], []) == []


def test_search_skips_blocks(spark, monkeypatch):
    from latmix.llm import lexical as op

    shard = op.Shard(0, 6000, 60_000)
    rng = random.Random(3)
    for i in range(6000):
        shard.add(i, " ".join(["the"] * rng.randrange(1, 9) + ["rare"] * (i % 1500 == 7)).encode())
    rows = [r for b in shard.rows() for r in b.to_pylist()]
    lists, read = op.Lists(rows), []
    own = lists._read
    monkeypatch.setattr(lists, "_read", lambda edges, some, *a: read.append(int((edges[some + 1] - edges[some]).sum())) or own(edges, some, *a))
    best = lists.best([("the", 1), ("rare", 9000)], 4, op.NOTHING)
    assert sorted(best[2]) == [7, 1507, 3007, 4507] and sum(read) < 3000


# 13 -----------------------------------------------------------------------------------------------
def measured(t):
    ws = WORD.findall(t)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = collections.Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n, len(lines)


def verdicts(rows, least):
    """rows: (doc_id, text, lang, source). Quartiles of bucketed shares by hand."""
    got = [(i, la, so, measured(t or "")) for i, t, la, so in rows]

    def shares(m):
        n, chars, symbols, dups, repeats, _, lines = m
        return [100 * chars // max(n, 1), 1000 * symbols // max(n, 1), 1000 * dups // max(lines, 1), 1000 * repeats // max(n, 1)]

    def bucket(x):
        drop = max(x.bit_length() - 6, 0)
        return x >> drop << drop

    def fence(values, width):
        values = sorted(map(bucket, values))
        at = lambda q: values[-(-q * len(values) // 4) - 1]
        spread = 4 * max(at(3) - at(1), width)
        return at(1) - spread, at(3) + spread

    good = [(la, so, shares(m)) for _, la, so, m in got if not m[5]]
    out = []
    for i, la, so, m in got:
        for group in ([s for a, b, s in good if (a, b) == (la, so)], [s for a, b, s in good if a == la], [s for *_, s in good]):
            if len(group) >= least:
                break
        limits = [fence([s[k] for s in group], w) for k, w in enumerate((50, 50, 100, 100))] if group else []
        kept = not m[5] and all(lo <= x <= hi for x, (lo, hi) in zip(shares(m), limits))
        out.append((i, *m[:6], kept))
    return sorted(map(repr, out))


def test_quality_rules(spark, docs, monkeypatch):
    from latmix.llm import rules as op

    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 9) + str(rng.randrange(99)) for _ in range(n))
    more = [(1000 + i, prose(60 + i % 50), ["en", "de", None][i % 3], f"s{i % 2}", 0) for i in range(120)]
    more += [(2000, " ".join(w + "###" for w in prose(80).split()), "en", "s0", 0), (2001, "x" * 900 + " " + prose(60).replace(" ", "z" * 40 + " "), "de", "s1", 0), (2002, "\n".join([prose(9)] * 2 + [prose(4) for _ in range(20)]), "en", "s0", 0)]
    frame = docs.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in frame.select("doc_id", "text", "lang", "source").collect()]
    for least in (1, 15, 10**6):
        monkeypatch.setattr(op, "LEAST", least)
        got = op.verdicts(spark, frame)
        assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == verdicts(rows, least)
        kept = op.keep_good(spark, frame)
        assert kept.columns == frame.columns
        assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in op.verdicts(spark, frame.repartition(5)).where("kept").collect())
    assert not {2000, 2001} & {r["doc_id"] for r in kept.collect()} and sum(r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000 for r in kept.collect()) == 120
    assert op.verdicts(spark, docs.where("false")).count() == 0 and op.keep_good(spark, docs.where("false")).count() == 0


def test_rules_use_no_python(spark, docs):
    from latmix.llm import rules as op

    assert "Python" not in op.measured(docs, "doc_id")._jdf.queryExecution().toString()


def test_oracles(spark, sf):
    import duckdb

    from latmix.llm import fim, lexical, rules

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for m in (fim, lexical, rules):
        (name, query), = m.QUERIES.items()
        df = query(spark, sf)
        want = con.execute(m.ORACLE[name])
        assert [d[0] for d in want.description] == df.columns
        assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want.fetchall()))


# workers and repeated rows --------------------------------------------------------------------------
BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()

def held(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("latmix") is None
        yield b

spark.range(4).mapInArrow(held, "id long").count()
import __spark_entry__
from corpus_pipeline import encode
docs = spark.read.parquet(sys.argv[3] + "/documents.parquet").limit(40)
names = [n for n in __spark_entry__.queries() if n[:4] in ("op1_", "op11", "op12")]
for name in names:
    assert __spark_entry__.queries()[name](spark, sys.argv[3]).count() > 0
assert len(names) == 3 and encode(spark, docs, sys.argv[3]).count() == 40
print("fine")
"""


def test_workers_need_not_have_the_package(spark, sf, tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", BARE, repo, str(tmp_path), sf], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_neighbours_of_repeated_rows(spark, monkeypatch):
    from latmix.llm import ann

    monkeypatch.setattr(ann, "ROW_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    x[30:40] = x[0]  # ties
    rows = [(i, x[i].tolist()) for i in range(90)] + [(20, x[20].tolist()), (20, x[20].tolist()), (20, x[7].tolist()), (None, x[3].tolist()), (91, [1e308] * 3 + [-1e308] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("block", "query", "key", "ids_q", "rank", "x", "d", "asks")})
    for k in (5, 200):
        want = []
        own = [r for r in rows if r[0] is not None]
        for n, (i, q) in enumerate(own):
            if i % 20 == 0:
                score = ann.products(np.array([v for _, v in own]), np.array(q))
                near = sorted((-score[m], j) for m, (j, _) in enumerate(own) if m != n)[:k]
                want += [(i, r, j, f"{-s:.9g}") for r, (s, j) in enumerate(near, 1)]
        monkeypatch.setattr(ann, "TARGET", 1.0)
        got = [(r["query_id"], r["rank"], r["vec_id"], f"{r['score']:.9g}") for r in ann.search(spark, frame, F.col("vec_id") % 20 == 0, k).collect()]
        if k == 200:
            assert sorted(got) == sorted(want)
        assert len(got) == len(want) and len(set(want) & set(got)) >= 0.9 * len(set(want))
    big = ann.products(np.array([[1e308, 1e308, -1e308], [1e308, -1e308, 0.0], [3.0, 0.5, 0.0]]), np.array([1e10, 1e10, 1e10]))
    assert list(big) == [float("inf"), 0.0, 3.5e10]


def test_rows_that_differ_in_other_columns(spark):
    """Which of them stays, and how often, does not follow partitions."""
    from latmix.llm import jaccard, mixing

    rng = random.Random(31)
    text = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(6, 30))) for _ in range(6)]
    rows = [(i % 5, text[i % 6], f"s{i % 2}", i, None if i % 3 else f"x{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, other string")
    for op in (mixing.copies, jaccard.keep_one):
        want = sorted(map(repr, op(spark, df).collect()))
        assert want
        for parts in (1, 6):
            assert sorted(map(repr, op(spark, df.repartition(parts, F.rand(parts))).collect())) == want


def test_roots_of_a_chain():
    """Ascending chains of any length take few rounds."""
    from latmix.llm import embed_dedup

    n = 200_000
    assert (embed_dedup.roots(n, np.arange(n - 1), np.arange(1, n)) == 0).all()
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 3000, (2, 2200))
    got, want = embed_dedup.roots(3000, i, j), np.arange(3000)
    while True:
        new = want.copy()
        np.minimum.at(new, i, want[j])
        np.minimum.at(new, j, want[i])
        if (new == want).all():
            break
        want = new
    assert (got == want).all()


def test_tables_of_a_run_are_dropped(spark, sf):
    import os

    from latmix.llm import embed_dedup, lexical

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    for query in (embed_dedup.op4_embedding_dedup, lexical.op12_lexical):
        query(spark, sf).count()
    left = {t for d in set(os.listdir(root)) - before for t in os.listdir(f"{root}/{d}") if not t.startswith(".")}
    assert left == {"classes-out", "ranked"}


def test_probing_finds_the_radius(spark):
    """Probing by substrings gives every code within the radius, and no other."""
    from latmix.llm import ann

    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    codes = ann.Codes(x, np.abs(x).max(), np.linalg.norm(x / np.abs(x).max(), axis=1).max(), 20)
    rows = codes.of(x)
    index = ann.Index(rows)
    assert sum(codes.radii()) == codes.radius + 1 - ann.SUBSTRINGS and rows.shape[1] == ann.SUBSTRINGS
    for q in codes.of(x[:40], True):
        far = np.bitwise_count(rows ^ q).sum(1)
        got, probed = index.within(q, codes.radius, codes.radii())
        assert (got == np.flatnonzero(far <= codes.radius)).all() and len(probed) < len(rows)


# 6 and 9: plain versions, very long texts, clashing columns --------------------------------------------
def test_word_vectors_by_hand(spark, docs, monkeypatch):
    """Context sums over all neighbours, pooling and calibration against loops."""
    from latmix.llm import quality

    monkeypatch.setattr(quality, "FLUSH", 50)
    few = docs.where("doc_id < 16 OR doc_id > 100").withColumns({c: F.lit(1) for c in ("score", "held_out", "quality", "chunk", "x", "y")})
    texts = [r["text"] or "" for r in few.collect()]
    place, sign = quality.index_vectors()
    own, total, n = quality.Buckets(), np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros(quality.BUCKETS)
    for t in texts:
        ids = own.of(t)
        for a in range(len(ids)):
            n[ids[a]] += 1
            for b in range(max(0, a - quality.NEAR), min(len(ids), a + quality.NEAR + 1)):
                if b != a:
                    for k in range(quality.NONZERO):
                        total[ids[a], place[ids[b], k]] += sign[ids[b], k]
    mean = total / np.maximum(n, 1)[:, None]
    mean[n > 0] -= total.sum(0) / n.sum()
    want = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(few)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(quality.word_vectors(few.repartition(5)), got, atol=1e-7)
    pool = quality.Pool(got)
    for t in texts:
        ids = own.of(t)
        v = np.array([got[i] for i in ids], float).reshape(-1, quality.DIMS)
        x = pool.of(t)
        if len(ids):
            assert np.allclose(x[: quality.DIMS], v.mean(0), atol=1e-5) and np.allclose(x[quality.DIMS : 2 * quality.DIMS], v.std(0), atol=1e-3)
            assert np.allclose(x[2 * quality.DIMS : -3], got[np.unique(ids)].mean(0), atol=1e-5)
        else:
            assert not x.any()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = quality.Network().fit(x, y)
    apart = np.arange(400) % 5 == 4
    logit = net._logit((x[apart] - net.mean) / net.scale)
    loss = lambda s: float(np.mean(-np.log(np.where(y[apart] == 1, 1 / (1 + np.exp(-logit / s)), 1 - 1 / (1 + np.exp(-logit / s))))))
    assert all(loss(net.temperature) <= loss(s) + 1e-12 for s in np.geomspace(0.25, 8, 61))
    assert np.allclose(net.predict(x[apart]), 1 / (1 + np.exp(-logit / net.temperature)))


def test_quality_of_odd_tables(spark):
    from latmix.llm import quality

    rows = [(i, ("good words stand here " if i % 2 else "### *** $$$ ") * (1 + i % 5)) for i in range(60)] + [(60, "good words " * 40_000), (61, None), (61, None), (None, "good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("score", "held_out", "predicted", "quality", "lang", "source")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("own"))
    got = quality.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append((r["score"], r["predicted"]))
    assert sum(map(len, by.values())) == 64 and len(by[61]) == 2 and len(set(by[61])) == 1 and by[60][0][1] == 1
    assert sum(p == i % 2 for i in range(60) for _, p in by[i]) >= 54


def test_repeats_in_a_very_long_text(spark):
    from latmix.llm import suffix

    rng = random.Random(17)
    fill = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    shared = fill(900)
    long = fill(90_000) + shared + fill(60_000) + shared[100:700] + fill(40_000)
    texts = [(1, long), (2, fill(300) + shared[:500] + fill(300)), (3, "x" * 50_000), (4, fill(2000))]
    rows = [(i, t.encode()) for i, t in texts]
    seen = collections.Counter(hash(b[k : k + 400]) for _, b in rows for k in range(len(b) - 399))
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("t", "n_bytes", "anchor", "kept_sha256")})
    for r in suffix.remove_repeats(spark, frame).collect():
        b = dict(rows)[r["doc_id"]]
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                cover[k] += 1
                cover[k + 400] -= 1
        cover = np.cumsum(cover)[:-1] > 0
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(b), int(cover.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest())
