"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each linear model sees the document's words and style and the
probabilities of the categories before it. In training these come from models that have not seen the
row (out-of-fold), neither in their weights nor in the choice of their words, so that a link does not
trust its predecessor more than it may at scoring.

Fitted on at most SAMPLE labelled rows (least by hash). Words enter as presence, every one that tells
a category by the likelihood-ratio statistic (LEAST_G2, in LEAST_COUNT rows or more): their number is
bounded by the sample. Training runs on sparse rows to convergence. Scoring is one pass over whole
texts without a shuffle.

Null or empty text: a document without words, scored like any other. Unlabelled documents are
scored. No labels at all, or one class only: every document gets the smoothed base rate. Repeated
rows: each is scored. An empty table: no rows. Other columns are ignored. A label that is null: the
row trains the categories whose membership the other label decides.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import lean, table
from .learn import SAMPLE, Rows, best_cut, fit_logistic, fold_of, sigmoid, texts, with_labels

#: In chain order: name, and what makes a labelled row a member.
#: They are made of the columns LABELS.
LABELS = ("quality", "toxic")
CATEGORIES: dict[str, Column | str] = {"junk": "quality = 0", "toxic": "toxic = 1", "abusive_prose": "toxic = 1 AND quality = 1"}
DECIDES, FOLDS, LEAST_COUNT, LEAST_G2 = "toxic", 5, 3, 10.83
STYLE = 5
_WORD = re.compile(r"[^\W_]+")


def words_and_style(text: str) -> tuple[set[str], list[float]]:
    words = _WORD.findall(text)
    n = max(len(words), 1)
    letters = max(len(text), 1)
    distinct = set(words)
    style = [
        np.log1p(len(words)) / 5,
        len(distinct) / n,
        sum(map(str.isupper, words)) / n,
        (len(text) - sum(map(len, words)) - text.count(" ")) / letters * 5,
        0.0 if words else 1.0,
    ]
    return {w.lower() for w in distinct}, style


def _member_words(batches):
    for batch in batches:
        cats = [c for c in batch.schema.names if c.startswith("y_")]
        rows = {"word": [], "fold": [], **{c: [] for c in cats}}
        for k, (_, text) in enumerate(texts(batch)):
            found = words_and_style(text)[0]
            rows["word"] += found
            rows["fold"] += [batch.column("fold")[k].as_py()] * len(found)
            for c in cats:
                rows[c] += [batch.column(c)[k].as_py()] * len(found)
        yield _arrow(rows)


def _arrow(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "word" else pa.int32()) for k, v in rows.items()})


def select_words(members: DataFrame, cats: list[str], totals: list[dict[str, int]], rows: list[dict[str, int]]) -> tuple[list[str], list[set[str]]]:
    """The words that tell the categories: all of them, and those that rows outside each fold tell and at
    last those that all rows tell. totals, rows: members of each category, and rows of known membership, by fold.
    """
    schema = "word string, fold int, " + ", ".join(f"y_{c} int" for c in cats)
    seen = members.select("doc_id", "text", "fold", *(f"y_{c}" for c in cats)).mapInArrow(lean(_member_words), schema)
    in_fold = lambda v, f: F.when(F.col("fold") == f, v)
    sums = [F.coalesce(F.sum(in_fold(F.col(f"y_{c}"), f)), F.lit(0)).alias(f"a_{c}_{f}") for c in cats for f in range(FOLDS)]
    sums += [F.count(in_fold(F.col(f"y_{c}"), f)).alias(f"n_{c}_{f}") for c in cats for f in range(FOLDS)]
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= LEAST_COUNT)
    chosen: list[set[str]] = [set() for _ in range(FOLDS + 1)]
    for word, told in counts.mapInArrow(lean(_telling(cats, totals, rows)), "word string, told array<boolean>").collect():  # bounded by the sample
        for own, yes in zip(chosen, told):
            if yes:
                own.add(word)
    return sorted(set().union(*chosen)), chosen


def _telling(cats: list[str], totals: list[dict[str, int]], rows: list[dict[str, int]]):
    """Words that tell a category by the likelihood-ratio statistic, for rows outside each fold and for all rows."""

    def term(o, e):
        return np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / e), 0.0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            told = np.zeros((batch.num_rows, FOLDS + 1), bool)
            for c in cats:
                of = lambda k: np.stack([batch.column(f"{k}_{c}_{f}").to_numpy() for f in range(FOLDS)]).astype(float)
                hits, seen = of("a"), of("n")
                for left_out in range(FOLDS + 1):
                    folds = [f for f in range(FOLDS) if f != left_out]
                    total, known = (sum(x[f][c] for f in folds) for x in (totals, rows))
                    if not 0 < total < known:
                        continue
                    share, a, n = total / known, hits[folds].sum(0), seen[folds].sum(0)
                    out, rest = total - a, known - n
                    g2 = 2 * (term(a, np.maximum(n, 1) * share) + term(n - a, np.maximum(n, 1) * (1 - share)) + term(out, rest * share + 1e-9) + term(rest - out, rest * (1 - share) + 1e-9))
                    told[:, left_out] |= (n >= LEAST_COUNT) & (g2 >= LEAST_G2)
            some = np.flatnonzero(told.any(1))
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(some)), pa.array(told[some].tolist(), pa.list_(pa.bool_()))], names=["word", "told"])

    return run


class Chain:
    """Linear models in chain order over word presence, style and earlier probabilities."""

    def __init__(self, cats: list[str], words: list[str], chosen: list[set[str]]):
        self.cats, self.place, self.models = cats, {w: i for i, w in enumerate(words)}, []
        #: Which words a fold's models may use; the last: those of all rows.
        self.used = [np.array([w in own for w in words], bool) for own in chosen]

    def features(self, text: str) -> tuple[np.ndarray, list[float]]:
        """(places of the words found, style)."""
        found, style = words_and_style(text)
        return np.array(sorted(self.place[w] for w in self.place.keys() & found), np.int32), style

    def rows(self, found: list[np.ndarray], style: np.ndarray) -> Rows:
        return Rows(found, len(self.place), style)

    def fit(self, x: Rows, ys: dict[str, np.ndarray], folds: np.ndarray) -> None:
        """ys: NaN where a row's membership is not known; such rows are no part of that category's model."""
        for c in self.cats:
            y = ys[c].astype(float)
            known = ~np.isnan(y)
            model = fit_logistic(x.only(self.used[-1]), y, known)
            unseen = np.zeros(len(y))
            for f in range(FOLDS):
                test, own = folds == f, x.only(self.used[f])
                unseen[test] = sigmoid(own.times(fit_logistic(own, y, known & ~test, model))[test])
            # the intercept moves so that 0.5 is the cut that is best on unseen rows
            cut = np.clip(best_cut(unseen[known], y[known]), 1e-4, 1 - 1e-4)
            shift = np.log(cut / (1 - cut))
            model[-1] -= shift
            self.models.append(model)
            z = np.log(np.clip(unseen, 1e-7, 1 - 1e-7) / np.clip(1 - unseen, 1e-7, 1)) - shift
            x = x.plus(sigmoid(z))

    def predict(self, x: Rows) -> np.ndarray:
        for w in self.models:
            x = x.plus(sigmoid(x.times(w)))
        return x.dense[:, STYLE:]


def memberships(labels: DataFrame, categories: dict[str, Column | str], most: int, columns=LABELS) -> DataFrame:
    """(doc_id, y_<category>), null where not known; one row per doc_id with a known one, least hashes first, at most ``most``.

    Of several rows of a document the least that decides a category is taken for it.
    """
    is_member = lambda c: (F.expr(c) if isinstance(c, str) else c).cast("int")
    rows = labels.where("doc_id IS NOT NULL").select("doc_id", F.struct(*columns).alias("__by"), *(is_member(v).alias(f"y_{c}") for c, v in categories.items()))
    least = lambda y: F.min(F.when(F.col(y).isNotNull(), F.struct("__by", y)))[y].alias(y)
    ys = [f"y_{c}" for c in categories]
    rows = rows.groupBy("doc_id").agg(*map(least, ys)).where(F.coalesce(*ys).isNotNull())
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, categories=None, most: int = SAMPLE) -> Chain:
    categories = categories or CATEGORIES
    cats = list(categories)
    sample = memberships(labels, categories, most)
    sample = sample.withColumn("fold", F.expr(f"crc32(cast(doc_id as string)) % {FOLDS}").cast("int"))
    members = with_labels(docs.select("doc_id", "text"), sample)
    by_fold = {r["fold"]: r for r in sample.groupBy("fold").agg(*(F.coalesce(f(f"y_{c}"), F.lit(0)).alias(f"{k}_{c}") for k, f in (("a", F.sum), ("n", F.count)) for c in cats)).collect()}
    totals, known = ([{c: by_fold[f][f"{k}_{c}"] if f in by_fold else 0 for c in cats} for f in range(FOLDS)] for k in "an")
    chain = Chain(cats, *select_words(members, cats, totals, known))

    def rows(batches):
        for batch in batches:
            got = []
            for k, (i, t) in enumerate(texts(batch)):
                found, style = chain.features(t)
                got.append((i, [batch.column(f"y_{c}")[k].as_py() for c in cats], found.tobytes(), np.array(style).tobytes()))
            yield pa_rows(got)

    def pa_rows(got):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int32())), *(pa.array([g[j] for g in got], pa.binary()) for j in (2, 3))], names=["doc_id", "y", "found", "style"])

    def fit(batches):
        import pyarrow as pa

        held = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("y", pa.list_(pa.int32())), ("found", pa.binary()), ("style", pa.binary())])).sort_by("doc_id")
        ids, ys, found, style = (held.column(c).to_pylist() for c in ("doc_id", "y", "found", "style"))
        x = chain.rows([np.frombuffer(b, np.int32) for b in found], np.array([np.frombuffer(b) for b in style]).reshape(-1, STYLE))
        y = np.array(ys, float).reshape(-1, len(cats))
        chain.fit(x, {c: y[:, i] for i, c in enumerate(cats)}, np.array([fold_of(i, FOLDS) for i in ids], int))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cats)), pa.int32()), pa.array([w.tobytes() for w in chain.models], pa.binary())], names=["k", "weights"])

    # the sample, and so the task that trains on it, is bounded; the driver gets the weights only
    sampled = members.mapInArrow(lean(rows), "doc_id long, y array<int>, found binary, style binary").repartition(1)
    chain.models = [np.frombuffer(r["weights"]) for r in sorted(sampled.mapInArrow(lean(fit), "k int, weights binary").collect())]
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with p_<category> for each category, in place of columns that have such a name."""
    mine = [f"p_{c}" for c in chain.cats]
    docs = docs.drop(*mine)
    names = docs.columns

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(names.index("text"))
            p = np.zeros((len(column), len(chain.cats)))
            for at in range(0, len(column), 512):
                part = [chain.features(t.as_py() or "") for t in column.slice(at, 512)]
                p[at : at + 512] = chain.predict(chain.rows([f for f, _ in part], np.array([s for _, s in part])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, i]) for i in range(p.shape[1]))], names=[*names, *(f"p_{c}" for c in chain.cats)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"p_{c} double" for c in chain.cats]
    return docs.mapInArrow(lean(scored), ", ".join(fields))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with p_<category> and ``is_toxic``."""
    return score(docs, train(docs, labels)).withColumn("is_toxic", F.col(f"p_{DECIDES}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns and no others."""
    chain = train(docs.select("doc_id", "text"), labels)
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*("text" if c == "text" else n for c, n in zip(docs.columns, names)))
    kept = score(plain, chain).where(F.col(f"p_{DECIDES}") < threshold)
    return kept.select(*(F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col(f"p_{DECIDES}").alias("score"), F.col("is_toxic").cast("int").alias("predicted"), *(f"p_{c}" for c in CATEGORIES))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
