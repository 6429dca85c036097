"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.llm.common import tidied
from jobcast.session import store

WORDS = re.compile(r"[^\W\d_]+")
SAMPLE_DOCS = 12000
FEATURES = 768
FOLDS = 3
STEMS = (4, 6)
CACHED_WORDS = 200_000


def word_marks(word: str) -> list[str]:
    """The word itself and its beginnings of 4 and 6 letters: inflected forms share those."""
    return [word + "$", *[word[:n] + "*" for n in STEMS if len(word) > n]]


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def with_marks(docs: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """``columns`` and ``marks``, the different marks of the text's lower-cased words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted({m for w in words_of(t) for m in word_marks(w)}) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=[*columns, "marks"])

    own = docs.select(*columns, F.col(text).alias("__text"))
    return own.mapInArrow(tidied(run), T.StructType(own.drop("__text").schema.fields).add("marks", T.ArrayType(T.StringType())))


class Link:
    """One classifier of the chain: a category, the weights of its marks and of the earlier categories' probabilities."""

    def __init__(self, category: str, weights: dict[str, float], earlier: list[float], offset: float) -> None:
        self.category, self.weights, self.earlier, self.offset = category, weights, earlier, offset

    def probability(self, marks: Sequence[str], before: Sequence[float]) -> float:
        total = self.offset + sum(self.weights.get(m, 0.0) for m in marks) + sum(w * p for w, p in zip(self.earlier, before))
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))


def choose_marks(seen: DataFrame, n: float, p: float, d: Column, a: Column, features: int) -> list[str]:
    """The ``features`` marks with the largest chi-square against a category of ``p`` among ``n`` documents; on equal values the
    first in order. A mark is in ``d`` of the documents and in ``a`` of the category's; it must be in three at least."""
    if not 0 < p < n:
        return []
    d, a = d.cast("double"), a.cast("double")
    chi = F.pow(a * n - d * p, F.lit(2.0)) * n / (d * (n - d + 1) * p * (n - p))
    return [r["m"] for r in seen.where(d > 2).select("m", chi.alias("chi")).orderBy(F.desc("chi"), "m").limit(features).collect()]


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], text: str = "text", sample_docs: int = SAMPLE_DOCS,
              features: int = FEATURES, folds: int = FOLDS) -> list[Link]:
    """Fit the classifiers in the order of ``categories``, 0/1 columns of ``labels`` (doc_id, categories).

    The chain is fitted on about ``sample_docs`` labelled documents, chosen by a hash of the id: a bound on the fit, not on
    what it is applied to. Of a category, the ``features`` marks (see ``word_marks``) with the largest chi-square are used. Each later
    classifier is also given the earlier categories' probabilities; for training these come from models that did not see
    the document (``folds`` folds, whose marks, too, are chosen without it), so that it does not trust them more than it can
    later. A missing label or id teaches nothing about its category; of repeated labels the largest counts. A row weighs the
    inverse root of its value's share, so that a rare value counts for more. A category with a single value gets that value's
    share and no weights.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories]).dropna("all", subset=list(categories))
    share = min(1.0, sample_docs / max(1, known.count()))
    few = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) < share)
    sample = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("text")).join(few, F.col("id") == F.col("doc_id")).select("doc_id", *categories, "text")
    marked = store(with_marks(sample, ["doc_id", *categories], "text").withColumn(
        "fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int")), "toxic-sample")
    cells = [(i, k) for i in range(len(categories)) for k in range(folds)]

    def counts(what: str, value: Callable[[str], Column]) -> list[Column]:
        return [F.coalesce(F.sum(F.when(F.col("fold") == k, value(categories[i]))), F.lit(0)).alias(f"{what}{i}_{k}") for i, k in cells]

    sums = [*counts("d", lambda c: F.col(c).isNotNull().cast("long")), *counts("a", lambda c: F.col(c))]
    total = marked.agg(*sums).first()
    seen_in = store(marked.select("fold", *categories, F.explode("marks").alias("m")).groupBy("m").agg(F.count("*").alias("all"), *sums).where("all > 2"), "toxic-marks")
    chain: list[Link] = []
    data = marked
    for i, c in enumerate(categories):
        def fitted(without: int | None, data: DataFrame = data, i: int = i, c: str = c) -> Link:
            """The category's classifier from all folds, or from all but one."""
            used = [k for k in range(folds) if k != without]
            n, p = [float(sum(total[f"{what}{i}_{k}"] for k in used)) for what in ("d", "a")]
            d, a = [reduce(lambda x, y: x + y, [F.col(f"{what}{i}_{k}") for k in used]) for what in ("d", "a")]
            marks = choose_marks(seen_in, n, p, d, a, features)
            rows = data.where(F.col(c).isNotNull() & (F.lit(True) if without is None else F.col("fold") != without))
            return fit_link(rows, c, marks, [e.category for e in chain], p / n if n else 0.0)

        link = fitted(None)
        if c != categories[-1]:
            data = store(out_of_fold(data, [fitted(k) for k in range(folds)]), "toxic-folds")
        chain.append(link)
    return chain


def fit_link(rows: DataFrame, category: str, marks: list[str], earlier: Sequence[str], mean: float) -> Link:
    """One classifier from rows with ``marks``, the category and the earlier categories' probabilities."""
    if not marks:
        return Link(category, {}, [0.0] * len(earlier), float(np.log((mean + 1e-6) / (1 - mean + 1e-6))))
    seen = CountVectorizerModel.from_vocabulary(marks, "marks", "seen").setBinary(True).setMinTF(1.0).transform(rows)
    vectors = VectorAssembler(inputCols=["seen", *[f"p_{e}" for e in earlier]], outputCol="x").transform(seen)
    weight = F.when(F.col(category) == 1, mean ** -0.5).otherwise((1 - mean) ** -0.5)
    ready = store(vectors.select("x", category, weight.alias("weight")), "toxic-fit")
    model = LogisticRegression(featuresCol="x", labelCol=category, weightCol="weight", regParam=0.0005, maxIter=30, standardization=False).fit(ready)
    weights = model.coefficients.toArray().tolist()
    return Link(category, dict(zip(marks, weights)), weights[len(marks):], float(model.intercept))


def out_of_fold(rows: DataFrame, links: Sequence[Link]) -> DataFrame:
    """``rows`` with the category's probability by the classifier that has not seen the row's fold."""
    name, earlier = f"p_{links[0].category}", [c for c in rows.columns if c.startswith("p_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("marks", "fold", *earlier)}
            found = [links[fold].probability(marks, before) for marks, fold, *before in zip(*at.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, name])

    return rows.mapInArrow(tidied(run), T.StructType(list(rows.schema.fields)).add(name, "double"))


class Reader:
    """Finds a chain's marks in texts; remembers up to ``CACHED_WORDS`` words."""

    def __init__(self, chain: Sequence[Link]) -> None:
        self.chain, self.words = chain, {}
        self.every = frozenset().union(*[e.weights.keys() for e in chain])

    def marks(self, text: str | None) -> list[str]:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        known, found = self.words, set()
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(m for m in word_marks(w) if m in self.every)
            if own:
                found.update(own)
        return sorted(found)

    def probabilities(self, text: str | None) -> list[float]:
        marks, out = self.marks(text), []
        for e in self.chain:
            out.append(e.probability(marks, out))
        return out


def score_chain(docs: DataFrame, chain: Sequence[Link], text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain. Missing and empty texts have no marks: the offsets decide.

    Whole texts are read in one pass without a shuffle; columns with these names in the input are replaced.
    """
    names = [f"p_{e.category}" for e in chain]
    kept = docs.drop(*names)
    out_type = T.StructType(list(kept.schema.fields))
    for n in names:
        out_type = out_type.add(n, "double")
    shared = docs.sparkSession.sparkContext.broadcast(list(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            rows = [reader.probabilities(t.as_py()) for t in b.column(b.schema.get_field_index(text))]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[k] for r in rows], pa.float64()) for k in range(len(names))]],
                                             names=[*b.schema.names, *names])

    return kept.mapInArrow(tidied(run), out_type)
