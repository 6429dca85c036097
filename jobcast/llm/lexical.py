"""Ranked lexical search the other way round: the items' terms are indexed, all documents stream past the index."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobcast.llm.common import ids_of, parts_for, text_bytes, tidied
from jobcast.session import store

#: Bytes of item texts that one index holds: what is broadcast follows them. More items are searched in several passes.
ITEM_BYTES = 4 << 20
#: Scores, and additions to them, that a task holds at a time.
CELLS = 2_000_000
#: Heaps of tasks are merged in this many groups first.
MERGES = 64
NO_ID = np.iinfo(np.int64).max
#: Letters and digits of ASCII, capitals as small letters, and all bytes of other characters stay; the rest ends a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


class Index:
    """Inverted index of items: for each term the items that hold it, and how often."""

    def __init__(self, keys: list[bytes], texts: list[str | None]) -> None:
        held: dict[bytes, list[tuple[int, int]]] = {}
        for item, text in enumerate(texts):
            for term, n in Counter(terms_of(text)).items():
                held.setdefault(term, []).append((item, n))
        self.keys = keys
        self.number = {term: i for i, term in enumerate(held)}
        self.ends = np.cumsum([0, *map(len, held.values())], dtype=np.int64)
        both = np.array([p for own in held.values() for p in own], np.int64).reshape(-1, 2)
        self.item, self.times = both[:, 0].copy(), both[:, 1].copy()

    def counts(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """A document's terms with repeats, and the numbers and counts of those that items hold."""
        terms, number = terms_of(text), self.number
        own = [(number[t], n) for t, n in Counter(terms).items() if t in number]
        return len(terms), [i for i, _ in own], [n for _, n in own]


class Heaps:
    """The ``top`` best (score, document) of each item: highest score, then smallest document."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.heaps = top, [[] for _ in range(items)]
        #: What a document must beat: the last place's score and document, once an item has ``top``.
        self.score, self.doc = np.zeros(items, np.int64), np.full(items, -1, np.int64)

    def update(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` has a row for each document and a column for each item."""
        ahead = (scores > self.score) | ((scores == self.score) & (docs[:, None] < self.doc))
        if len(docs) > self.top:  # no more than the best of these rows can enter, but for ties
            ahead &= scores >= np.partition(scores, len(docs) - self.top, axis=0)[-self.top]
        row, item = np.nonzero(ahead & (scores > 0))
        order = np.lexsort((docs[row], -scores[row, item], item))
        row, item = row[order], item[order]
        first = np.searchsorted(item, item, "left")
        best = np.arange(len(item)) - first < self.top
        for r, i in zip(row[best].tolist(), item[best].tolist()):
            entry, heap = (int(scores[r, i]), -int(docs[r])), self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.score[i], self.doc[i] = heap[0][0], -heap[0][1]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def rows_in(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the offsets of its rows."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0]: ends[-1]].astype(np.int64), ends - ends[0]


def scores_of(index: Index, weight: np.ndarray, n_docs: int, n_terms: int, lengths: np.ndarray, term: np.ndarray, tf: np.ndarray,
              ends: np.ndarray) -> np.ndarray:
    """Scores of some documents for all items: each document's terms are looked up, each posting adds to its item."""
    size = np.array([25 + 75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)  # numbers without a bound in between
    doc = np.repeat(np.arange(len(lengths)), np.diff(ends))
    value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * size[doc]))
    held = index.ends[term + 1] - index.ends[term]
    place = np.arange(int(held.sum())) + np.repeat(index.ends[term] - (np.cumsum(held) - held), held)
    scores = np.zeros(len(lengths) * len(index.keys), np.int64)
    np.add.at(scores, np.repeat(doc, held) * len(index.keys) + index.item[place], np.repeat(value, held) * index.times[place])
    return scores.reshape(len(lengths), len(index.keys))


def slices(index: Index, term: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose scores and additions stay within ``CELLS``, one document at least."""
    added = np.concatenate([[0], np.cumsum(index.ends[term + 1] - index.ends[term])])[ends]
    at, rows = 0, max(1, CELLS // max(1, len(index.keys)))
    while at < len(ends) - 1:
        to = min(at + rows, int(np.searchsorted(added, added[at] + CELLS, "right")) - 1, len(ends) - 1)
        to = max(to, at + 1)
        yield at, to
        at = to


def search_block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    """(key, doc_id, score): the best documents of the items of one bounded block."""
    spark = docs.sparkSession
    rows = block.toArrow()
    index = spark.sparkContext.broadcast(Index(rows.column("key").to_pylist(), rows.column("text").to_pylist()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [index.value.counts(t.as_py()) for t in b.column(1)]
            ints = pa.list_(pa.int32())
            out = pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], ints), pa.array([f[2] for f in found], ints)],
                names=["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.compute.greater(out.column("n"), 0))

    counts = store(docs.mapInArrow(tidied(counted), "doc_id long, n long, terms array<int>, tf array<int>"), "lexical-counts")
    sums = counts.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(index.value.number), np.int64)
        for b in batches:
            df += np.bincount(rows_in(b.column(0))[0], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    # one row per term of the bounded block
    held = counts.select("terms").mapInArrow(holding, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(index.value.number), np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = spark.sparkContext.broadcast(weights(n_docs, df))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = index.value
        heaps = Heaps(len(i.keys), top)
        for b in batches:
            ids, lengths = ids_of(pa.Table.from_batches([b])), b.column(1).to_numpy()
            (term, ends), (tf, _) = rows_in(b.column(2)), rows_in(b.column(3))
            for at, to in slices(i, term, ends):
                part = slice(ends[at], ends[to])
                scores = scores_of(i, weight.value, n_docs, n_terms, lengths[at:to], term[part], tf[part], ends[at: to + 1] - ends[at])
                heaps.update(scores, ids[at:to])
        for key, heap in zip(i.keys, heaps.heaps):
            if heap:
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(heap), pa.binary()), "score": pa.array([s for s, _ in heap], pa.int64()),
                    "doc_id": pa.array([None if -d == NO_ID else -d for _, d in heap], pa.int64()), "task": pa.array([at_task()] * len(heap), pa.int32())})

    def at_task() -> int:
        from pyspark import TaskContext
        return TaskContext.get().partitionId() % MERGES

    return merged(counts.mapInArrow(tidied(streamed), "key binary, score long, doc_id long, task int"), top)


def merged(heaps: DataFrame, top: int) -> DataFrame:
    """The heaps of all tasks, merged in groups of tasks first, so that no task reads the heaps of all of them."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("key", "task").orderBy(*best))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*best))).where(F.col("rank") <= top).drop("task")


def search(docs: DataFrame, items: DataFrame, top: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Terms, weights and the integer score are those of the registered query's contract: w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    w * (10**9 * tf div (1000 * tf + 8m)) for each of an item's terms, repeats included. Different item texts are put
    into an inverted index, which is broadcast. One pass over the whole documents stores of each the number of terms
    and the counts of the indexed ones; N, L and df are sums over all of these. A second pass streams the stored counts
    through the index and keeps a heap of ``top`` documents for each item in a task; heaps are merged in two steps.

    An index holds about ``item_bytes`` of item texts (one text at least): items beyond that are searched in further
    passes, each with its own index, so that what is broadcast has a bound. Equal scores go by ascending doc_id,
    documents without a doc_id last. Missing texts have no terms; an item without terms in any document has no rows.
    Each row of ``items`` gets ranks of its own, also where ids or texts repeat; each row of ``docs`` is a document,
    repeated or not. Other columns are not looked at; an empty table on either side gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn(
        "key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = asked.groupBy("key").agg(F.first("text").alias("text"))
    blocks = parts_for(text_bytes(texts), item_bytes, least=1)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    found = reduce(DataFrame.unionByName, [search_block(own, texts.where(block == i), top) for i in range(blocks)])
    return asked.join(found, "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
