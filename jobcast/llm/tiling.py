"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobcast.llm.common import tidied
from jobcast.session import store

SEED_WORDS = 5
COVERAGE = 0.8
BROADCAST_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(6).integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)
#: ASCII letters and digits and all bytes of other scripts make words, the rest stands between them.
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
PAIR_TYPE = "doc_id long, item_id long, n_tokens int, n_covered int, n_tiles int, coverage double"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(size, U(b))])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _POWERS[size]


def tokens(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of the lower-cased text; an empty array for a missing text.

    Long texts are hashed in pieces cut between words, so memory does not follow the text.
    """
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    out, at = [], 0
    while at < len(data):
        to = min(at + SLICE_BYTES, len(data))
        while to < len(data) and IN_WORD[data[to]] and IN_WORD[data[to - 1]]:
            to += 1
        piece = data[at:to]
        word = IN_WORD[piece]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        up, down = powers(len(piece))
        sums = np.concatenate([[U(0)], np.cumsum(BYTE[piece] * up[: len(piece)], dtype=U)])
        h = ((sums[end] - sums[start]) * down[start] + (end - start).astype(U)) * ODD
        out.append(h ^ (h >> U(32)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, U)


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, U)
    up, down = powers(len(words))
    sums = np.concatenate([[U(0)], np.cumsum(words * up[: len(words)], dtype=U)])
    h = (sums[size:] - sums[:-size]) * down[: len(words) - size + 1] * ODD
    return h ^ (h >> U(29))


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of the tiles, longest first.

    Running Karp-Rabin: runs of ``size`` unmarked words of the document are looked up among those of the item, matches
    are extended, and the longest are marked if no word of theirs is marked yet; then the search goes on with the
    length of the longest match left, down to ``least``. A word belongs to one tile at most on either side.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    while size >= least:
        where = defaultdict(list)
        open_item = np.flatnonzero(runs(free_item, size))
        for p, h in zip(open_item.tolist(), rolled(item, size)[open_item].tolist()):
            where[h].append(p)
        seeds = rolled(doc, size)
        open_doc = np.flatnonzero(runs(free_doc, size) & np.isin(seeds, np.array(list(where), U)))
        marked = False
        for q in open_doc.tolist():
            for p in where.get(int(seeds[q]), ()):
                if free_item[p: p + size].all() and free_doc[q: q + size].all() and (item[p: p + size] == doc[q: q + size]).all():
                    free_item[p: p + size] = free_doc[q: q + size] = False
                    found.append((p, q, size))
                    marked = True
        if not free_item.any() or not marked and size == least:
            break
        size = next_size(item, doc, free_item, free_doc, size, least)
    return found


def runs(free: np.ndarray, size: int) -> np.ndarray:
    """Whether all ``size`` words from a place on are unmarked."""
    if len(free) < size:
        return np.zeros(0, bool)
    count = np.concatenate([[0], np.cumsum(free)])
    return count[size:] - count[:-size] == size


def next_size(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, size: int, least: int) -> int:
    """The length of the longest match of unmarked words below ``size``, by halving; below ``least`` if there is none."""
    def any_match(n: int) -> bool:
        a, b = rolled(item, n)[runs(free_item, n)], rolled(doc, n)[runs(free_doc, n)]
        return len(a) > 0 and len(b) > 0 and bool(np.isin(a, b).any())

    low, high = least - 1, size - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if any_match(mid) else (low, mid - 1)
    return low


def near_seeds(doc: np.ndarray, hit: np.ndarray, size: int) -> np.ndarray:
    """The words that seeds cover; a gap becomes one word that equals nothing in any item."""
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    inside = np.cumsum(edge[:-1]) > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.where(inside, doc, U(0))[keep]


class Items:
    """Tokens of benchmark items and an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], size: int) -> None:
        self.size, self.ids = size, [i for i, _ in rows]
        self.words = [tokens(t) for _, t in rows]
        seeds = [rolled(w, min(size, len(w))) if len(w) >= size else np.zeros(0, U) for w in self.words]
        flat, of = np.concatenate(seeds or [np.zeros(0, U)]), np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.lexsort((of, flat))
        self.seed, self.of = flat[order], of[order]
        self.known = np.unique(flat)

    def match(self, doc_id: int | None, words: np.ndarray, coverage: float) -> Iterator[tuple]:
        """The items of which tiles in the document cover at least ``coverage``."""
        seeds = rolled(words, self.size)
        if not len(seeds) or not len(self.known):
            return
        at = np.minimum(np.searchsorted(self.known, seeds), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == seeds)
        if not len(hit):
            return
        a, b = np.searchsorted(self.seed, seeds[hit], "left"), np.searchsorted(self.seed, seeds[hit], "right")
        places = np.repeat(hit, b - a)
        inner = np.arange(len(places)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        item = self.of[np.repeat(a, b - a) + inner]
        order = np.argsort(item, kind="stable")
        for k, own in zip(*groups(item[order], places[order])):
            n = len(self.words[k])
            shared = np.flatnonzero(np.isin(rolled(self.words[k], self.size), seeds[own]))
            if len(np.unique(shared[:, None] + np.arange(self.size))) < coverage * n:  # not even overlapping seeds reach it
                continue
            cut = tiles(self.words[k], near_seeds(words, own, self.size), self.size)
            covered = sum(t[2] for t in cut)
            if covered >= coverage * n:
                yield doc_id, self.ids[k], n, covered, len(cut), covered / n


def groups(keys: np.ndarray, values: np.ndarray) -> tuple[list, list]:
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[start].tolist(), np.split(values, start[1:]) if len(keys) else []


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, size: int = SEED_WORDS,
                 broadcast_bytes: int = BROADCAST_BYTES, text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, n_tiles, coverage): items of which tiles cover at least ``coverage``.

    Words are lower-cased runs of ASCII letters, digits and all characters beyond ASCII. Pairs come from shared runs of ``size`` words;
    greedy string tiling then counts each word of the item once, so passages are found in any order and with
    other text in between. Items with fewer than ``size`` words, missing texts and missing item ids match nothing; a document
    without an id gives rows without one. Repeated rows each count.

    The seeds of the benchmark are broadcast if its texts have at most ``broadcast_bytes``: the documents are then
    read once and nothing is shuffled. A larger benchmark is joined with the documents on their seeds by shuffle, and only
    documents and items that share one meet.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if held <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in items.orderBy("item_id", "text").collect()], size))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [r for i, t in zip(b.column(0).to_pylist(), b.column(1)) for r in shared.value.match(i, tokens(t.as_py()), coverage)]
                yield pairs_batch(rows)

        return own.mapInArrow(tidied(scan), PAIR_TYPE)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                found = np.unique(rolled(tokens(b.column(1)[k].as_py()), size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(found), pa.int64()), pa.array(found)], names=["id", "seed"])

    # rows are told apart by id and text: either may repeat
    marked = [store(d.groupBy(c, "text").agg(F.count("*").alias("times")).withColumn("id", F.xxhash64(c, "text")), n)
              for d, c, n in ((own, "doc_id", "tile-docs"), (items, "item_id", "tile-items"))]
    left, right = [m.select("id", "text").mapInArrow(tidied(seeds), "id long, seed long") for m in marked]
    met = left.join(right.withColumnRenamed("id", "item"), "seed").select("id", "item").distinct()
    paired = met.join(marked[0], "id").select("item", F.col("doc_id"), F.col("text").alias("doc_text"), F.col("times").alias("doc_times")) \
        .join(marked[1].withColumnRenamed("id", "item"), "item").select("doc_id", "doc_text", "item_id", "text", F.explode(F.array_repeat(F.lit(1), (F.col("doc_times") * F.col("times")).cast("int"))))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, dt, i, it, _ in zip(*[c.to_pylist() for c in b.columns]):
                yield pairs_batch(list(Items([(i, it)], size).match(d, tokens(dt), coverage)))

    return paired.mapInArrow(tidied(tile), PAIR_TYPE)


def pairs_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                      names=["doc_id", "item_id", "n_tokens", "n_covered", "n_tiles", "coverage"])
