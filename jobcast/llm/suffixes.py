"""Removal of repeated passages with a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.llm.common import bytes_of, ids_of, pack_blocks, parts_for, text_bytes, tidied, unpack
from jobcast.session import store

CHUNK = 1 << 18
INDEX_BITS = 20
#: A block gives each shard a run, so their number grows with the square of the input over both sizes.
BLOCK_BYTES = 6 << 20
SHARD_BYTES = 16 << 20
PART_BYTES = 16 << 20
#: Entries that enter a shard's family and are scanned at once.
BATCH = 1 << 17
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
#: A random 64-bit number for each byte value, the same everywhere.
BYTE = np.random.default_rng(20).integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0xD6E8FEB86659FD93
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, U(b))
            p[0] = U(1)
            _POWERS.append(np.multiply.accumulate(p))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * ODD
    return h ^ (h >> U(29))


class Entries:
    """Suffixes sampled from one chunk: those that start at an anchor, with the windows that the anchor stands for.

    Of every ``length`` bytes the anchor is the place where the hash of the next ``gram`` bytes is least (the first such
    place). Equal strings of that length therefore hold equal anchors at equal places, wherever they stand. Windows
    with one anchor start at neighbouring places ``first`` to ``last``. ``key`` is a hash of the gram, ``form`` of the whole
    neighbourhood that those windows cover, and of its extent on both sides.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start: int, stop: int, length: int, gram: int) -> None:
        self.length = length
        end = min(stop + length - 1, len(data))
        up, down = powers(CHUNK + 4 * length + 8)
        n = end - start
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data[start:end]] * up[:n], out=sums[1:])
        self.sums, self.down, self.start = sums, down, start
        m = n - length + 1
        self.first = self.last = self.key = self.form = np.zeros(0, np.int64)
        if m <= 0:
            return
        grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        low = (grams >> U(INDEX_BITS) << U(INDEX_BITS)) | np.arange(len(grams), dtype=U)
        wide, reach = 1, length - gram + 1
        while 2 * wide <= reach:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < reach:
            low = np.minimum(low[: len(low) - (reach - wide)], low[reach - wide:])
        anchor = (low[:m] & U((1 << INDEX_BITS) - 1)).astype(np.int64)
        inside = np.ones(m, bool)  # the window lies in one text
        lo, hi = np.searchsorted(offsets, [start, end], "left")
        for cut in offsets[lo: hi + 1].tolist():
            if start < cut < end:
                inside[max(0, cut - length + 1 - start): max(0, min(m, cut - start))] = False
        change = np.ones(m, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        self.first = np.flatnonzero(inside & change)
        stops = np.ones(m, bool)
        stops[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:]
        self.last = np.flatnonzero(inside & stops)
        at = anchor[self.first]
        self.key = mixed(grams[at] + ODD)  # anchors have small hashes, shards need even ones
        span = (sums[self.last + length] - sums[self.first]) * down[self.first]
        self.form = mixed(mixed(span) + U(3) * (at - self.first).astype(U) * ODD + (self.last - self.first).astype(U))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen entries: the entry's number, each window's place and the hash of its bytes."""
        first, size = self.first[chosen], self.last[chosen] - self.first[chosen] + 1
        entry = np.repeat(chosen, size)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        return entry, place, mixed((self.sums[place + self.length] - self.sums[place]) * self.down[place])


def chunks(data: np.ndarray) -> list[tuple[int, int]]:
    return [(s, min(s + CHUNK, len(data))) for s in range(0, len(data), CHUNK)]


class Sorted:
    """Keys of one block in order, each with the least document that has it; and where every input row went."""

    def __init__(self, key: np.ndarray, form: np.ndarray, doc: np.ndarray) -> None:
        lead = (key << U(24)) | (form >> U(24))  # one sort; only rows that agree so far are compared in full
        order = np.argsort(lead)
        tied = np.zeros(len(key) + 1, bool)
        tied[1:-1] = np.diff(lead[order]) == 0
        tied = np.flatnonzero(tied[1:] | tied[:-1])
        rows = order[tied]
        order[tied] = rows[np.lexsort((doc[rows], form[rows], lead[rows]))]
        del lead, tied, rows
        k, f, d = key[order], form[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
        self.key, self.form, self.doc = k[new], f[new], d[new]
        self.of = np.empty(len(k), np.int64)
        self.of[order] = np.cumsum(new) - 1

    def bounds(self, shards: int) -> np.ndarray:
        """Shards are ranges of the key: where each begins."""
        limits = [(s << 40) // shards for s in range(shards)]
        return np.searchsorted(self.key, np.array(limits, U)).tolist() + [len(self.key)]


def narrow(key: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40 bits of the key and 48 of the form travel."""
    return key >> U(24), form >> U(16)


def packed(s: Sorted, a: int, b: int) -> bytes:
    """A run of suffix entries: keys as differences, so that they compress."""
    k, d = s.key[a:b], s.doc[a:b]
    steps = np.diff(k, prepend=U(0)).view(np.uint8).reshape(-1, 8)[:, :5].T
    forms = np.ascontiguousarray(s.form[a:b]).view(np.uint8).reshape(-1, 8)[:, :6]
    base = int(d.min()) if b > a else 0
    docs = (d.view(U) - U(base % (1 << 64))).view(np.uint8).reshape(-1, 8).T
    raw = np.int64(b - a).tobytes() + np.int64(base).tobytes() + np.ascontiguousarray(steps).tobytes() + np.ascontiguousarray(docs).tobytes()
    return np.int64(len(raw)).tobytes() + zstandard.compress(raw, 1) + np.ascontiguousarray(forms).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob[8:])
    n, base = np.frombuffer(raw[:16], np.int64).tolist()
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw[16: 16 + 5 * n], np.uint8).reshape(5, n).T
    key = np.cumsum(wide.view(U).reshape(-1), dtype=U)
    docs = np.ascontiguousarray(np.frombuffer(raw[16 + 5 * n:], np.uint8).reshape(8, n).T).view(U).reshape(-1) + U(base % (1 << 64))
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob[len(blob) - 6 * n:], np.uint8).reshape(n, 6)
    return key, wide.view(U).reshape(-1), docs.view(np.int64)


class Family:
    """The logarithmic family of one shard: sorted runs of entries, each with its least document.

    A new run joins as the smallest level; levels of about equal size merge, so that sizes grow geometrically and an
    entry is moved a logarithmic number of times.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = Sorted(*[np.concatenate(c) for c in zip(*runs)])
        return s.key, s.form, s.doc

    def add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(run[0]):
            run = self.merged([self.levels.pop(), run])
        self.levels.append(run)

    def settle(self) -> None:
        """After the last run all levels merge. An entry then stands once, with its least document, so one neighbourhood is never taken for two."""
        self.levels = [self.merged(self.levels)]

    def scan(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each entry of a run: the least document that has it, and the least and the greatest that have its gram in any neighbourhood."""
        key, form, doc = run
        least, other, most = doc.copy(), np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), np.iinfo(np.int64).min)
        for lk, lf, ld in self.levels:
            a, b = np.searchsorted(lk, key, "left"), np.searchsorted(lk, key, "right")
            has = np.flatnonzero(b > a)
            if not len(has):
                continue
            starts = np.stack([a[has], b[has]], axis=1).reshape(-1)
            # least and greatest document of the gram, whatever its neighbourhood; the last slot guards the end
            low = np.minimum.reduceat(np.append(ld, np.iinfo(np.int64).max), starts)[::2]
            high = np.maximum.reduceat(np.append(ld, np.iinfo(np.int64).min), starts)[::2]
            other[has], most[has] = np.minimum(other[has], low), np.maximum(most[has], high)
            # neighbourhoods are in order behind the gram: halve the range where there are several
            lo, hi, left = a[has], b[has], np.flatnonzero(b[has] - a[has] > 1)
            while len(left):
                mid = (lo[left] + hi[left]) // 2
                less = lf[mid] < form[has[left]]
                lo[left[less]], hi[left[~less]] = mid[less] + 1, mid[~less]
                left = left[lo[left] < hi[left]]
            hit = (lo < b[has]) & (lf[np.minimum(lo, len(lf) - 1)] == form[has])
            rows = has[hit]
            least[rows] = np.minimum(least[rows], ld[lo[hit]])
        return least, other, most


def batches(t: pa.Table) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """The runs of a shard by block, as many at a time as make a batch: with many blocks and shards each run is short."""
    rows, runs, size, blobs = [], [], 0, t.column("blob")
    for i in np.argsort(t.column("block").to_numpy(), kind="stable").tolist():
        rows.append(i)
        runs.append(unpacked(blobs[i].as_py()))
        size += len(runs[-1][0])
        if size >= BATCH:
            yield rows, runs
            rows, runs, size = [], [], 0
    if rows:
        yield rows, runs


def shard_scan(t: pa.Table) -> pa.Table:
    """All runs of one shard enter its family, in batches; then every batch is scanned against it.

    A run's codes, 0: no smaller document has the entry nor, in part, its neighbourhood; 1: one has the entry; 2: others share the
    gram with another neighbourhood, and the windows must be compared.
    """
    family, codes = Family(), [b""] * t.num_rows
    for _, runs in batches(t):
        family.add(Family.merged(runs))
    family.settle()
    for rows, runs in batches(t):
        key, form, doc = (np.concatenate(c) for c in zip(*runs))
        s = Sorted(key, form, doc)
        least, other, most = (x[s.of] for x in family.scan((s.key, s.form, s.doc)))
        code = np.where(least < doc, 1, np.where(other < most, 2, 0)).astype(np.uint8)
        for i, part in zip(rows, np.split(code, np.cumsum([len(r[0]) for r in runs])[:-1])):
            codes[i] = zstandard.compress(part.tobytes(), 1)
    return pa.table({"block": t.column("block"), "shard": t.column("shard"), "codes": pa.array(codes, pa.binary())})


def looked_up(runs: DataFrame) -> DataFrame:
    return runs.groupBy("shard").applyInArrow(tidied(shard_scan), "block long, shard int, codes binary")


def entries_of(rows: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[Entries], np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = bytes_of(rows)
    each = [Entries(data, offsets, s, e, length, gram) for s, e in chunks(data)]
    cat = lambda name, kind: np.concatenate([getattr(c, name).astype(kind, copy=False) for c in each] or [np.zeros(0, kind)])
    key, form = narrow(cat("key", U), cat("form", U))
    place = np.concatenate([c.first + c.start for c in each] or [np.zeros(0, np.int64)])
    return data, offsets, each, key, form, np.searchsorted(offsets, place, "right") - 1


def out_runs(block: int, s: Sorted, shards: int) -> pa.Table:
    b = s.bounds(shards)
    full = [i for i in range(shards) if b[i + 1] > b[i]]
    return pa.table({"block": pa.array([block] * len(full), pa.int64()), "shard": pa.array(full, pa.int32()),
                     "blob": pa.array([packed(s, b[i], b[i + 1]) for i in full], pa.binary())})


def codes_in(t: pa.Table, s: Sorted, shards: int) -> np.ndarray:
    """The codes of a block's rows, in the order in which they went in."""
    codes, b = np.zeros(len(s.key), np.uint8), s.bounds(shards)
    for shard, blob in zip(t.column("shard").to_pylist(), t.column("codes").to_pylist()):
        codes[b[shard]: b[shard + 1]] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return codes[s.of]


def partial_windows(t: pa.Table, rows: pa.Table, length: int, gram: int, shards: int):
    """Entries found whole in a smaller document, and the windows of those that may be found in part."""
    data, offsets, each, key, form, text = entries_of(rows, length, gram)
    docs = ids_of(rows)
    s = Sorted(key, form, docs[text])
    code = codes_in(t, s, shards)
    whole = (code == 1) | (docs[text] > s.doc[s.of])
    part = (code == 2) & ~whole
    at, sub, places, hashes = 0, [], [], []
    for c in each:
        n = len(c.first)
        entry, place, w = c.windows(np.flatnonzero(part[at: at + n]))
        sub.append(entry + at)
        places.append(place + c.start)
        hashes.append(w)
        at += n
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    entry, place, w = cat(sub, np.int64), cat(places, np.int64), cat(hashes, U)
    wk, wf = narrow(mixed(w), w)
    return data, offsets, each, docs, text, whole, entry, place, Sorted(wk, wf, docs[text[entry]])


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 18, text: str = "text") -> DataFrame:
    """``docs`` with ``spans`` (array of byte start, end) and ``kept`` (binary) for every row.

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id;
    overlaps count, strings are judged on the input. Texts are UTF-8 bytes, a missing text is empty; matches never cross
    documents. Rows that share a doc_id are one document here and never remove each other; a missing doc_id counts as the
    largest. Columns named ``spans`` or ``kept`` in the input are replaced, all others stay.

    Texts are packed into blocks, the batches. A block's sparse suffix array holds the suffixes at anchors (see
    ``Entries``), in the order of their fingerprints, and is cut into ranges, the shards. A shard adds the runs of all
    blocks to its family of levels (``Family``) and scans each run against them. An entry found whole in a smaller document
    is settled. One whose gram stands elsewhere in another neighbourhood, as at the ends of a match, is compared
    window by window in a second round over those entries only. Within a block equal entries travel once, so a
    passage in every document gives a shard one entry per block. The blocks are a written table that every pass reads, so
    ``docs`` may give its rows in another order each time; its texts are shuffled once, compressed.
    """
    spark = docs.sparkSession
    kept_columns = docs.drop("spans", "kept")
    total = text_bytes(docs, text)
    parts, shards = parts_for(total, PART_BYTES), parts_for(total, SHARD_BYTES)
    named = kept_columns.withColumnRenamed(text, "__text") if text != "text" else kept_columns
    column = "text" if text == "text" else "__text"
    packed_blocks = store(pack_blocks(named, BLOCK_BYTES, column), "suffix-blocks")
    blocks = packed_blocks.repartition(parts, "block")

    def rows_of(blob: bytes) -> pa.Table:
        t = unpack(blob)
        return pa.table({"doc_id": t.column("doc_id"), "text": t.column(column)})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                rows = rows_of(blob.as_py())
                _, _, _, key, form, at = entries_of(rows, length, gram)
                yield from out_runs(block, Sorted(key, form, ids_of(rows)[at]), shards).to_batches()

    run_type = "block long, shard int, blob binary"
    first = store(looked_up(packed_blocks.mapInArrow(tidied(emit), run_type)), "suffix-codes")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("blob", pa.binary())]).empty_table()]
        for block, blob in zip(left.column("block").to_pylist(), left.column("blob")):
            out.append(out_runs(block, partial_windows(right, rows_of(blob.as_py()), length, gram, shards)[-1], shards))
        return pa.concat_tables(out)

    windows = looked_up(blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(tidied(second), run_type))
    both = first.withColumn("round", F.lit(1)).unionByName(windows.withColumn("round", F.lit(2)))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out_type = T.StructType([*kept_columns.schema.fields, T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob"):
            whole_rows = unpack(blob.as_py())
            rows = rows_of(blob.as_py())
            rounds = [right.filter(pa.compute.equal(right.column("round"), r)) for r in (1, 2)]
            data, offsets, each, docs_, text_, whole, entry, place, s = partial_windows(rounds[0], rows, length, gram, shards)
            edge = np.zeros(len(data) + 1, np.int32)
            first_, last_ = (np.concatenate([getattr(c, n) + c.start for c in each] or [np.zeros(0, np.int64)]) for n in ("first", "last"))
            hit = (codes_in(rounds[1], s, shards) == 1) | (docs_[text_[entry]] > s.doc[s.of])
            np.add.at(edge, first_[whole], 1)
            np.add.at(edge, last_[whole] + length, -1)
            np.add.at(edge, place[hit], 1)
            np.add.at(edge, place[hit] + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans, kept = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                g = gone[a:b]
                if g.any():
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    spans.append([{"start": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()])
                    kept.append(data[a:b][~g].tobytes())
                else:
                    spans.append([])
                    kept.append(data[a:b].tobytes())
            names = [text if c == column else c for c in whole_rows.schema.names]
            out.append(pa.Table.from_arrays([*whole_rows.columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                                            names=[*names, "spans", "kept"]))
        return pa.concat_tables(out) if out else empty

    empty = spark.createDataFrame([], out_type).toArrow()
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(tidied(last), out_type)


def digests(found: DataFrame) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
