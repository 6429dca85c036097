"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.llm.common import tidied
from jobcast.llm.components import components
from jobcast.session import store

SEED = 42
HOT = 256
STEP = 1 << 14
#: Odd constants that turn one 64-bit hash into the next words of a longer fingerprint.
SPREAD = 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, in arrays of bounded length."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    for at in range(0, n, STEP):
        spans = zip(starts[at: min(at + STEP, n)].tolist(), last[at: at + STEP].tolist())
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int, words: int) -> list[int]:
    """``words`` 64-bit words; a bit is set if it is in over half of the shingles' hashes. No shingles: zero."""
    return majority(shingle_hashes(text, width), words)


def majority(hashes: Iterable[np.ndarray], words: int) -> list[int]:
    total, sums = 0, np.zeros((words, 64), np.int64)
    for h in hashes:
        total += len(h)
        for w in range(words):
            if w:
                h = (h ^ (h >> np.uint64(29))) * np.uint64(SPREAD)
                h ^= h >> np.uint64(32)
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for cut in range(0, len(bits), 255):
                sums[w] += bits[cut: cut + 255].sum(axis=0, dtype=np.uint8)
    out = np.packbits((2 * sums > total).astype(np.uint8), axis=1, bitorder="little").reshape(-1)
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp): ``fp`` is an array of ``words`` longs. A missing text has no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), width, words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), F.col(text).cast("string")).mapInArrow(
        tidied(run), "doc_id long, text_hash long, fp array<long>")


def segment(fp: Column, s: int, bits: int) -> Column:
    """Bits ``s * bits`` and following of the fingerprint; a segment may span two of its words."""
    word, shift = divmod(s * bits, 64)
    low = F.shiftrightunsigned(fp[word], shift)
    if shift + bits > 64:
        low = low.bitwiseOR(F.shiftleft(fp[word + 1], 64 - shift))
    return low.bitwiseAND(F.lit((1 << bits) - 1))


def distance(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[w].bitwiseXOR(b[w])) for w in range(words)])


def links_of(classes: DataFrame, words: int, segments: int, bits: int, radius: int, hot: int = HOT) -> DataFrame:
    """(a, b): ids of different fingerprints that differ in at most ``radius`` bits and in at most one bit of some segment.

    ``classes`` has one row (id, fp) per distinct fingerprint. With ``radius < 2 * segments`` that is every pair within
    the radius. Each fingerprint looks up its own segments and, of the ball of one bit around them, those keys where a
    set bit is cleared: of two segments that differ in one bit, one side always finds the other.

    A key with more than ``hot`` entries, or within the ball of such a key, may be looked up by many and is not compared
    pair by pair. Whoever looks it up is a member and links to the member with the least id, if within the radius:
    prober rather than entry, so that the keys of one group of near copies agree on few leaders. Components over all
    links found so far then leave only members outside the key's largest component, and these are compared with the
    others of the key. By the triangle inequality two members whose distances from the leader differ by more than the
    radius are not linked; for the others the join itself compares the fingerprints that its rows carry, so that
    only links leave it. No link is lost.
    """
    fp = F.col("fp")
    own = F.array(*[F.struct(F.lit(s).alias("s"), segment(fp, s, bits).alias("key")) for s in range(segments)])
    entries = store(classes.select("id", F.explode(own).alias("e")).select("id", F.col("e.s").alias("s"), F.col("e.key").alias("key")), "entries")
    full = store(entries.groupBy("s", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("s", "key"), "full")
    one = F.lit(1).cast("long")
    ball = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(
        F.col("key").bitwiseAND(F.call_function("shiftleft", one, i)) != 0,
        F.col("key").bitwiseXOR(F.call_function("shiftleft", one, i)))), lambda k: k.isNotNull())
    around = full.select("s", F.explode(ball).alias("key")).distinct().join(entries, ["s", "key"], "left_semi")
    crowded = store(full.unionByName(around).distinct(), "crowded")
    # place 0 is the fingerprint's own key
    probes = entries.select(F.col("id").alias("p"), "s", F.posexplode(F.concat(F.array("key"), ball)).alias("place", "key"))
    return compared(entries, probes, crowded, classes, words, radius)


def compared(entries: DataFrame, probes: DataFrame, crowded: DataFrame, classes: DataFrame, words: int, radius: int) -> DataFrame:
    """(a, b) of the pairs that meet in a key and are within the radius; see ``links_of`` for crowded keys."""
    some = crowded.limit(1).count() > 0
    if some:
        quiet = entries.join(crowded, ["s", "key"], "left_anti")
    else:
        quiet = entries
    met = probes.join(quiet, ["s", "key"]).where((F.col("place") > 0) & (F.col("p") != F.col("id")) | (F.col("p") < F.col("id")))
    pairs = met.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b"))
    found = store(near_pairs(pairs, classes, words, radius), "links")
    if not some:
        return found
    looked = store(probes.join(crowded, ["s", "key"]).select("s", "key", F.col("p").alias("b")), "looked")
    members = store(looked.join(looked.groupBy("s", "key").agg(F.min("b").alias("a")), ["s", "key"]), "members")
    spokes = store(measured(members.select("a", "b"), classes, words), "spokes")
    linked = spokes.where((F.col("d") <= radius) & (F.col("a") != F.col("b"))).select("a", "b")
    so_far = store(found.unionByName(linked).distinct(), "links")
    label = components(so_far).withColumnRenamed("node", "b")
    placed = store(members.join(spokes, ["a", "b"]).join(label, "b", "left").select(
        "s", "key", F.col("b").alias("id"), F.coalesce("component", "b").alias("component"), "d"), "placed")
    sizes = placed.groupBy("s", "key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("s", "key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("kinds"))
    split = store(placed.join(largest.where("kinds > 1").drop("kinds"), ["s", "key"]).join(classes, "id"), "split")
    rest = split.where("component <> largest").select(
        "s", "key", F.col("id").alias("other"), F.col("component").alias("theirs"), F.col("d").alias("far"), F.col("fp").alias("print"))
    across = split.join(rest, ["s", "key"]).where(F.expr("component <> theirs and (component = largest or id < other)") & (
        F.abs(F.col("d") - F.col("far")) <= radius) & (distance(F.col("fp"), F.col("print"), words) <= radius))
    others = across.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return store(so_far.unionByName(others).distinct(), "links")


def measured(pairs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(a, b, d): the distinct pairs and the bits in which they differ. With one word an id is its fingerprint."""
    if words == 1:
        return pairs.distinct().select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"))
    left, right = classes.select(F.col("id").alias("a"), F.col("fp").alias("fa")), classes.select(F.col("id").alias("b"), F.col("fp").alias("fb"))
    return pairs.distinct().join(left, "a").join(right, "b").select("a", "b", distance(F.col("fa"), F.col("fb"), words).alias("d"))


def near_pairs(pairs: DataFrame, classes: DataFrame, words: int, radius: int) -> DataFrame:
    """The distinct pairs whose whole fingerprints are within the radius."""
    return measured(pairs, classes, words).where(F.col("d") <= radius).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3, words: int = 1, segments: int = 2, bits: int = 32, radius: int = 2,
                    text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) for every row of ``docs``.

    Fingerprints of 64 * ``words`` bits over shingles of ``width`` words (fewer words: the whole sequence; none or a
    missing text: zero, linked like any other). Fingerprints within ``radius`` bits are linked; ``component`` is a
    number that the rows of a component share, ``component_id`` the smallest doc_id reachable. Equal fingerprints are one
    class from the start, so copies never meet as pairs. Repeated doc_ids keep a row each; rows without a doc_id get
    the component of their fingerprint. ``text_hash`` is XXH64 of the text. An empty table gives an empty result.
    """
    prints = store(fingerprints(docs, width, words, text), "fingerprints")
    key = F.col("fp")[0] if words == 1 else F.xxhash64("fp")
    classes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("id", key), "classes")
    label = components(links_of(classes.select("id", "fp"), words, segments, bits, radius, hot))
    linked = store(classes.join(label.withColumnRenamed("node", "id"), "id").select("id", "component", "rep"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    joined = linked.join(least, "component").select("id", "component", "least")
    known = store(classes.join(joined, "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component"), F.coalesce("least", "rep").alias("component_id")), "known")
    return prints.join(known, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Of ``docs`` one row for each component of ``near_duplicates``: the smallest doc_id, then the smallest hash of the text.

    A row without a doc_id stays only if its component has no other. Of rows with equal doc_id and text one stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    chosen = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    again = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows")).where("__rows > 1")
    same = F.col("__id").eqNullSafe(F.col("__other")) & (F.col("__hash") == F.col("__print"))
    chosen = store(chosen.join(again.select(F.col("__id").alias("__other"), F.col("__hash").alias("__print"), "__rows"), same, "left").select(
        "__id", "__hash", F.col("__rows").isNotNull().alias("__again")), "chosen")

    def rows_of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left_semi")

    once = rows_of(chosen.where("not __again"))
    repeated = chosen.where("__again")
    if not repeated.limit(1).count():
        return once
    return once.unionByName(rows_of(repeated).withColumn("__hash", F.xxhash64(text)).dropDuplicates(["doc_id", "__hash"]).drop("__hash"))
