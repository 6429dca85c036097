"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.llm.common import bytes_of, pack_blocks, parts_for, store_blocks, text_bytes, tidied, unpack
from jobcast.session import store

ORDER = 5
HELD = 5
CHUNK = 1 << 20
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 24 << 20
BROADCAST_IDS = 2_000_000
BROADCAST_LANGUAGES = 10_000
QUANTILE = 0.995
#: Held-out texts from which on a language has variances and a quantile of its own.
FEW_TEXTS = 200
MARGIN = 1.05
#: Digits count as one sign, all white space as another; every other byte is itself.
SIGN = np.array([48 if 48 <= b < 58 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256)], np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text of each) of a block, in chunks: every byte with the ``ORDER - 1`` bytes before it in its text, as 40 bits.

    Before a text stand zero bytes.
    """
    for at in range(0, len(data), CHUNK):
        to = min(at + CHUNK, len(data))
        place = np.arange(at, to)
        text = np.searchsorted(offsets, place, "right") - 1
        depth = place - offsets[text]
        code = np.zeros(to - at, np.int64)
        for back in range(ORDER):
            lo = at - back
            piece = SIGN[data[max(lo, 0): to - back]].astype(np.int64)
            if lo < 0:
                piece = np.concatenate([np.zeros(min(-lo, to - at), np.int64), piece])[: to - at]
            piece[depth < back] = 0
            code |= piece << (8 * back)
        yield code, text


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    """Grams with the same context share a shard."""
    return ((code >> 8) ^ (code >> 15)) % shards


def shard_column(code: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(code, 8).bitwiseXOR(F.shiftright(code, 15)), F.lit(shards)).cast("int")


def squeezed(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, compressed."""
    return zstandard.compress(np.diff(values, prepend=values.dtype.type(0)).tobytes(), 3)


def widened(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), np.int64))


def gathered(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's different grams; those of its trusted texts and their counts."""
    rows = unpack(blob)
    data, offsets = bytes_of(rows)
    trusted = rows.column("teaches").to_numpy().astype(bool)
    every, own, count = [], [], []
    for code, text in grams(data, offsets):
        every.append(np.unique(code))
        if len(code := code[trusted[text]]):
            u, c = np.unique(code, return_counts=True)
            own.append(u)
            count.append(c)
    none = np.zeros(0, np.int64)
    cat = lambda x: np.concatenate(x) if x else none
    key, of = np.unique(cat(own), return_inverse=True)
    return np.unique(cat(every)), key, np.bincount(of, cat(count), len(key)).astype(np.int64)


def requests(shards: int):
    """(block, shard, asked, seen, counts): what each block wants to know and what its trusted texts add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                every, key, count = gathered(blob.as_py())
                at, of = shard_of(every, shards), shard_of(key, shards)
                for s in np.unique(at).tolist():
                    mine = of == s
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block], pa.int64()), "shard": pa.array([s], pa.int32()),
                        "asked": pa.array([squeezed(every[at == s])], pa.binary()), "seen": pa.array([squeezed(key[mine])], pa.binary()),
                        "counts": pa.array([zstandard.compress(count[mine].tobytes(), 3)], pa.binary())})
    return run


def summed(t: pa.Table) -> pa.Table:
    """Of one shard: every gram that some block has, with its count in trusted text."""
    asked = np.unique(np.concatenate([np.zeros(0, np.int64), *[widened(b) for b in t.column("asked").to_pylist()]]))
    total = np.zeros(len(asked), np.int64)
    for seen, counts in zip(t.column("seen").to_pylist(), t.column("counts").to_pylist()):
        total[np.searchsorted(asked, widened(seen))] += np.frombuffer(zstandard.decompress(counts), np.int64)
    return pa.table({"g": asked, "c": total})


def answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each block's grams of one shard, in ascending order, their log-probabilities."""
    out = {"block": [], "shard": [], "logs": []}
    order = np.argsort(right.column("g").to_numpy())
    known, logs = right.column("g").to_numpy()[order], right.column("logp").to_numpy()[order].astype(np.float32)
    for block, shard, asked in zip(*[left.column(c).to_pylist() for c in ("block", "shard", "asked")]):
        wanted = widened(asked)
        place = np.searchsorted(known, wanted)
        if len(wanted) and (not len(known) or (known[np.minimum(place, len(known) - 1)] != wanted).any()):
            raise ValueError(f"block {block} asks for grams that shard {shard} of the model does not have")
        out["block"].append(block)
        out["shard"].append(shard)
        out["logs"].append(zstandard.compress(logs[place].tobytes(), 1))
    return pa.table({"block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "logs": pa.array(out["logs"], pa.binary())})


def scored(shards: int):
    """A block's texts with the sum of their log-probabilities."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, blob in zip(left.column("block").to_pylist(), left.column("blob")):
            rows = unpack(blob.as_py())
            data, offsets = bytes_of(rows)
            codes = [code for code, _ in grams(data, offsets)]
            key = np.unique(np.concatenate([np.unique(c) for c in codes])) if codes else np.zeros(0, np.int64)
            del codes
            of, value = shard_of(key, shards), np.full(len(key), np.nan)
            for shard, logs in zip(right.column("shard").to_pylist(), right.column("logs").to_pylist()):
                value[of == shard] = np.frombuffer(zstandard.decompress(logs), np.float32)
            if np.isnan(value).any():
                raise ValueError(f"answers to block {block} are missing")
            total = np.zeros(rows.num_rows)
            for code, text in grams(data, offsets):
                mixed = np.sort(code << 20 | np.arange(len(code)))
                sorted_code, place = mixed >> 20, mixed & (CHUNK - 1)
                new = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]]))
                logs = value[np.searchsorted(key, sorted_code[new])]
                each = np.empty(len(code))
                each[place] = np.repeat(logs, np.diff(np.append(new, len(code))))
                start = np.flatnonzero(np.diff(text, prepend=-1))
                total[text[start]] += np.add.reduceat(each, start)
            out.append(rows.drop_columns(["text", "teaches"]).append_column("n_bytes", pa.array(np.diff(offsets))).append_column("logprob", pa.array(total)))
        return pa.concat_tables(out)
    return run


def discounts(n: list[int]) -> list[float]:
    """The three discounts of an order, from how many of its grams have counts 1, 2, 3 and 4."""
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]


def probabilities(counts: DataFrame) -> DataFrame:
    """(g, logp) for every gram of ``counts`` (g, c): interpolated modified Kneser-Ney, in joins on grams and contexts.

    The highest order uses counts, lower ones the number of different bytes that precede; the discounted share of a
    context goes to the order below, below the first stands an even chance of 1/256. Unseen grams are rows with c = 0.
    """
    levels = {ORDER: counts.where("c > 0")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = store(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count("*").alias("c")), "kn-level")
    sizes = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = None
    for k, level in levels.items():
        one = level.agg(F.lit(k).alias("k"), *sizes)
        found = one if found is None else found.unionByName(one)
    by = {r["k"]: discounts([r[f"n{i}"] or 0 for i in (1, 2, 3, 4)]) for r in found.collect()}  # one row per order
    low = None
    for k in range(1, ORDER + 1):
        d, level, c = by[k], levels[k], F.col("c")
        cut = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        context = level.groupBy(F.shiftright("g", 8).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
        wanted = counts.select("g") if k == ORDER else counts.select(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).distinct()
        joined = wanted.withColumn("h", F.shiftright("g", 8)).join(level, "g", "left").join(context, "h", "left")
        if low is None:
            joined, below = joined, F.lit(1 / 256)
        else:
            joined = joined.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(low.select(F.col("g").alias("s"), F.col("p").alias("q")), "s")
            below = F.col("q")
        own = F.when(c.isNull(), 0.0).otherwise(c - cut)
        low = store(joined.select("g", F.when(F.col("total") > 0, (own + F.col("freed") * below) / F.col("total")).otherwise(below).alias("p")), "kn-level")
    return low.select("g", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, trusted: DataFrame, text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, lang, text_hash, trusted, n_bytes, perplexity) for every row of ``docs``; ``trusted`` holds the trusted doc_ids.

    The model learns from the trusted texts but the held-out ones. The units are bytes: a model of order ``ORDER`` has few enough different grams for joins, whatever the language.
    Texts are packed into blocks. A block sends each of its different grams once, with the counts of its trusted texts,
    to the gram's shard. Shards add the counts up, the model is made of joins, and each shard answers each block with the
    log-probabilities it asked for; the texts are scored where the answers arrive. The blocks are a written table that
    every pass reads, so ``docs`` is read once and may give its rows in another order each time. Memory follows the block
    and the shard, both bounded; what travels follows the input. A missing or empty text has perplexity null. Trusted ids
    are broadcast if there are at most ``broadcast_ids``, else joined by shuffle.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    small = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                      F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    flagged = own.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("__id"), "left").withColumn(
        "trusted", F.col("__id").isNotNull()).drop("__id").withColumn("teaches", F.col("trusted") & ~held_out())
    total = text_bytes(docs, text)
    shards = parts_for(total, SHARD_BYTES)
    blocks = store_blocks(pack_blocks(flagged, BLOCK_BYTES), "kn-blocks", parts_for(total, BLOCK_BYTES))
    asked = store(blocks.mapInArrow(tidied(requests(shards)), "block long, shard int, asked binary, seen binary, counts binary"), "kn-requests")
    counts = store(asked.groupBy("shard").applyInArrow(tidied(summed), "g long, c long"), "kn-counts")
    model = probabilities(counts).withColumn("shard", shard_column(F.col("g"), shards))
    answers = asked.select("block", "shard", "asked").groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(tidied(answered), "block long, shard int, logs binary")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        tidied(scored(shards)), "doc_id long, lang string, text_hash long, trusted boolean, n_bytes long, logprob double")
    return out.select("doc_id", "lang", "text_hash", "trusted", "n_bytes",
                      F.when(F.col("n_bytes") > 0, F.exp(-F.col("logprob") / F.col("n_bytes"))).alias("perplexity"))


def spread(scores: DataFrame, quantile: float) -> DataFrame:
    """(of, texts, bytes, mean, between, within, z) of held-out texts (of, mean, n_bytes, perplexity), a row for each ``of``.

    The variance of a text's mean log-probability is ``between`` plus ``within`` over its bytes, by least squares; ``z`` is the
    ``quantile`` of the distances from ``mean`` in standard deviations.
    """
    off, size = F.log("perplexity") - F.col("mean"), F.col("n_bytes").cast("double")
    measured = scores.select("of", "mean", size.alias("n"), off.alias("off"), (size * off * off).alias("y"))
    slope, cut = F.col("slope"), F.col("intercept")
    flat = slope.isNull() | (slope < 0)
    parts = store(measured.groupBy("of", "mean").agg(
        F.count("*").alias("texts"), F.sum("n").alias("bytes"), F.regr_slope("y", "n").alias("slope"), F.regr_intercept("y", "n").alias("intercept"),
        F.avg("y").alias("level"), F.try_divide(F.sum("y"), F.sum("n")).alias("share")).select(
        "of", "mean", "texts", "bytes", F.when(flat, 0.0).when(cut < 0, F.col("share")).otherwise(slope).alias("between"),
        F.when(flat, F.coalesce("level", F.lit(0.0))).when(cut < 0, 0.0).otherwise(cut).alias("within")), "kn-spread")
    far = F.try_divide(F.col("off"), F.sqrt(F.col("between") + F.col("within") / F.col("n")))
    z = measured.select("of", "n", "off").join(parts, "of").groupBy("of").agg(F.percentile_approx(far, quantile, 10000).alias("z"))
    return parts.join(z, "of").withColumn("z", F.coalesce("z", F.lit(0.0)))


def classify_quality(docs: DataFrame, trusted: DataFrame, text: str = "text", quantile: float = QUANTILE, margin: float = MARGIN,
                     few_texts: int = FEW_TEXTS) -> DataFrame:
    """``perplexities`` with ``threshold`` and ``keep`` for every row.

    The threshold follows the text's length: the mean log-probability per byte of the language's held-out trusted texts, plus
    z standard errors of a text of so many bytes, as a perplexity times ``margin``. Variances and z are the language's own: z is the
    ``quantile`` of its held-out texts' standardised distances; the standard error includes that of the language's mean. A
    language with fewer than ``few_texts`` held-out texts takes variances and z, one (or a missing language) without any also
    the mean, of all languages together. Above its threshold a text is rejected. Texts without a perplexity, and all texts if no
    held-out one is trusted, are kept and have no threshold.
    """
    scores = store(perplexities(docs, trusted, text), "kn-scores")
    ours = store(scores.where(F.col("trusted") & held_out() & F.col("perplexity").isNotNull()).select(
        F.coalesce("lang", F.lit("")).alias("of"), "n_bytes", "perplexity"), "kn-held-out")
    mean = (F.sum(F.log("perplexity") * F.col("n_bytes")) / F.sum("n_bytes")).alias("mean")
    means = store(ours.groupBy("of").agg(mean), "kn-means")
    every = ours.agg(mean).first()["mean"]  # one number
    by = store(spread(ours.join(means, "of"), quantile), "kn-thresholds")
    # distances from each language's own mean, and from the mean of all
    pooled = spread(ours.join(means, "of").withColumn("off", F.log("perplexity") - F.col("mean")).select(
        F.lit("").alias("of"), F.lit(0.0).alias("mean"), "n_bytes", F.exp("off").alias("perplexity")), quantile).first()
    whole = spread(ours.withColumn("of", F.lit("")).withColumn("mean", F.lit(every).cast("double")), quantile).first()
    size = F.col("n_bytes")
    enough = F.col("texts") >= few_texts

    def pick(column: str) -> Column:
        return F.when(enough, F.col(column)).otherwise(F.lit(pooled[column] if pooled else None).cast("double"))

    own = F.col("mean") + pick("z") * F.sqrt(pick("between") * (1 + 1 / F.col("texts")) + pick("within") * (F.try_divide(F.lit(1.0), size) + 1 / F.col("bytes")))
    told = {c: F.lit(whole[c] if whole else None).cast("double") for c in ("z", "between", "within")}
    other = F.lit(every).cast("double") + told["z"] * F.sqrt(told["between"] + F.try_divide(told["within"], size))
    few = by.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    by = F.broadcast(by) if few else by
    joined = scores.join(by, F.coalesce("lang", F.lit("")) == F.col("of"), "left").withColumn("threshold", F.exp(F.coalesce(own, other)) * margin)
    return joined.select("doc_id", "lang", "text_hash", "trusted", "n_bytes", "perplexity", "threshold",
                         F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def held_out() -> Column:
    """One trusted text in ``HELD``, by a hash of its id: not learned from, so that its perplexity is that of new text."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose quality labels are all 1."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
