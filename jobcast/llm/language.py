"""Language identification of mixed-language text: script ranges, word scores and a Viterbi path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.llm.common import tidied

BUCKETS = 1 << 15
DOCS_PER_LANGUAGE = 4000
MAX_LANGUAGES = 256
SWITCH = 8.0
SMOOTH = 0.5
CACHED_WORDS = 200_000
SLICE = 512
LETTERS = re.compile(r"[^\W\d_]+")
#: Fractions, exponents, number letters and digits: the class above takes most of them for letters.
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(128, 0x20000)) if c.isalnum() and not c.isalpha()) + "]")
UNKNOWN = "und"
SPANS = T.ArrayType(T.StructType().add("first", "integer").add("end", "integer").add("lang", "string"))
#: First code points of script ranges, and the script from there on (0: Latin and what is not listed).
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80,
                          0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1400, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000,
                          0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SCRIPT_OF = np.array([0, 1, 2, 3, 4, 5, 0, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 0, 21, 22, 0, 1, 0, 23, 24, 24, 0, 19, 0, 24, 5, 24])
SCRIPTS = 25


def scripts(codes: np.ndarray) -> np.ndarray:
    return SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, codes, "right") - 1]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words' character trigrams (edges marked), the word of each, and each word's script (of its first letter)."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    edge = np.flatnonzero(codes == 32)
    h = codes[:-2] * 0x9E3779B1 + codes[1:-1] * 0x85EBCA77 + codes[2:] * 0xC2B2AE3D
    centre = np.arange(1, len(codes) - 1)
    keep = codes[centre] != 32
    h = (h ^ (h >> 17)) * 0x27D4EB2F
    return ((h ^ (h >> 15)) & (BUCKETS - 1))[keep], (np.searchsorted(edge, centre, "right") - 1)[keep], scripts(codes[edge[:-1] + 1])


class Model:
    """Log-probabilities of trigram buckets per language, and which languages use which script."""

    def __init__(self, languages: list[str], counts: np.ndarray, letters: np.ndarray) -> None:
        self.languages = languages
        self.logs = (np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * BUCKETS)).astype(np.float32)
        share = letters / np.maximum(letters.sum(axis=0), 1)
        use = share >= 0.01
        use[~use.any(axis=1)] = True  # a script without a language of its own leaves all
        self.use = use


class Scorer:
    """Word scores, remembered for up to ``CACHED_WORDS`` words, and the best path through a text's words."""

    def __init__(self, model: Model, switch: float) -> None:
        self.m, self.switch, self.known = model, switch, {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known, self.table = {}, self.table[:0]
        new = list(set(words).difference(self.known))
        if new:
            bucket, of, script = word_grams(new)
            start = np.flatnonzero(np.diff(of, prepend=-1))
            scores = np.add.reduceat(self.m.logs[bucket], start, axis=0)
            scores = np.where(self.m.use[script], scores, scores.min(axis=1, keepdims=True) - 20)
            scores -= scores.max(axis=1, keepdims=True)
            base = len(self.table)
            self.known.update(zip(new, range(base, base + len(new))))
            self.table = np.concatenate([self.table, scores.astype(np.float32)])
        known = self.known
        return np.array([known[w] for w in words], np.int64)

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language of every word of every text: highest sum of word scores less ``switch`` for each change.

        A text keeps its best single language if no stretch of words gains more than ``switch`` in another one, and no
        beginning and end gain more than that together. Then no path with changes is better: k stretches in other languages need
        at least k changes, or k - 1 if both the first and the last word are in one. Only the other texts need the dynamic program.
        """
        sizes = np.array([len(t) for t in texts])
        rows = self.rows([w for t in texts for w in t])
        score = self.table[rows].astype(np.float64)
        ends = np.cumsum(sizes)
        out: list[np.ndarray] = []
        full = np.flatnonzero(sizes)
        if not len(full):
            return [np.zeros(0, np.int64) for _ in texts]
        best = np.zeros(len(texts), np.int64)
        best[full] = np.argmax(np.add.reduceat(score, (ends - sizes)[full], axis=0), axis=1)
        text = np.repeat(np.arange(len(texts)), sizes)
        gain = np.cumsum(score - score[np.arange(len(score)), best[text]][:, None], axis=0)
        drop = np.concatenate([np.zeros((1, gain.shape[1])), gain[:-1]])
        step = np.abs(gain).max() * 2 + 1  # lifts each text below the one before, so that minima start anew
        low = np.minimum.accumulate(drop - text[:, None] * step, axis=0) + text[:, None] * step
        starts, worst = (ends - sizes)[full], np.zeros(len(texts))
        stretch = np.maximum.reduceat((gain - low).max(axis=1), starts)
        first = np.maximum.reduceat((gain - np.repeat(drop[starts], sizes[full], axis=0)).max(axis=1), starts)
        last = np.maximum.reduceat((np.repeat(gain[ends[full] - 1], sizes[full], axis=0) - drop).max(axis=1), starts)
        worst[full] = np.maximum(stretch, first + last)
        for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            out.append(np.full(b - a, best[k]) if worst[k] <= self.switch else viterbi(score[a:b], self.switch))
        return out


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    n, wide = score.shape
    value, came = score[0].copy(), np.zeros((n, wide), np.int64)
    own = np.arange(wide)
    for t in range(1, n):
        top = int(np.argmax(value))
        stay = value >= value[top] - switch
        came[t] = np.where(stay, own, top)
        value = np.where(stay, value, value[top] - switch) + score[t]
    path = np.zeros(n, np.int64)
    path[-1] = int(np.argmax(value))
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][path[t]]
    return path


def words_of(text: str | None) -> list[str]:
    """The runs of letters, lower-cased."""
    if not text:
        return []
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in ([word] if word.isalpha() else NUMBERS.split(word)) if part]


def fit(docs: DataFrame, label: str = "lang", text: str = "text", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """A model of the labelled rows of ``docs``; rows without a label or a text teach nothing.

    Of a language with more than ``docs_per_language`` rows about that many are read, chosen by a hash of the text: this
    bounds what the classifier is fitted on, not what it is applied to. At most ``MAX_LANGUAGES`` languages.
    """
    own = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    counts, letters = np.zeros((BUCKETS, max(1, len(languages)))), np.zeros((SCRIPTS, max(1, len(languages))))
    if not languages:
        return Model([], counts[:, :0], letters[:, :0])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    number = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, marks = np.zeros((len(languages), BUCKETS), np.int64), np.zeros((len(languages), SCRIPTS), np.int64)
        for b in batches:
            for lang, text_ in zip(b.column(0).to_pylist(), b.column(1)):
                if words := words_of(text_.as_py()):
                    bucket, _, script = word_grams(words)
                    grams[number[lang]] += np.bincount(bucket, minlength=BUCKETS)
                    marks[number[lang]] += np.bincount(script, minlength=SCRIPTS)
        both = np.concatenate([grams, marks], axis=1)
        lang, bucket = np.nonzero(both)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(both[lang, bucket])})

    sample = own.where(draw < share[F.col("lang")])
    for r in sample.mapInArrow(tidied(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < BUCKETS:
            counts[r["bucket"], r["lang"]] = r["n"]
        else:
            letters[r["bucket"] - BUCKETS, r["lang"]] = r["n"]
    return Model(languages, counts, letters)


def identify(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``spans`` (array of first word, end word, language).

    Words are runs of letters, lower-cased. Scripts leave candidates for each word, the trigram model scores them, and a
    Viterbi path with a penalty of ``switch`` for each change labels the words. ``lang_pred`` has most letters,
    ``score`` is its share of the letters. Without letters (or text, or a model of any language): ``und``, 0 and no spans. Columns with these
    names in the input are replaced. No shuffle; the model has a fixed number of buckets.
    """
    kept = docs.drop("lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out_type = T.StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("spans", SPANS)
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, switch)
        names = scorer.m.languages
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                texts = [words_of(t.as_py()) if names else [] for t in b.column(b.schema.get_field_index(text))]
                said, shares, spans = [], [], []
                for words, path in zip(texts, scorer.paths(texts) if names else [np.zeros(0, int)] * len(texts)):
                    if not words:
                        said.append(UNKNOWN), shares.append(0.0), spans.append([])
                        continue
                    size = np.fromiter(map(len, words), np.int64, len(words))
                    weight = np.bincount(path, size, len(names))
                    top = int(np.argmax(weight))
                    cut = np.flatnonzero(np.diff(path)) + 1
                    start, end = [0, *cut.tolist()], [*cut.tolist(), len(path)]
                    said.append(names[top]), shares.append(float(weight[top] / size.sum()))
                    spans.append([{"first": s, "end": e, "lang": names[path[s]]} for s, e in zip(start, end)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)],
                                                 names=[*b.schema.names, "lang_pred", "score", "spans"])

    return kept.mapInArrow(tidied(run), out_type)


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC-32 of its id as text; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
