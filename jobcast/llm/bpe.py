"""Byte-pair encoding and decoding with a published vocabulary file; nothing is trained."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.llm.common import tidied

BITS = 24
MASK = (1 << BITS) - 1
NONE = 1 << 62
CACHED_WORDS = 200_000
SLICE = 256
#: From here on Unicode versions classify code points differently.
LATER = re.compile("[\u0558-\U0010ffff]")
#: Besides those: separators that are white space to some and not to others, and the sigma with two lower cases.
OTHER = re.compile("[\x1c-\x1f\u03a3\u0558-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in kept}
    for b in range(256):
        stand_in.setdefault(b, chr(256 + len(stand_in) - len(kept)))
    return [stand_in[b] for b in range(256)]


class Vocabulary:
    """What a tokenizer file of this family says: split pattern, merges, word ends, special tokens, normalizer."""

    def __init__(self, content: str) -> None:
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.loads(content)
        model = spec["model"]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("this operator reads byte-level BPE files with a split pattern and no decoder")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.splitter = Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        self.plain = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.normalizer = Tokenizer.from_str(content).normalizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        end, vocab = model["end_of_word_suffix"] or "", model["vocab"]
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {vocab[a] << BITS | vocab[b]: r << BITS | vocab[a + b] for r, (a, b) in enumerate(pairs)}
        marks = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def split(self, normal: str) -> list[str]:
        """Words of a normalized text. Beyond the scripts on which all Unicode versions agree, the library's own splitter."""
        if LATER.search(normal):
            return [w for w, _ in self.splitter.pre_tokenize_str(normal)]
        return self.pattern.findall(normal)

    def symbols(self, word: str) -> list[int]:
        data = word.encode()
        return [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]

    def pieces(self, word: str) -> list[int]:
        ids = self.symbols(word)
        return merge_short(ids, self.merges) if len(ids) <= 128 else merge_long(ids, self.merges)


def merge_short(parts: list[int], merges: dict[int, int]) -> list[int]:
    """Contiguous arrays of parts and of the ranks between neighbours: find the least rank, delete its boundary,
    refresh the ranks on both sides, until no neighbours merge. A rank carries the merged part in its low bits."""
    get = merges.get
    ranks = [get(a << BITS | b, NONE) for a, b in zip(parts, parts[1:])]
    while ranks and (least := min(ranks)) != NONE:
        i = ranks.index(least)
        parts[i] = part = least & MASK
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << BITS | part, NONE)
        if i < len(ranks):
            ranks[i] = get(part << BITS | parts[i + 1], NONE)
    return parts


def merge_long(parts: list[int], merges: dict[int, int]) -> list[int]:
    """The same merges for a word without a bound on its length: a heap of ranks instead of repeated scans."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(merges[p], i, p) for i, p in enumerate(a << BITS | b for a, b in zip(parts, parts[1:])) if p in merges]
    heapq.heapify(heap)
    while heap:
        rank, i, pair = heapq.heappop(heap)
        j = after[i] if parts[i] >= 0 else n
        if j >= n or parts[i] << BITS | parts[j] != pair:
            continue
        parts[i], parts[j] = rank & MASK, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (new := parts[left] << BITS | parts[right]) in merges:
                heapq.heappush(heap, (merges[new], left, new))
    return [p for p in parts if p >= 0]


class Coder:
    """Encodes and decodes texts; remembers up to ``CACHED_WORDS`` words and as many pieces between white space."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def forget(self) -> None:
        """A worker outlives its task: what the task remembered must not stay beside the next stage's rows."""
        self.words.clear()
        self.runs.clear()

    def _words(self, words: list[str]) -> bytes:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = array("i", self.v.pieces(w)).tobytes()
        return b"".join([known[w] for w in words])

    def _plain(self, text: str) -> bytes:
        """Text without special strings."""
        v = self.v
        if not v.plain or OTHER.search(text):
            return self._words(v.split(v.normalizer.normalize_str(text) if v.normalizer else text))
        runs, known = unicodedata.normalize("NFC", text).split(), self.runs
        if len(known) > CACHED_WORDS:
            known.clear()
        for r in set(runs).difference(known):
            known[r] = self._words(v.split(r.lower()))
        return b"".join([known[r] for r in runs])

    def encode(self, text: str) -> np.ndarray:
        v, out = self.v, []
        for k, part in enumerate(v.marks.split(text) if v.marks and v.marks.search(text) else [text]):
            if k % 2:
                out.append(array("i", [v.special[part]]).tobytes())
            elif part:
                out.append(self._plain(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Names of the ids, special ones included, joined by spaces: what a file without a decoder asks for."""
        names = self.v.names
        return " ".join([names[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def coder(content: str) -> Coder:
    return Coder(Vocabulary(content))


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the ids turned back into text) of each whole text.

    Same ids as the tokenizers library gives without added special tokens; special strings inside a text are special
    tokens, as there. A missing or empty text has no ids and an empty decoded text. Columns named ``ids`` or ``decoded``
    in the input are replaced; all others stay. One pass without a shuffle; a task holds a few hundred texts at a time.
    """
    with open(path, encoding="utf-8") as file:
        content = file.read()
    kept = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    out_type = T.StructType(list(kept.schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                ids = [c.encode(t) if t else np.zeros(0, np.int32) for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else []).cast(pa.int32()))
                decoded = pa.array([c.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*batch.schema.names, "ids", "decoded"])
        c.forget()

    return kept.mapInArrow(tidied(run), out_type)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``'s rows."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

