"""SentencePiece encoding and decoding for merge-type vocabularies with a published model file; nothing is trained."""

from __future__ import annotations

import codecs
import heapq
import re
import string
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobcast.llm.common import tidied

SPACE = "▁"
#: A run of spaces with what follows it.
RUN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters of runs in each of the two generations that a worker remembers, and texts that a task holds at a time.
CACHED_CHARS = 6_000_000
SLICE = 256
#: Fixed values of the model file's format: types of pieces, and the type of merge vocabularies.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_MODEL = 2
#: Layout of an agenda entry: the piece (or another symbol's number), the place of its left symbol, the rank of its score.
BITS, MASK = 20, (1 << 20) - 1
PLACE = (1 << 31) - 1
RANK = 51
#: A letter that stands in no piece.
NONE = MASK
#: What the unknown piece decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Each byte that is no part of a character becomes a replacement character of its own.
codecs.register_error("jobcast-each", lambda e: ("�", e.start + 1))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, data[at: at + size]
        at += size


class Model:
    """What a model file says: pieces with scores and types, and how texts are normalized."""

    def __init__(self, content: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(content):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        kinds = [k for _, _, k in pieces]
        if trainer.get(3) != MERGE_MODEL or not trainer.get(35) or not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this operator reads merge-type models with byte fallback and without user-defined or unused pieces")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("this operator reads models that change nothing but spaces and put one in front")
        by_byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.bytes = [by_byte[b] for b in range(256)]
        own = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        # letters that stand in pieces but are none themselves get numbers behind the pieces
        letters = sorted(set().union(*own).difference(own))
        self.pieces_end = len(pieces)
        self.ids = own | {c: self.pieces_end + i for i, c in enumerate(letters)}
        rank = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == NORMAL}, reverse=True))}
        self.pairs = {self.ids[p[:k]] << BITS | self.ids[p[k:]]: rank[pieces[i][1]] << RANK | i
                      for p, i in own.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.neighbours = {p[k: k + 2] for p in own for k in range(len(p) - 1)}
        self.whole = any(pair[1] == SPACE != pair[0] for pair in self.neighbours)
        shown = {NORMAL: lambda p: p.replace(SPACE, " "), CONTROL: lambda p: "", UNKNOWN: lambda p: UNKNOWN_TEXT, BYTE: lambda p: ""}
        self.shown = [shown[k](p) for p, _, k in pieces]
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else s.encode() for (p, _, k), s in zip(pieces, self.shown)]
        self.is_byte, self.is_control = np.array(kinds) == BYTE, np.array(kinds) == CONTROL
        self.opens = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])

    def runs(self, text: str) -> list[str]:
        """Normalized parts of a text, cut before spaces: no merge crosses these unless some piece goes on after a space."""
        if not text:
            return []
        normal = SPACE + text.replace(" ", SPACE)
        return [normal] if self.whole else RUN.findall(normal)

    def parts(self, run: str) -> list[str]:
        """A run with other characters than letters, cut further between any two that stand side by side in no piece."""
        if run[1:].isalpha():
            return [run]
        cuts = [0, *[i for i, pair in enumerate(map(str.__add__, run, run[1:]), 1) if pair not in self.neighbours], len(run)]
        return [run[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, symbols: list[int]) -> list[int]:
        """The agenda holds the neighbouring pairs that make a piece; the pair of highest score, the leftmost of equal ones,
        becomes one symbol and makes pairs with its new neighbours, until no pair is left. What has merged into another is -1.

        An entry is one number: the score's rank, the place of the left symbol, the piece.
        """
        get, n = self.pairs.get, len(symbols)
        agenda = [e + (i << BITS) for i, p in enumerate(zip(symbols, symbols[1:])) if (e := get(p[0] << BITS | p[1])) is not None]
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols.append(NONE)  # makes no pair
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry >> BITS & PLACE
            j = after[i]
            if symbols[i] < 0 or get(symbols[i] << BITS | symbols[j]) != entry - (i << BITS):
                continue  # one side has merged with something else since
            symbols[i] = piece = entry & MASK
            symbols[j] = -1
            after[i] = j = after[j]
            if (e := get(piece << BITS | symbols[j])) is not None:
                heapq.heappush(agenda, e + (i << BITS))
            if j < n:
                before[j] = i
            if (j := before[i]) >= 0 and (e := get(symbols[j] << BITS | piece)) is not None:
                heapq.heappush(agenda, e + (j << BITS))
        symbols.pop()
        return symbols

    def pieces(self, run: str) -> list[int]:
        """Ids of a run; a symbol that is no piece gives the pieces of its bytes."""
        merged = self.merge([self.ids.get(c, NONE) for c in run])
        if max(merged) < self.pieces_end:
            return [s for s in merged if s >= 0]
        out = []
        for c, s in zip(run, merged):
            if s >= self.pieces_end:
                out += [self.bytes[b] for b in c.encode()]
            elif s >= 0:
                out.append(s)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces with spaces for their marks but the first, bytes as UTF-8, control pieces nothing."""
        if not self.is_control[ids].any():
            return self.shown_as(ids, True)
        out: list[str] = []  # bytes on both sides of a control piece make no character
        for part in np.split(ids, np.flatnonzero(self.is_control[ids])):
            if len(part := part[~self.is_control[part]]):
                out.append(self.shown_as(part, not out))
        return "".join(out)

    def shown_as(self, ids: np.ndarray, first: bool) -> str:
        cut = 1 if first and len(ids) and self.opens[ids[0]] else 0
        if self.is_byte[ids].any():
            return b"".join([self.raw[i] for i in ids.tolist()])[cut:].decode(errors="jobcast-each")
        return "".join([self.shown[i] for i in ids.tolist()])[cut:]


class Runs(dict):
    """Ids of the runs met last, as bytes; a run that is missing is encoded when it is asked for, and listed as new.

    Two generations: what is asked for again moves from the older to this one, which becomes the older when it is full.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.older, self.chars, self.new = model, {}, 0, []

    def __missing__(self, run: str) -> bytes:
        if (ids := self.older.get(run)) is None:
            parts = self.model.parts(run)
            ids = b"".join([self[p] for p in parts]) if len(parts) > 1 else array("i", self.model.pieces(run)).tobytes()
            self.new.append(run)
        self[run] = ids
        self.chars += len(run)
        return ids

    def turn(self) -> None:
        if self.chars > CACHED_CHARS:
            self.older, self.chars = dict(self), 0
            self.clear()


class Coder:
    """Encodes and decodes texts; compares each run that is new to it with the library's ids if asked to.

    A worker keeps the runs it remembers from task to task.
    """

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = Model(content)
        self.library = SentencePieceProcessor(model_proto=content)
        self.known = Runs(self.model)

    def encode(self, texts: list[str | None], check: bool) -> list[np.ndarray]:
        self.known.turn()
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, self.model.runs(t or ""))), np.int32) for t in texts]
        new, self.known.new = self.known.new, []
        if check:  # the library puts a space in front by itself
            own = [r for r in new if r[0] == SPACE and len(r) > 1]
            for run, ids in zip(own, self.library.encode([r[1:].replace(SPACE, " ") for r in own], num_threads=1)):
                if array("i", ids).tobytes() != self.known[run]:
                    raise ValueError(f"not the library's ids: {run[:100]!r}")
        return out


@lru_cache(maxsize=2)
def coder(content: bytes) -> Coder:
    return Coder(content)


def encode_decode(docs: DataFrame, path: str, text: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the ids turned back into text) of each whole text.

    Same ids as the sentencepiece library gives without begin and end ids, and what its decode makes of them. Merges
    never cross the start of a run of spaces (checked when the model is read; other models merge whole texts), so a
    task encodes each different run once and, with ``check``, compares it with the library's ids, one call for each
    batch of texts; a difference is an error. A missing or empty text has no ids and an empty decoded text. Columns
    named ``ids`` or ``decoded`` in the input are replaced; all others stay, and repeated rows stay rows of their own.
    One pass without a shuffle; a task holds ``SLICE`` texts at a time.
    """
    with open(path, "rb") as file:
        content = file.read()
    Model(content)  # an unsuitable file fails here, not in tasks
    kept = docs.drop("ids", "decoded")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    out_type = T.StructType(list(kept.schema.fields)).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = c.encode(batch.column(batch.schema.get_field_index(text)).to_pylist(), check)
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([c.model.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, decoded], names=[*batch.schema.names, "ids", "decoded"])

    return kept.mapInArrow(tidied(run), out_type)


def mismatches(coded: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Rows of ``encode_decode`` whose ids or decoded text differ from the library's for the whole text, in Arrow batches."""
    with open(path, "rb") as file:
        shared = coded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(shared.value).library
        for batch in batches:
            of = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in (text, "ids", "decoded")}
            ids = library.encode([t or "" for t in of[text]], num_threads=1)
            same = [a == b and library.decode(a) == d for a, b, d in zip(ids, of["ids"], of["decoded"])]
            yield batch.filter(pa.array([not s for s in same], pa.bool_()))

    return coded.mapInArrow(tidied(run), coded.schema)


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``'s rows."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
