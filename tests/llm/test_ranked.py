"""Ranked search, spelling variants and SentencePiece against plain versions of themselves and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from jobcast.llm import lexical, pieces, queries, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, top):
    """Every document scored for every item; (item row, rank, doc_id, score)."""
    terms = [(i, TERM.findall((t or "").translate(ASCII_LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    counts = [(i, len(t), Counter(t)) for i, t in terms]
    out = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(ASCII_LOWER)))
        found = []
        for i, n, tf in counts:
            if n:
                m = 100 - 75 + (75 * n * n_docs) // n_terms
                score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 8 * m))
                            for w, k in wanted.items() if w in tf)
                if score > 0:
                    found.append((-score, i is None, i))
        found.sort()
        out += [(item_id, rank + 1, i, -s) for rank, (s, _, i) in enumerate(found[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("item_bytes", "cells"), [(4 << 20, 2_000_000), (60, 50)])
def test_search_equals_plain_scores(spark, docs_of, odd_rows, item_bytes, cells, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(40)] + ["Ünï", "ünï", "x-y", "a_b", "¹"]
    rows = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randrange(30))), "en") for i in range(150)]
    docs = odd_rows + rows + rows[:5] + [(900 + i, rows[7][1], "en") for i in range(30)] + [(None, rows[7][1], "en")] * 2
    items = [(i, " ".join(rng.choices(vocabulary, k=8))) for i in range(12)] + [
        (50, rows[7][1]), (51, None), (52, ""), (53, "unknown words"), (54, "the river, the HILLS"), (None, rows[9][1]), (50, rows[7][1]), (50, "t1 t1 t2")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("doc_id", F.lit("clash"))
    got = lexical.search(docs_of(docs).withColumn("n", F.lit("clash")).repartition(5), table, 10, item_bytes).collect()
    assert sorted(map(tuple, got), key=str) == plain_search([d[:2] for d in docs], items, 10)
    assert lexical.search(docs_of(docs).limit(0), table).count() == 0 and lexical.search(docs_of(docs), table.limit(0)).count() == 0


def test_heaps_keep_the_smallest_of_equal_documents():
    rng = np.random.default_rng(1)
    scores, docs = rng.integers(0, 4, (500, 7)), rng.permutation(500)
    heaps = lexical.Heaps(7, 5)
    for at in range(0, 500, 33):
        heaps.update(scores[at: at + 33], docs[at: at + 33])
    for i, heap in enumerate(heaps.heaps):
        assert sorted(heap, reverse=True) == sorted(((int(s), -int(d)) for s, d in zip(scores[:, i], docs) if s), reverse=True)[:5]


def plain_near(words):
    kept, letters, out = set(words), sorted(set("".join(words))), set()
    for w in kept:
        for i in range(len(w) + 1):
            made = {w[:i] + c + w[i:] for c in letters} | {w[:i] + c + w[i + 1:] for c in letters if i < len(w)} | {w[:i] + w[i + 1:]}
            out |= {(w, v) for v in made & kept if v != w and abs(len(v) - len(w)) <= 1}
    return out


@pytest.mark.parametrize("limit", [0, 50_000])
def test_trie_finds_all_near_words(spark, limit, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_EDGES", limit)
    rng = random.Random(limit)
    words = {"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(150)} | {"".join(rng.choices("abcdefghij", k=rng.randrange(3, 6))) for _ in range(150)}
    words |= {"a" * 3000, "a" * 3001, "a" * 2999 + "b", "b" + "a" * 3000, "abc" * 700, "abc" * 350 + "bc" + "abc" * 349, "abc" * 700 + "d"}
    got = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_near(words)


def plain_variants(docs, letters=6, least=5, times=5):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    near = {w: [] for w in words}
    for w, v in plain_near(words):
        near[w].append(v)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def test_variants_equal_brute_force(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rng = random.Random(4)
    base = ["separate", "necessary", "Überraschung", "receive", "ÀÉÎÕÜ×÷ÿ", "maintenance", "short"]
    rows = []
    for i in range(60):
        words = [w for w in base for _ in range(8)]
        for w in base:
            for _ in range(2 if i % 4 == 0 else 0):
                k = rng.randrange(len(w))
                words.append(rng.choice([w[:k] + w[k + 1:], w[:k] + "e" + w[k:], w[:k] + "ß" + w[k + 1:], w[1:], w + "s"]))
        rng.shuffle(words)
        rows.append((i, ", ".join(words) + " 日本 x1y", "en"))
    rows += odd_rows + rows[:3] + [(None, "separate separat " * 30, "en"), (70, "abcdefgh" * 2000 + " " + "abcdefgh" * 1999 + "abcdefg", "en")] * 5
    docs = docs_of(rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.group_variants(docs).collect())
    want = plain_variants([r[:2] for r in rows])
    assert got == want and any(f for _, f, *_ in want)
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_pieces_equal_library(spark, docs_of, odd_rows):
    rng = random.Random(3)
    alphabet = ["a", "b", " ", "  ", "the", "▁", "\n", "\t", "é", "日", "🙂", "\0", "　", "in", "g", "<s>", "<0x41>", "A", "1", "́", "�", " ", ",", "."]
    extra = ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)] + ["ab" * 20_000, " " * 3000, "a" * 5000 + " x"]
    rows = odd_rows + [(100 + i, t, "en") for i, t in enumerate(extra)]
    library = SentencePieceProcessor(model_file=queries.PIECES)
    coded = pieces.encode_decode(docs_of(rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)), queries.PIECES)
    got = coded.collect()
    assert len(got) == len(rows) and coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    for r in got:
        ids = library.encode(r.text or "")
        assert r.ids == ids and r.decoded == library.decode(ids)
    assert pieces.mismatches(coded, queries.PIECES).count() == 0
    wrong = coded.withColumn("decoded", F.when(F.col("doc_id") == 100, F.lit("!")).otherwise(F.col("decoded")))
    assert [r.doc_id for r in pieces.mismatches(wrong, queries.PIECES).collect()] == [100]
    assert pieces.digests(pieces.encode_decode(docs_of(rows).limit(0), queries.PIECES)).count() == 0


def test_any_ids_decode_as_in_library():
    coder = pieces.coder(open(queries.PIECES, "rb").read())
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(262), rng.randrange(32000), 3 + 0xE2, 3 + 0x96, 3 + 0x81, 259, 28705, 0, 1]) for _ in range(rng.randrange(9))]
        assert coder.model.decode(np.array(ids, np.int32)) == coder.library.decode(ids), ids


def test_memory_of_runs_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_CHARS", 200)
    coder = pieces.Coder(open(queries.PIECES, "rb").read())
    for k in range(50):
        texts = [f"word{k} and word{j}, again" for j in range(10)]
        assert [i.tolist() for i in coder.encode(texts, True)] == coder.library.encode(texts)
        assert len(coder.known) + len(coder.known.older) < 200


def test_pieces_query(spark, sf_dir):
    library = SentencePieceProcessor(model_file=queries.PIECES)
    got = {r.doc_id: r for r in queries.QUERIES["op13_sentencepiece"](spark, sf_dir).collect()}
    for r in spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_variants_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in queries.QUERIES["op12_spelling_trie"](spark, sf_dir).collect())
    assert got == plain_variants(docs) and len(got) > 100
