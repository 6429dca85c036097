"""Spelling variants: all words walk through a trie of all words, kept as tables, with at most one edit."""

from __future__ import annotations

import os.path
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.llm.common import Batches, tidied
from jobcast.llm.components import followed
from jobcast.session import store

WORD = re.compile("[a-zÀ-ÿ]+")
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: One word in so many of a document is misspelt on purpose.
MISSPELT = 199
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Edges of one level that are broadcast at most, and the bytes of their ends.
BROADCAST_EDGES, BROADCAST_BYTES = 50_000, 8 << 20


def words_of(doc_id: int | None, text: str | None, misspelt: int = MISSPELT) -> Iterator[tuple[str, int]]:
    """The words of one document, each with its number; a word's hash with the document's id may take one letter away."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(WORD.findall((text or "").encode().translate(LOWER).decode())).items():
        h = zlib.crc32(word.encode(), start)
        if h % misspelt == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1:]
        yield word, n


def word_counts(docs: DataFrame, letters: int = 6, least: int = 5) -> DataFrame:
    """(word, n): words of at least ``letters`` code points that occur at least ``least`` times in all documents together."""

    def run(batches: Batches) -> Batches:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, n in words_of(doc_id, text.as_py()):
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return own.mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letters_at(word: Column, place: Column, n: Column | int) -> Column:
    """``n`` code points behind the first ``place``."""
    return F.substring(word, place + 1, F.lit(n) if isinstance(n, int) else n)


def edges_of(walkers: DataFrame) -> DataFrame:
    """(node, c, child, n, ends, shortest, longest): the edges below the nodes on which ``walkers`` (word, node) stand.

    A node is the string that leads to it. An edge goes to the longest string that all words behind its first letter ``c``
    begin with, so chains without branches are one edge, and one word alone is one edge to its end. ``n`` words go
    that way, ``ends`` tells if the child is a word itself; ``shortest`` and ``longest`` are the words' lengths.
    """
    size = F.length("word")
    groups = walkers.where(size > F.length("node")).groupBy("node", letters_at(F.col("word"), F.length("node"), 1).alias("c")).agg(
        F.min("word").alias("low"), F.max("word").alias("high"), F.count("*").alias("n"), F.min(size).alias("shortest"), F.max(size).alias("longest"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            low, high = b.column(2).to_pylist(), b.column(3).to_pylist()
            child = [os.path.commonprefix(both) for both in zip(low, high)]  # what the first and the last of sorted words share, all share
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(child, pa.string()), b.column(4), pa.array([x == y for x, y in zip(low, child)], pa.bool_()), b.column(5), b.column(6)],
                names=["node", "c", "child", "n", "ends", "shortest", "longest"])

    return groups.mapInArrow(run, "node string, c string, child string, n long, ends boolean, shortest int, longest int")


def small(edges: DataFrame) -> DataFrame:
    """The edges as a broadcast side if their number and bytes have been found small, else as they are: then Spark shuffles both sides."""
    size = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("child") + F.octet_length("node")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(edges) if size["n"] <= BROADCAST_EDGES and size["bytes"] <= BROADCAST_BYTES else edges


def edited(walkers: DataFrame, edges: DataFrame, at_root: bool) -> DataFrame:
    """(word, place, goal, ...edge): words without an edit lose a letter, or get a greater one in place of one.

    Each pair of near words is found once, from the longer of the two or from the one with the smaller letter.
    ``place`` counts the letters of the word that are used up at the child, ``goal`` is the length of the word it is to
    become. Edges with a greater first letter take it in place of the word's. On the word's own edge any letter can change,
    or be lost behind the first one; the loss of the first letter of all is an edit at the root.
    """
    word, at, n = F.col("word"), F.length("node"), F.length("child") - F.length("node")
    label, left = letters_at(F.col("child"), at, n), F.length("word") - at

    def state(used: Column, goal: Column) -> Column:
        return F.struct((at + used).cast("int").alias("place"), goal.cast("int").alias("goal"))

    tails = letters_at(word, at + 1, n - 1) == letters_at(F.col("child"), at + 1, n - 1)
    greater = walkers.join(edges, "node").where((F.col("c") > letters_at(word, at, 1)) & (left >= n) & tails).select(
        "word", state(n, F.length("word")).alias("way"), *EDGE)
    same, longer = letters_at(word, at, n), letters_at(word, at, n + 1)
    ways = F.array(
        F.when((left >= n) & (label > same) & (F.levenshtein(same, label, 1) == 1), state(n, F.length("word"))),
        F.when((left > n) & (F.levenshtein(longer, label, 1) == 1), state(n + 1, F.length("word") - 1)))
    # an own edge with one word leads to the word itself only
    own = walkers.withColumn("c", letters_at(word, at, 1)).join(edges.where("n > 1"), ["node", "c"]).select(
        "word", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("way"), *EDGE)
    found = greater.unionByName(own)
    if at_root:
        second = walkers.withColumn("c", letters_at(word, F.lit(1), 1)).where(F.col("c") != letters_at(word, F.lit(0), 1)).join(edges, ["node", "c"])
        found = found.unionByName(second.where(letters_at(word, F.lit(1), n) == label).select("word", state(n + 1, F.length("word") - 1).alias("way"), *EDGE))
    return found.select("word", "way.place", "way.goal", *EDGE)


EDGE = ("child", "n", "ends", "shortest", "longest", "nexts")


def followers(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, place, goal, ...edge): words with an edit go on where the edge has the word's next letters."""
    word, n = F.col("word"), F.length("child") - F.length("node")
    met = states.withColumn("c", letters_at(word, F.col("place"), 1)).join(edges, ["node", "c"])
    same = letters_at(word, F.col("place"), n) == letters_at(F.col("child"), F.length("node"), n)
    return met.where(same).select("word", (F.col("place") + n).cast("int").alias("place"), "goal", *EDGE)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): each word of ``words`` (word) with every other one that differs by one letter put in, taken out or replaced.

    The trie's edges are a table, made and walked level by level. States (word, place, node, edits) are joined with the
    edges below their nodes; words without an edit are at the nodes on their own path. A state that has used up its word
    at the end of another is a result, in both directions. One that has letters left goes on if words of the wanted length are below and
    the next letter leads there. Each level is a written table; levels follow the longest chain of branches, not the
    longest word.
    """
    walkers = store(words.select("word", F.lit("").alias("node")), "trie-words")
    edges = store(edges_of(walkers), "trie-edges")
    states, found = None, [store(words.select("word", F.col("word").alias("near")).limit(0), "near")]
    while edges.limit(1).count():
        way = small(edges.where("n > 1").select("node", "c", "child"))
        below = store(walkers.withColumn("c", letters_at(F.col("word"), F.length("node"), 1)).join(way, ["node", "c"]).select(
            "word", F.col("child").alias("node")), "trie-words")
        deeper = store(edges_of(below), "trie-edges")
        nexts = deeper.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set("c"), "").alias("nexts"))
        level = small(store(edges.join(nexts, "child", "left"), "trie-level"))
        steps = edited(walkers, level, states is None)
        if states is not None:
            steps = steps.unionByName(followers(states, level))
        left = F.col("place") < F.length("word")
        goes_on = left & F.col("goal").between(F.col("shortest"), F.col("longest")) & F.contains("nexts", letters_at(F.col("word"), F.col("place"), 1))
        steps = store(steps.where((~left & F.col("ends")) | goes_on).select("word", "place", "goal", F.col("child").alias("node")), "trie-steps")
        found.append(steps.where(~left).select("word", F.col("node").alias("near")))
        walkers, edges, states = below, deeper, steps.where(left)
    once = reduce(DataFrame.unionByName, found).distinct()
    return once.unionByName(once.select(F.col("near").alias("word"), F.col("word").alias("near")))


def group_variants(docs: DataFrame, letters: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs`` (doc_id, text): see ``word_counts`` and ``near_words``.

    A word's ``form`` is its near word of largest n, the first in code-point order of equal ones, if that is at least
    ``times`` the word's own n; ``root`` is the last of its forms' forms, the word itself if it has none. Counts are over
    all documents; a missing text has no words, a missing doc_id counts as an empty one in the hash, repeated rows count
    each time, other columns are not looked at, and an empty table gives an empty result. Words may be of any length.
    """
    words = store(word_counts(docs, letters, least), "words")
    pairs = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    large = -F.col("best.m") >= times * F.col("n")
    formed = store(words.join(best, "word", "left").select(
        "word", F.when(large, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, -F.col("best.m")).alias("form_n")), "forms")
    roots = followed(formed.select(F.col("word").alias("node"), F.coalesce("form", "word").alias("component")))
    return formed.join(roots.select(F.col("node").alias("word"), F.col("component").alias("root")), "word").select(
        "word", "form", "root", "n", "n_near", "form_n")
