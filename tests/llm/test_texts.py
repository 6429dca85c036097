"""Encoding, fingerprints, passages, tiles, languages, toxicity and quality against plain versions of themselves."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobcast.llm import bpe, components, kneser_ney, language, simhash, suffixes, tiling, toxicity
from jobcast.llm.queries import TOKENIZER


def test_bpe_equals_library(spark, docs_of, odd_rows):
    extra = ["a<|endoftext|>b", "ΣΑΣ don't", "x" * 500, "é\u0301 \x1c\u200b", "日本語 12 ³"]
    rows = odd_rows + [(100 + i, t, "en") for i, t in enumerate(extra)]
    library = Tokenizer.from_file(TOKENIZER)
    library.no_truncation(), library.no_padding()
    got = bpe.encode_decode(docs_of(rows).withColumn("ids", F.lit("clash")), TOKENIZER).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.digests(bpe.encode_decode(docs_of(rows).limit(0), TOKENIZER)).count() == 0


def test_long_words_merge_alike():
    merges = bpe.coder(open(TOKENIZER, encoding="utf-8").read()).v.merges
    random.seed(2)
    for n in (1, 2, 50, 400):
        parts = [random.choice([64, 65, 66, 72, 83]) for _ in range(n)]
        assert bpe.merge_short(list(parts), merges) == bpe.merge_long(list(parts), merges)


def plain_fingerprint(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs_of, odd_rows):
    got = simhash.fingerprints(docs_of(odd_rows)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fp[0] % (1 << 64))
    for i, t, _ in odd_rows:
        assert plain_fingerprint(t) in by[i]
    assert len(got) == len(odd_rows)


def plain_components(prints):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    least = {}
    for f, i in prints.items():
        least[root(f)] = min(least.get(root(f), i), i)
    return {f: least[root(f)] for f in prints}


@pytest.mark.parametrize("hot", [3, 1000])
def test_links_and_components(spark, hot):
    """Clusters of fingerprints a few bits apart, with crowded keys and without."""
    random.seed(5)
    prints = {}
    for c in range(4):
        centre = random.getrandbits(64)
        for _ in range(60):
            f = centre
            for b in random.sample(range(64), random.choice([0, 1, 1, 2, 3])):
                f ^= 1 << b
            prints.setdefault(f, len(prints))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for f, i in prints.items()]
    classes = spark.createDataFrame(rows, "id long, rep long").withColumn("fp", F.array("id"))
    links = simhash.links_of(classes.select("id", "fp"), 1, 2, 32, 2, hot)
    label = {r.node % (1 << 64): r.component % (1 << 64) for r in components.components(links).collect()}
    least = {}
    for f, i in prints.items():
        least[label.get(f, f)] = min(least.get(label.get(f, f), i), i)
    assert {f: least[label.get(f, f)] for f in prints} == plain_components(prints)


def test_components_of_chains(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_near_duplicates_of_odd_rows(docs_of, odd_rows):
    got = simhash.near_duplicates(docs_of(odd_rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[3] == by[4] == by[7] == 3
    assert simhash.near_duplicates(docs_of(odd_rows).limit(0)).count() == 0


def test_near_duplicates_with_long_fingerprints(docs_of):
    random.seed(9)
    base = [f"word{random.randrange(5000)}" for _ in range(400)]
    near = list(base)
    for p in (40, 200, 333):
        near[p] = "changed"
    rows = [(1, " ".join(base), "en"), (2, " ".join(near), "en"), (3, " ".join(reversed(base)), "en")]
    got = simhash.near_duplicates(docs_of(rows), width=5, words=6, segments=16, bits=24, radius=64).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def plain_repeats(rows, length=50):
    seen, out = {}, {}
    for i, text in sorted((i if i is not None else math.inf, t) for i, t in rows):
        data = (text or "").encode()
        gone, new = [False] * len(data), set()
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if seen.get(w, i) < i:
                gone[p:p + length] = [True] * length
            new.add(w)
        for w in new:
            seen.setdefault(w, i)
        out.setdefault(i, []).append(bytes(b for b, g in zip(data, gone) if not g))
    return out


def test_near_duplicate_stage_equals_brute_force(spark, docs_of):
    """One row of each component of fingerprints: smallest id, rows without an id last, of repeated rows one."""
    rng = random.Random(5)
    rows, n = [], 0
    for words, changes in [(49, 1)] * 20 + [(400, 1)] * 20 + [(900, 2)] * 20:
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
        other = list(base)
        for c in range(changes):
            other[5 + c * (words - 10) // changes + rng.randrange(5)] = f"new{n}x{c}"
        rows += [(n, " ".join(base), "en"), (n + 1, " ".join(other), "en")]
        n += 2
    base = [f"c{i}" for i in range(600)]
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(600), i % 3):
            copy[at] = f"copy{i}"
        rows.append((n + i, " ".join(copy), "en"))
    rows += [(n + 80, "", "en"), (n + 81, None, "en"), (n + 82, "too short", "en"), (n + 83, "Too  short", "en")]
    rows += [(None, rows[0][1], "en"), (None, "only without an id", "en"), (None, "only without an id", "en"), rows[4], rows[4]]
    prints = defaultdict(lambda: math.inf)
    for i, t, _ in rows:
        f = plain_fingerprint(t)
        prints[f] = min(prints[f], math.inf if i is None else i)
    least = plain_components(dict(prints))
    want = Counter({i for i in least.values() if i < math.inf}) + Counter({None: 1})
    kept = corpus_pipeline.near_duplicates(spark, docs_of(rows), "").collect()
    assert Counter(r.doc_id for r in kept) == want and len(want) < 130
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows)).where("doc_id is not null").collect()}
    assert got == {i: least[plain_fingerprint(t)] for i, t, _ in rows if i is not None}


@pytest.mark.parametrize("size", [400, 800, 1600])
def test_links_of_a_group_grow_with_it(spark, docs_of, size, monkeypatch):
    """Of a group of near copies beyond the hot limit, what the joins make grows with the group, not with its square."""
    made = []
    keep = simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, name: made.append((name, out := keep(df, name))) or out)
    rng = random.Random(size)
    base = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:]), "en") for i in range(size) for k in [rng.randrange(300)]]
    simhash.near_duplicates(docs_of(rows), hot=16).count()
    assert all(df.count() <= 100 * size for name, df in made if name not in ("looked", "members", "spokes", "placed"))


def dealt_anew(df):
    """The same rows, in another order and in other partitions at each reading."""
    import os

    import pyarrow as pa

    def run(batches):
        rows = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else schema.empty_table()
        order = np.random.default_rng(int.from_bytes(os.urandom(8))).permutation(rows.num_rows)
        yield from rows.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=7)

    schema = df.limit(0).toArrow().schema
    return df.repartition(3).mapInArrow(run, df.schema)


def test_readings_in_another_order(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 3000)
    random.seed(6)
    lines = [" ".join(random.choice("abcdefghij") * random.randrange(1, 6) for _ in range(12)) for _ in range(30)]
    rows = odd_rows[:5] + odd_rows[8:] + [(20 + k, random.choice(["", "x", "é"]) + " ".join(random.choices(lines, k=6)), "en") for k in range(60)]
    want = plain_repeats([r[:2] for r in rows])
    for r in suffixes.repeated_spans(dealt_anew(docs_of(rows))).collect():
        assert bytes(r.kept) in want[r.doc_id if r.doc_id is not None else math.inf]
    trusted = spark.createDataFrame([(i,) for i in range(20, 60)], "doc_id long")
    plain, anew = [{(r.doc_id, r.text_hash): r.perplexity for r in kneser_ney.perplexities(d, trusted).collect()}
                   for d in (docs_of(rows), dealt_anew(docs_of(rows)))]
    assert plain.keys() == anew.keys() and all(x is y or math.isclose(x, y, rel_tol=1e-6) for x, y in ((plain[k], anew[k]) for k in plain))


def test_missing_grams_are_an_error():
    import pyarrow as pa

    asked = pa.table({"block": [1], "shard": pa.array([0], pa.int32()), "asked": [kneser_ney.squeezed(np.array([3, 9], np.int64))]})
    for have in ([3], [3, 12], []):
        model = pa.table({"g": pa.array(have, pa.int64()), "logp": pa.array([-1.0] * len(have))})
        with pytest.raises(ValueError, match="grams"):
            kneser_ney.answered(asked, model)


@pytest.mark.parametrize("block", [4096, 4 << 20])
def test_repeated_spans(docs_of, odd_rows, block, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    random.seed(4)
    lines = [" ".join(random.choice("abcdefghij") * random.randrange(1, 6) for _ in range(12)) for _ in range(30)]
    rows = odd_rows + [(20 + k, random.choice(["", "x", "é"]) + " ".join(random.choices(lines, k=6)) + "a" * random.randrange(120), "en") for k in range(60)]
    got = suffixes.repeated_spans(docs_of(rows).withColumn("kept", F.lit("clash"))).collect()
    want = plain_repeats([r[:2] for r in rows])
    assert len(got) == len(rows)
    for r in got:
        data = (r.text or "").encode()
        assert bytes(r.kept) in want[r.doc_id if r.doc_id is not None else math.inf]
        assert len(data) - len(r.kept) == sum(s.end - s.start for s in r.spans)
    assert suffixes.digests(suffixes.repeated_spans(docs_of(rows).limit(0))).count() == 0


def test_suffix_digests(docs_of):
    text = "b" * 60
    got = {r.doc_id: r for r in suffixes.digests(suffixes.repeated_spans(docs_of([(1, text, "en"), (2, text + "é", "en"), (3, None, None)]))).collect()}
    assert (got[2].n_bytes, got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (62, 60, 1, hashlib.sha256("é".encode()).hexdigest())
    assert (got[3].n_bytes, got[3].n_spans, got[3].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())


def plain_tiles(item, doc, least):
    """Greedy string tiling by comparing all places."""
    fi, fd, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and fi[p + n] and fd[q + n] and item[p + n] == doc[q + n]:
                    n += 1
                best = max(best, (n, -p, -q))
        n, p, q = best[0], -best[1], -best[2]
        if n < least:
            return total
        fi[p:p + n], fd[q:q + n] = [False] * n, [False] * n
        total += n


def test_tiles_equal_plain_tiling():
    random.seed(8)
    for _ in range(40):
        doc = [random.randrange(1, 9) for _ in range(60)]
        item = [random.randrange(1, 9) for _ in range(6)] + doc[30:42] + doc[5:13]
        a, b = np.array(item, np.uint64), np.array(doc, np.uint64)
        assert sum(t[2] for t in tiling.tiles(a, b, 5)) == plain_tiles(item, doc, 5)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_contaminated(spark, docs_of, odd_rows, limit):
    passage = "one two three four five six seven eight nine ten eleven twelve".split()
    swapped = passage[6:] + ["and", "then"] + passage[:6]
    rows = odd_rows + [(50, "Intro. " + " ".join(passage).upper() + "!", "en"), (51, " ".join(swapped), "en"),
                           (52, " ".join(passage[:8]), "en"), (53, " ".join(random.Random(1).sample(passage, 12)), "en")]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "too short"), (3, None), (None, "x y z x y z x")], "item_id long, text string")
    got = tiling.contaminated(docs_of(rows), items, broadcast_bytes=limit).collect()
    assert sorted((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in got) == [(50, 1, 12, 1), (51, 1, 12, 2)]
    again = [(50, rows[-4][1], "en"), (50, rows[-4][1], "en"), (None, rows[-4][1], "en")]
    found = tiling.contaminated(docs_of(again), items.union(items.where("item_id = 1")), broadcast_bytes=limit).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(50, 1), (None, 1)}
    assert tiling.contaminated(docs_of(rows).limit(0), items, broadcast_bytes=limit).count() == 0
    assert tiling.contaminated(docs_of(rows), items.limit(0), broadcast_bytes=limit).count() == 0


TALK = {"en": "the river and the house with this that which you have from there when what were", "fr": "le fleuve et la maison avec ceci que vous avez dans leur quand est une pour",
        "ru": "река и дом это что вы когда было для них очень она только меня", "de": "der fluss und das haus mit dieser die wenn nicht auch eine werden ist für"}


def talk(lang, n, seed):
    return " ".join(random.Random(seed).choices(TALK[lang].split(), k=n))


def test_language_held_out_and_spans(docs_of, odd_rows):
    rows = [(1000 + i, talk(lang, 40, i), lang) for i, lang in enumerate(list(TALK) * 25)]
    model = language.fit(docs_of(rows + [(5000, "text without a label", None)]))
    test = [(i, talk(lang, 30, 7000 + i), lang) for i, lang in enumerate(list(TALK) * 10)]
    got = language.identify(docs_of(test).withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 39
    mixed = language.identify(docs_of([(1, talk("en", 30, 1) + " " + talk("fr", 20, 2) + " " + talk("ru", 40, 3), None)]), model).first()
    assert [s.lang for s in mixed.spans] == ["en", "fr", "ru"] and mixed.lang_pred == "ru" and 0 < mixed.score < 1
    odd = {r.doc_id: r for r in language.identify(docs_of(odd_rows), model).collect()}
    assert odd[3].lang_pred == odd[4].lang_pred == odd[7].lang_pred == "und" and odd[3].score == 0.0
    empty = language.fit(docs_of(rows).limit(0))
    assert {r.lang_pred for r in language.identify(docs_of(odd_rows), empty).collect()} == {"und"}


def test_paths_equal_viterbi():
    rng = np.random.default_rng(1)
    scorer = language.Scorer(language.Model(["a", "b", "c"], np.ones((language.BUCKETS, 3)), np.ones((language.SCRIPTS, 3))), 8.0)
    words = [[f"w{rng.integers(400)}" for _ in range(n)] for n in (1, 5, 300, 40, 2)] + [[]]
    scorer.rows([w for t in words for w in t])
    scorer.table = rng.normal(0, 3, scorer.table.shape).astype(np.float32)

    def worth(score, path):
        return sum(score[t, p] for t, p in enumerate(path)) - 8.0 * sum(a != b for a, b in zip(path, path[1:]))

    for t, path in zip(words, scorer.paths(words)):
        if t:
            score = scorer.table[[scorer.known[w] for w in t]].astype(float)
            assert abs(worth(score, path) - worth(score, language.viterbi(score, 8.0))) < 1e-6


def test_two_stretches_beat_the_best_single_language():
    scorer = language.Scorer(language.Model(["a", "b", "c"], np.ones((language.BUCKETS, 3)), np.ones((language.SCRIPTS, 3))), 8.0)
    scorer.rows(["x", "y", "z"])
    scorer.table[[scorer.known[w] for w in "xyz"]] = [[-7, 0, -50], [-7, -50, 0], [0, -50, -50]]
    assert [p.tolist() for p in scorer.paths([["x", "y"], ["z"], ["x", "y"], ["x", "z", "y"]])] == [[1, 2], [0], [1, 2], [0, 0, 0]]
    rng = np.random.default_rng(2)
    for n in (2, 3, 4, 6):
        for _ in range(300):
            scorer.table = rng.integers(-12, 1, (3, 3)).astype(np.float32)
            words = [rng.choice(["x", "y", "z"]) for _ in range(n)]
            score = scorer.table[[scorer.known[w] for w in words]].astype(float)
            worth = [sum(score[range(n), p]) - 8 * np.count_nonzero(np.diff(p)) for p in (scorer.paths([words])[0], language.viterbi(score, 8.0))]
            assert worth[0] == worth[1]


def test_toxicity_chain(spark, docs_of, odd_rows):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad, low = i % 4 == 0, i % 3 == 0
        text = talk("en", 60, i) + (" " + rng.choice(["scum", "scummy", "scumbag"]) if bad else "") + (" buy cheap" if low else "")
        rows.append((i, text, "en"))
        labels.append((i, int(low) if i != 5 else None, int(bad)))
    known = spark.createDataFrame(labels + [(None, 1, 1), (0, 0, 1), (99999, 1, 0)], "doc_id long, low long, toxic long")
    chain = toxicity.fit_chain(docs_of(rows[:450]), known, ["low", "toxic"])
    got = toxicity.score_chain(docs_of(rows[450:]).withColumn("p_toxic", F.lit("clash")), chain).collect()
    assert all((r.p_toxic >= 0.5) == (r.doc_id % 4 == 0) for r in got) and len(got) == 150
    assert len(chain[1].earlier) == 1
    odd = toxicity.score_chain(docs_of(odd_rows), chain).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.p_toxic <= 1 for r in odd)
    none = toxicity.fit_chain(docs_of(rows).limit(0), known, ["low", "toxic"])
    assert [e.weights for e in none] == [{}, {}]


def test_probabilities_of_a_fold_have_not_seen_its_labels(spark, docs_of, monkeypatch):
    """Turning the labels of one fold round changes the out-of-fold probabilities of the others, not its own."""
    rng = random.Random(8)
    rows = [(i, talk("en", 30, i) + f" mark{i % 40} " + rng.choice(["scum", "kind"]), "en") for i in range(300)]
    kept = []
    store = toxicity.store
    monkeypatch.setattr(toxicity, "store", lambda df, name: kept.append((name, out := store(df, name))) or out)

    def probabilities(turned):
        kept.clear()
        labels = spark.createDataFrame([(i, int("scum" in t) ^ int(i in turned), i % 2 if i % 7 else None) for i, t, _ in rows], "doc_id long, low long, toxic long")
        toxicity.fit_chain(docs_of(rows), labels, ["low", "toxic"], features=50)
        return {r.doc_id: (r.fold, r.p_low) for name, out in kept if name == "toxic-folds" for r in out.collect()}

    before = probabilities(set())
    own = {i for i, (fold, _) in before.items() if fold == 0}
    after = probabilities(own)
    assert len(before) == 300 and 0 < len(own) < 300
    assert all(math.isclose(before[i][1], after[i][1], abs_tol=1e-9) for i in own)
    assert any(abs(before[i][1] - after[i][1]) > 0.1 for i in before.keys() - own)


def test_link_is_a_logistic_function():
    link = toxicity.Link("c", {"a$": 2.0, "b$": -1.0}, [0.5], 0.25)
    assert math.isclose(link.probability(["a$", "b$", "z$"], [0.5]), 1 / (1 + math.exp(-(0.25 + 2 - 1 + 0.25))))
    assert toxicity.Reader([link]).probabilities("A b, a!")[0] == toxicity.Link("c", {"a$": 2.0, "b$": -1.0}, [], 0.25).probability(["a$", "b$"], [])


def plain_identify(train, text):
    """Counts of trigram buckets in dictionaries, candidates by script, and the best of all paths of a short text."""
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for t, lang in train:
        bucket, _, script = language.word_grams(language.words_of(t))
        counts[lang].update(bucket.tolist())
        letters[lang].update(script.tolist())
    names = sorted(counts)
    use = {}
    for s in range(language.SCRIPTS):
        own = {k for k in names if letters[k][s] >= 0.01 * max(1, sum(letters[k].values()))}
        use[s] = own or set(names)
    words = language.words_of(text)
    table = []
    for w in words:
        bucket, _, script = language.word_grams([w])
        own = {k: sum(math.log(counts[k][b] + 0.5) - math.log(sum(counts[k].values()) + 0.5 * language.BUCKETS) for b in bucket.tolist()) for k in names}
        table.append({k: own[k] if k in use[int(script[0])] else min(own.values()) - 20 for k in names})
    worth = {path: sum(row[k] for row, k in zip(table, path)) - 8.0 * sum(a != b for a, b in zip(path, path[1:]))
             for path in itertools.product(names, repeat=len(words))}
    return max(worth.values()), worth


def test_identified_paths_are_the_best_of_all(docs_of):
    train = [(talk(lang, 40, i), lang) for i, lang in enumerate(list(TALK) * 10)]
    model = language.fit(docs_of([(i, t, lang) for i, (t, lang) in enumerate(train)]))
    rng = random.Random(5)
    texts = [" ".join(rng.choice(TALK[rng.choice(["en", "fr", "ru"])].split()) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    for r in language.identify(docs_of([(i, t, None) for i, t in enumerate(texts)]), model).collect():
        top, worth = plain_identify(train, r.text)
        path = tuple(s.lang for s in r.spans for _ in range(s.first, s.end))
        assert math.isclose(worth[path], top, abs_tol=1e-3)
        weight = Counter()
        for w, k in zip(language.words_of(r.text), path):
            weight[k] += len(w)
        assert weight[r.lang_pred] == max(weight.values()) and math.isclose(r.score, weight[r.lang_pred] / sum(weight.values()))


def test_numbers_are_no_letters(docs_of):
    model = language.fit(docs_of([(i, talk(lang, 40, i), lang) for i, lang in enumerate(list(TALK) * 5)]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs_of([(1, "½ ² Ⅷ", None), (2, "12_34 ٣", None), (3, "the ½river", None)]), model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en"


def test_thresholds_equal_plain_quantiles(spark, monkeypatch):
    """Variances and z of each language with enough texts, those of all together for the others."""
    held = [r.doc_id for r in spark.range(4000).select(F.col("id").alias("doc_id")).where(kneser_ney.held_out()).limit(560).collect()]
    rng = random.Random(9)
    rows = []
    for i, doc_id in enumerate(held):
        lang = "en" if i < 250 else "de" if i < 510 else "fr"
        size = rng.choice([30, 200, 900, 2500, 6000])
        rows.append((doc_id, lang, i, True, size, math.exp({"en": 1.4, "de": 1.6, "fr": 1.5}[lang] + rng.gauss(0, 1) * math.sqrt({"en": 1, "de": 4, "fr": 2}[lang] / size + 1e-4))))
    asked = [(-1 - i, lang, 0, False, size, 4.5) for i, (lang, size) in enumerate([("en", 500), ("de", 500), ("fr", 500), ("xx", 500)])]
    made = spark.createDataFrame(rows + asked, "doc_id long, lang string, text_hash long, trusted boolean, n_bytes long, perplexity double")
    monkeypatch.setattr(kneser_ney, "perplexities", lambda *_: made)
    got = {r.doc_id: r.threshold for r in kneser_ney.classify_quality(None, None).collect()}

    def spread(points):
        n, off = np.array([p[0] for p in points], float), np.array([p[1] for p in points])
        slope, cut = np.polyfit(n, n * off ** 2, 1)
        if slope < 0:
            slope, cut = 0.0, (n * off ** 2).mean()
        elif cut < 0:
            slope, cut = (n * off ** 2).sum() / n.sum(), 0.0
        z = np.sort(off / np.sqrt(slope + cut / n))
        return slope, cut, z[math.ceil(kneser_ney.QUANTILE * len(z)) - 1]

    of = {k: [(r[4], math.log(r[5])) for r in rows if r[1] == k] for k in ("en", "de", "fr")}
    mean = {k: sum(n * x for n, x in v) / sum(n for n, _ in v) for k, v in of.items()}
    all_off = [(n, x - mean[k]) for k, v in of.items() for n, x in v]
    for doc_id, lang in ((-1, "en"), (-2, "de"), (-3, "fr")):
        between, within, z = spread([(n, x - mean[lang]) for n, x in of[lang]] if len(of[lang]) >= kneser_ney.FEW_TEXTS else all_off)
        wide = between * (1 + 1 / len(of[lang])) + within * (1 / 500 + 1 / sum(n for n, _ in of[lang]))
        assert math.isclose(got[doc_id], math.exp(mean[lang] + z * math.sqrt(wide)) * kneser_ney.MARGIN, rel_tol=1e-6)
    every = sum(n * x for v in of.values() for n, x in v) / sum(n for v in of.values() for n, _ in v)
    between, within, z = spread([(n, x - every) for v in of.values() for n, x in v])
    assert math.isclose(got[-4], math.exp(every + z * math.sqrt(between + within / 500)) * kneser_ney.MARGIN, rel_tol=1e-6)


def plain_model(texts):
    """Interpolated modified Kneser-Ney in dictionaries; returns the log-probability of a text."""
    n = kneser_ney.ORDER
    pad = lambda t: bytes(n - 1) + bytes(kneser_ney.SIGN[b] for b in t.encode())
    levels = {n: Counter(pad(t)[i:i + n] for t in texts for i in range(len(t.encode())))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: kneser_ney.discounts([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}
    total, freed = defaultdict(float), defaultdict(float)
    for k, level in levels.items():
        for g, c in level.items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += cut[k][min(c, 3) - 1]

    def chance(g):
        k = len(g)
        if not k:
            return 1 / 256
        low = chance(g[1:])
        if not total[k, g[:-1]]:
            return low
        c = levels[k][g]
        return ((c - cut[k][min(c, 3) - 1] if c else 0) + freed[k, g[:-1]] * low) / total[k, g[:-1]]

    return lambda t: sum(math.log(chance(pad(t)[i:i + n])) for i in range(len(t.encode())))


def test_perplexities_equal_plain_model(spark, docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 2000)
    rows = odd_rows[:5] + odd_rows[8:] + [(100 + i, talk("en", 50, i), "en") for i in range(20)] + [(200, "QQ@@ ##!!" * 20, "en"), (201, "x1 y2", "xx")]
    trusted = spark.createDataFrame([(i,) for i in [1, 3, None, *range(100, 115), 99999]], "doc_id long")
    held = {r.doc_id for r in docs_of(rows).where(kneser_ney.held_out()).collect()}
    log = plain_model([t for i, t, _ in rows if i in {1, *range(100, 115)} - held])
    assert held & set(range(100, 115))
    for limit in (0, 1000):
        got = kneser_ney.perplexities(docs_of(rows), trusted, broadcast_ids=limit).collect()
        assert len(got) == len(rows)
        texts = defaultdict(set)
        for i, t, _ in rows:
            texts[i].add(math.exp(-log(t) / len(t.encode())) if t else None)
        for r in got:
            assert any(r.perplexity is x if x is None else r.perplexity is not None and math.isclose(r.perplexity, x, rel_tol=1e-5) for x in texts[r.doc_id])
    judged = {r.doc_id: r.keep for r in kneser_ney.classify_quality(docs_of(rows), trusted).collect()}
    assert not judged[200] and all(judged[i] for i in (1, 3, 4, 110, 118))
    assert all(r.keep for r in kneser_ney.classify_quality(docs_of(rows), trusted.limit(0)).collect())
    assert kneser_ney.classify_quality(docs_of(rows).limit(0), trusted).count() == 0


def test_thresholds_follow_length(spark, monkeypatch):
    """Tiny trusted texts of high perplexity do not raise the limit of long ones."""
    held = [r.doc_id for r in spark.range(3000).select(F.col("id").alias("doc_id")).where(kneser_ney.held_out()).limit(400).collect()]
    rng = random.Random(4)
    rows = []
    for i, doc_id in enumerate(held):
        size = rng.choice([3, 7, 20]) if i < 8 else rng.choice([400, 900, 2000, 6000])
        rows.append((doc_id, "en" if i % 2 else "de", 0, True, size, math.exp(1.5 + abs(rng.gauss(0, 1)) * math.sqrt(1 / size + 1e-4))))
    rows[0] = (held[0], "de", 0, True, 3, 13.0)
    junk = [(-1, "en", 0, False, 3905, 7.1), (-2, "en", 0, False, 1409, 7.2), (-3, "xx", 0, False, 3905, 7.1), (-4, "en", 0, False, 0, None)]
    made = spark.createDataFrame(rows + junk, "doc_id long, lang string, text_hash long, trusted boolean, n_bytes long, perplexity double")
    monkeypatch.setattr(kneser_ney, "perplexities", lambda *_: made)
    got = {r.doc_id: r for r in kneser_ney.classify_quality(None, None).collect()}
    assert len(got) == len(rows) + len(junk) and not any(got[i].keep for i in (-1, -2, -3)) and got[-4].keep
    assert sum(got[i].keep for i in held) >= len(held) - 4
    one = spark.createDataFrame(rows[9:10] + junk, made.schema)
    monkeypatch.setattr(kneser_ney, "perplexities", lambda *_: one)
    assert [r.keep for r in kneser_ney.classify_quality(None, None).orderBy("doc_id").collect()] == [True, False, False, False, True]


@pytest.mark.parametrize("batch", [1 << 17, 40])
def test_short_runs_are_scanned_together(monkeypatch, batch):
    """Blocks and shards both grow with the input, so a run gets shorter: what each costs must not decide the time."""
    monkeypatch.setattr(suffixes, "BATCH", batch)
    rng, runs, scans, scan = np.random.default_rng(5), [], [], suffixes.Family.scan
    for _ in range(150):
        key, form, doc = (rng.integers(0, n, 6) for n in (60, 3, 40))
        s = suffixes.Sorted(key.astype(np.uint64), form.astype(np.uint64) << np.uint64(30), doc)
        runs.append((s.key, s.form, s.doc, suffixes.packed(s, 0, len(s.key))))
    monkeypatch.setattr(suffixes.Family, "scan", lambda self, run: scans.append(len(run[0])) or scan(self, run))
    order = rng.permutation(150)  # rows of a group come in any order
    found = suffixes.shard_scan(pa.table({"block": pa.array(order), "shard": pa.array([3] * 150, pa.int32()), "blob": pa.array([runs[i][3] for i in order], pa.binary())}))
    least = {}
    for k, f, d, _ in runs:
        for entry in zip(k.tolist(), f.tolist(), d.tolist()):
            least[entry[:2]] = min(entry[2], least.get(entry[:2], 99))
    docs = {k: [d for (other, _), d in least.items() if other == k] for k, _ in least}
    for i, codes in zip(order, found.column("codes").to_pylist()):
        k, f, d, _ = runs[i]
        want = [1 if least[a, b] < c else 2 if min(docs[a]) < max(docs[a]) else 0 for a, b, c in zip(k.tolist(), f.tolist(), d.tolist())]
        assert np.frombuffer(zstandard.decompress(codes), np.uint8).tolist() == want
    assert len(scans) == 1 if batch > 1000 else 10 < len(scans) < 30


def test_runs_of_a_large_corpus_stay_few():
    """The pipeline's suffix stage on 6 GB of Parquet, about 10 GB of text: a run for each block and shard."""
    text = 10 << 30
    assert text // suffixes.BLOCK_BYTES * suffixes.parts_for(text, suffixes.SHARD_BYTES) < 1_200_000
