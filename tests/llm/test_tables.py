"""URL rules and models, shards, the pipeline and the registration."""

import math
import statistics
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from jobcast.llm import queries, sharding, urls
from jobcast.llm.queries import URL_RULES

URLS = [(1, "https://A.Example.NET/en/x?q#f"), (2, "http://example.net/fr/"), (3, "ftp://net"), (4, None), (5, "no scheme"), (6, ""),
        (7, "http://b.example.com/de/1"), (8, "http://example.com/dex"), (9, "http://news.org/fr/a"), (10, "http://x.org#/fr/"), (11, "a://b://c/d"),
        (None, "http://badexample.net/en/"), (2, "http://example.net/fr/"), (12, "http://ÄB.org/fr/é?")]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = min((rest.split(c, 1)[0] for c in "/?#"), key=len)
    path = min((rest[len(host):].split(c, 1)[0] for c in "?#"), key=len)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(r), r, v) for v, r in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(3))
    got = urls.judge_urls(df, URL_RULES).collect()
    want = Counter()
    for i, u in URLS:
        host, path = plain_parts(u)
        want[(i, host, path, plain_rule(host, path)[0])] += 1
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0


def plain_llr(counts, text):
    """Variable-order chains with Witten-Bell smoothing, in dictionaries."""
    k, edge = urls.ORDER, urls.EDGE
    total, kinds, seen = defaultdict(float), defaultdict(set), defaultdict(float)
    for (m, g), n in counts.items():
        for j in range(k + 1):
            tail = g[k - j:]
            seen[m, tail] += n
            total[m, tail[:-1], j] += n
            kinds[m, tail[:-1], j].add(tail[-1])

    def chance(m, g):
        p = 1 / 256
        for j in range(k + 1):
            tail = g[k - j:]
            t, u = total[m, tail[:-1], j], len(kinds[m, tail[:-1], j])
            if t:
                p = (seen[m, tail] + u * p) / (t + u)
        return p

    padded = edge * k + text + edge
    each = [math.log(chance("allow", padded[i:i + k + 1])) - math.log(chance("block", padded[i:i + k + 1])) for i in range(len(text) + 1)]
    return sum(each) / len(each)


def test_url_scores_equal_plain_models(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'casino'}{i % 7}.{'example.net/en/' if i % 2 else 'net/'}{i % 11}") for i in range(200)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'casino'}{i}.com/x/{i}") for i in range(20)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    texts = Counter(plain_parts(u) for _, u in rows)
    held = {r.t for r in spark.createDataFrame([(h + p,) for h, p in texts], "t string").where(F.pmod(F.xxhash64("t"), F.lit(5)) == 0).collect()}
    counts = Counter()
    for (h, p), n in texts.items():
        verdict, t = plain_rule(h, p)[1], h + p
        if verdict and t not in held:
            padded = urls.EDGE * urls.ORDER + t + urls.EDGE
            for i in range(len(t) + 1):
                counts[verdict, padded[i:i + urls.ORDER + 1]] += n
    for i in range(20):
        assert abs(got[1000 + i].score - plain_llr(counts, got[1000 + i].host + got[1000 + i].path)) < 1e-6
        assert got[1000 + i].verdict == ("allow" if i % 2 else "block")


def test_limit_lies_between_the_held_out_classes(spark):
    """As many standard deviations from both means; a very long URL is judged like any other."""
    rows = [(i, f"http://{'good' if i % 2 else 'casino'}{i % 50}.{'example.net/en/' if i % 2 else 'net/'}{i % 37}") for i in range(400)]
    rows += [(1000 + i, f"http://{'good' if i % 2 else 'casino'}{i}.com/" + ("good" if i % 2 else "casino") * 20_000) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, URL_RULES, whole=True).collect()}
    texts = Counter(u for _, u in rows)
    held = {r.t for r in spark.createDataFrame([(u,) for u in texts], "t string").where(F.pmod(F.xxhash64("t"), F.lit(5)) == 0).collect()}
    counts, sides = Counter(), {"allow": [], "block": []}
    verdict_of = {u: plain_rule(*plain_parts(u))[1] for u in texts}
    for u, n in texts.items():
        if verdict_of[u] and u not in held:
            padded = urls.EDGE * urls.ORDER + u + urls.EDGE
            for i in range(len(u) + 1):
                counts[verdict_of[u], padded[i:i + urls.ORDER + 1]] += n
    for u in texts:
        if verdict_of[u] and u in held:
            sides[verdict_of[u]].append(round(plain_llr(counts, u), 9))
    (ma, sa), (mb, sb) = [(statistics.fmean(v), statistics.pstdev(v)) for v in (sides["allow"], sides["block"])]
    limit = (ma * sb + mb * sa) / (sa + sb)
    assert sa and sb and mb < limit < ma
    assert all((got[1000 + i].score >= limit) == (got[1000 + i].verdict == "allow") == bool(i % 2) for i in range(4))


def test_whole_urls_are_judged(spark):
    """The query string decides where host and path say nothing, also without a scheme."""
    rows = [(i, f"http://{'a.example.net/en/' if i % 2 else 'b.net/'}{i % 9}?{'news=story' if i % 2 else 'win=casino'}{i}#top") for i in range(300)]
    rows += [(1000 + i, f"http://same.host/page?{'news=story' if i % 2 else 'win=casino'}{i}") for i in range(20)]
    rows += [(2000, "news=story"), (2001, "win=casino"), (2002, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages, URL_RULES, whole=True).collect()}
    assert len(got) == len(rows) and all(got[1000 + i].verdict == ("allow" if i % 2 else "block") for i in range(20))
    assert got[2000].score > got[2001].score and got[2000].host == got[2001].path == "" and got[2002].score is not None


def test_shards(spark):
    rows = [(i, i * 7 % 13) for i in range(3000)] + [(5, 1)] * 20 + [(None, 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("slot", F.lit("clash"))
    got = sharding.shard_rows(df, "doc_id", sharding.even_tree(8), sharding.even_tree(8, 1), slice_rows=40).collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(8))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert 0.07 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.16
    assert sharding.shard_rows(df.limit(0), "doc_id", sharding.even_tree(8)).count() == 0


def plain_place(key, tree):
    """The tree's draws with a plain XXH64."""
    def draw(name, weight):
        h = xxhash.xxh64_intdigest(key.encode(), xxhash.xxh64_intdigest(name.encode(), 42))
        return -math.log(((h >> 11) + 0.5) / float(1 << 53)) / weight

    weight = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = min((r for r in tree if sum(weight[r].values()) > 0), key=lambda r: draw(f"region/{r}", sum(weight[r].values())))
    rack = min((k for k in tree[region] if weight[region][k] > 0), key=lambda k: draw(f"rack/{k}", weight[region][k]))
    return min((s for s, w in tree[region][rack].items() if w > 0), key=lambda s: draw(f"shard/{s}", tree[region][rack][s]))


def test_places_equal_plain_draws(spark):
    uneven = {"a": {"a1": {0: 1.0, 1: 2.5}, "a2": {2: 1.0, 9: 0.0}}, "b": {"b1": {3: 2.0}}, "c": {"c1": {4: 0.0}}}
    keys = [str(i) for i in range(400)] + ["", "é日", "x" * 5000]
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    for tree in (uneven, sharding.even_tree(8), sharding.even_tree(8, 1)):
        got = rows.select("k", sharding.place(F.col("k"), tree).alias("s")).collect()
        assert {r.k: r.s for r in got} == {k: plain_place(k, tree) for k in keys}


def test_shards_of_null_and_equal_rows(spark):
    """Null texts and ids, columns with the results' names, and one row many times."""
    rows = [(i % 3 if i % 5 else None, None if i % 2 else "t", 99, 98) for i in range(600)] + [(7, None, 1, 1)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, grown_shard int")
    got = sharding.shard_rows(df, "doc_id", sharding.even_tree(8), slice_rows=16).collect()
    assert len(got) == 1500 and all(r.grown_shard is None for r in got) and {r.shard for r in got} <= set(range(8))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.shard for r in got if r.doc_id == 7} == {plain_place("7", sharding.even_tree(8))}


def test_weights_move_only_their_subtree(spark):
    tree = {"a": {"a1": {0: 1.0, 1: 1.0}, "a2": {2: 1.0}}, "b": {"b1": {3: 2.0}}}
    heavier = {"a": {"a1": {0: 1.0, 1: 3.0}, "a2": {2: 1.0}}, "b": {"b1": {3: 2.0}}}
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k")).select(
        sharding.place(F.col("k"), tree).alias("x"), sharding.place(F.col("k"), heavier).alias("y"))
    moves = {(r.x, r.y): r["count"] for r in rows.groupBy("x", "y").count().collect()}
    assert not [m for m in moves if m[0] != m[1] and m[1] == 3]  # nothing moves to a region whose weight stayed
    assert abs(sum(n for (x, _), n in moves.items() if x == 3) / 20000 - 0.4) < 0.02


def test_hash_tree_query(spark, sf_dir):
    got = queries.QUERIES["op10_hash_tree"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(sf_dir + "/documents.parquet").select("doc_id", "text").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "key" for r in got)


def test_pipeline_stages(spark, sf_dir, docs_of, odd_rows):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf_dir)
        after = {r.doc_id for r in kept.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(odd_rows).limit(0), sf_dir).count() == 0, name
        assert 0 < stage(spark, docs_of(odd_rows), sf_dir).count() <= len(odd_rows), name


def test_stages_tell_rows_apart_by_text(spark, sf_dir, docs_of):
    """Rows without an id, and clean rows whose id another text has."""
    item = max((r.text for r in spark.read.parquet(sf_dir + "/benchmark.parquet").where("text is not null").collect()), key=len)
    clean = " ".join(f"clean{i}" for i in range(40))
    rows = [(None, "before " + item + " after", "en"), (7, item, "en"), (7, clean, "en"), (8, clean + " else", "en"), (None, None, "en")]
    assert sorted(r.text or "" for r in corpus_pipeline.benchmark_passages(spark, docs_of(rows), sf_dir).collect()) == ["", clean, clean + " else"]
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, clean, "en"), (7, clean, "en"), (7, other, "en"), (None, clean, "en")]
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs_of(rows), sf_dir).collect()}
    assert kept == {(1, clean), (7, other)}


def test_stages_keep_columns_that_clash(spark, sf_dir, docs_of):
    """Columns that bear the names of an operator's results stay as they are."""
    names = ["fp", "component", "component_id", "text_hash", "spans", "kept", "block", "blob", "keep", "threshold", "perplexity", "__again"]
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en"), (2, text, "en"), (3, text + " and more than that", "en"), (4, None, "en"), (5, "other words", "en")]
    docs = docs_of(rows).withColumns({n: F.lit(f"own {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        got = kept.collect()
        assert got and all(r[n] == f"own {n}" for r in got for n in names), name


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
