"""URL filter: host and path rules first, then the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobcast.session import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDER = 4
#: Stands before the first character and after the last.
EDGE = "\x01"
#: Characters of a text whose grams are taken at a time.
PIECE = 512


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule: str) -> Column:
    """The rule's host or a subdomain of it, and a path that starts with the rule's (from its first ``/``)."""
    of_host, slash, of_path = rule.partition("/")
    return ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + of_path)


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``ruled`` (the rule's verdict); of several fitting rules the longest wins,
    of equally long ones the first in alphabetical order. For rule lists short enough to be part of a plan."""
    host, path = F.col("host"), F.col("path")
    out = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        fits = rule_fits(host, path, text)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


def grams_of(text: Column) -> Column:
    """Every character with the ``ORDER`` characters before it, the end included."""
    padded = F.concat(F.lit(EDGE * ORDER), text, F.lit(EDGE))
    # a place in a text is found by counting from its start: long texts are cut first
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE)), lambda c: F.substring(padded, (c * PIECE + 1).cast("int"), F.lit(PIECE + ORDER)))
    return F.flatten(F.transform(pieces, lambda piece: F.transform(
        F.sequence(F.lit(1), F.length(piece) - ORDER), lambda i: F.substring(piece, i, F.lit(ORDER + 1)))))


def gram_scores(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (gram) with ``llr``: log of the accepted model's probability of the last character over the rejected's.

    ``counts`` has ``gram, n_allow, n_block``. Both models are Markov chains of variable order, smoothed by
    Witten-Bell: a context seen n times with t different continuations gives weight n / (n + t) to its own counts and the
    rest to the context without its first character; below order 0 stands an even chance of 1/256.
    """
    models = ("allow", "block")
    out, chance = wanted, {m: F.lit(1 / 256) for m in models}
    for k in range(ORDER + 1):
        tail = counts.groupBy(F.right("gram", F.lit(k + 1)).alias("g")).agg(*[F.sum(f"n_{m}").alias(f"c_{m}") for m in models])
        tail = store(tail, "url-grams")
        context = tail.groupBy(F.substring("g", 1, k).alias("h")).agg(
            *[F.sum(f"c_{m}").alias(f"t_{m}") for m in models],
            *[F.sum(F.when(F.col(f"c_{m}") > 0, 1).otherwise(0)).alias(f"u_{m}") for m in models])
        of = out.select("gram", *[F.col(f"p_{m}") if k else chance[m].alias(f"p_{m}") for m in models],
                        F.right("gram", F.lit(k + 1)).alias("g"), F.substring("gram", ORDER + 1 - k, k).alias("h"))
        joined = of.join(tail, "g", "left").join(context, "h", "left")
        out = joined.select("gram", *[F.when(
            F.coalesce(F.col(f"t_{m}"), F.lit(0)) > 0,
            (F.coalesce(F.col(f"c_{m}"), F.lit(0)) + F.col(f"u_{m}") * F.col(f"p_{m}")) / (F.col(f"t_{m}") + F.col(f"u_{m}"))
        ).otherwise(F.col(f"p_{m}")).alias(f"p_{m}") for m in models])
    return out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("llr"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", whole: bool = False) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of ``pages`` (key, url; other columns are not read).

    The longest fitting rule decides. Where none fits, two character models decide, one of the URLs that rules allow
    and one of those they block, learned from four fifths of the different ruled texts, weighted by their number. A text is
    host and path or, with ``whole``, the URL as it is: scheme, query and fragment included, also without ``://``. ``score``
    is the mean log-likelihood difference per character. The remaining fifth calibrates the limit: the point that lies the
    same number of standard deviations from both classes' means. At or above it a URL is allowed. Without ruled URLs
    on both sides there is nothing to compare: the score is null and the verdict ``allow``. A missing or malformed URL has
    empty host and path; a missing one, and without ``whole`` a malformed one, is judged like an empty text. Repeated keys keep a row each.
    """
    text = F.coalesce("url", F.lit("")) if whole else F.concat("host", "path")
    judged = apply_rules(pages.select(key, "url"), rules).withColumn("text", text).drop("url")
    texts = store(judged.groupBy("text").agg(F.count("*").alias("n"), F.first("ruled").alias("ruled")).withColumns({
        "held": F.pmod(F.xxhash64("text"), F.lit(5)) == 0, "id": F.md5("text")}), "url-texts")  # grams carry the id, not the text
    gram = F.explode(grams_of(F.col("text"))).alias("gram")
    train = texts.where("ruled is not null and not held").select("n", "ruled", gram)
    counts = store(train.groupBy("gram").agg(*[
        F.sum(F.when(F.col("ruled") == m, F.col("n")).otherwise(0)).alias(f"n_{m}") for m in ("allow", "block")]), "url-counts")
    asked = texts.where("ruled is null or held")
    places = asked.select("id", gram)
    wanted = places.select("gram").distinct()
    scores = places.join(gram_scores(counts, wanted), "gram").groupBy("id").agg(F.avg("llr").alias("score"))
    scored = store(asked.join(scores, "id").select("text", "ruled", F.round("score", 9).alias("score")), "url-scores")
    sides = texts.where("not held").agg(*[F.count(F.when(F.col("ruled") == m, 1)).alias(m) for m in ("allow", "block")]).first()
    stats = scored.where("ruled is not null").groupBy("ruled").agg(
        F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("sd")).collect()
    by = {r["ruled"]: r for r in stats}
    if len(by) == 2:
        a, b = by["allow"], by["block"]
        spread = a["sd"] + b["sd"]
        limit = (a["mean"] * b["sd"] + b["mean"] * a["sd"]) / spread if spread else (a["mean"] + b["mean"]) / 2
    else:
        limit = 0.0
    trained = bool(sides["allow"] and sides["block"])
    score = F.when(F.col("ruled").isNull() & F.lit(trained), F.col("score"))
    return judged.join(scored.drop("ruled"), "text", "left").select(
        key, "host", "path", "rule",
        F.coalesce("ruled", F.when(score < limit, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
