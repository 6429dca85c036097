"""Exact top-k inner-product search with an M-tree."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobcast.session import store

PIVOTS = 1024
SUBTREE_ROWS = 4096
PAGE_ROWS = 256
FANOUT = 16
QUERY_BLOCK = 1024
SLACK = 1e-6


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as one matrix of doubles; shorter ones are filled with zeros. Integers below 2**53 stay exact."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lengths)
    cols = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Node:
    """A page: its pivot, covering radius and distance to the parent's pivot, and either entries or children."""

    __slots__ = ("pivot", "lift", "radius", "to_parent", "ids", "rows", "near", "children", "child_pivots", "child_lift", "child_radius", "child_near")

    def __init__(self, pivot: np.ndarray, lift: float) -> None:
        self.pivot, self.lift, self.radius, self.to_parent, self.children = pivot, lift, 0.0, 0.0, None


def lifted(squares: np.ndarray, top: float) -> np.ndarray:
    """The extra coordinate that gives all vectors the same length sqrt(top), so that the nearest has the largest inner product."""
    return np.sqrt(np.maximum(top - squares, 0.0))


def apart(rows: np.ndarray, lift: np.ndarray, pivot: np.ndarray, pivot_lift: float) -> np.ndarray:
    return np.sqrt(((rows - pivot) ** 2).sum(axis=1) + (lift - pivot_lift) ** 2)


def build(ids: np.ndarray, rows: np.ndarray, top: float) -> Node:
    """An M-tree over the rows: pages of at most ``PAGE_ROWS`` entries below nodes of at most ``FANOUT`` children."""
    lift = lifted((rows ** 2).sum(axis=1), top)

    def grow(at: np.ndarray, pivot: int) -> Node:
        node = Node(rows[pivot], float(lift[pivot]))
        node.near = apart(rows[at], lift[at], node.pivot, node.lift)
        node.radius = float(node.near.max(initial=0.0))
        if len(at) <= PAGE_ROWS:
            order = np.argsort(node.near, kind="stable")
            node.ids, node.rows, node.near = ids[at[order]], rows[at[order]], node.near[order]
            return node
        wanted = min(FANOUT, -(-len(at) // PAGE_ROWS))
        chosen, gap = [int(np.argmax(node.near))], None
        while len(chosen) < wanted:  # farthest first
            d = apart(rows[at], lift[at], rows[at[chosen[-1]]], lift[at[chosen[-1]]])
            gap = d if gap is None else np.minimum(gap, d)
            chosen.append(int(np.argmax(gap)))
        pivots = [int(at[c]) for c in chosen]
        dist = np.stack([apart(rows[at], lift[at], rows[p], lift[p]) for p in pivots])
        side = np.argmin(dist, axis=0)
        groups = [at[side == g] for g in range(wanted)]
        if max(map(len, groups)) == len(at):  # all alike: any cut will do
            groups = np.array_split(at, wanted)
            pivots = [int(g[0]) for g in groups]
        node.children = [grow(g, p) for g, p in zip(groups, pivots) if len(g)]
        for c in node.children:
            c.to_parent = float(apart(c.pivot[None], np.array([c.lift]), node.pivot, node.lift)[0])
        node.child_pivots = np.stack([c.pivot for c in node.children])
        node.child_lift = np.array([c.lift for c in node.children])
        node.child_radius = np.array([c.radius for c in node.children])
        node.child_near = np.array([c.to_parent for c in node.children])
        return node

    return grow(np.arange(len(ids)), 0)


def best_first(root: Node, query: np.ndarray, own: int, top: float, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the query's ``k`` best entries that reach ``floor``; equal scores go to smaller ids.

    Pages wait in a heap by the largest score they can hold. A distance to a page or an entry is computed only if the
    stored distance to the parent's pivot does not already exclude it.
    """
    square = float(query @ query)
    reach = lambda score: np.sqrt(max(square + top - 2.0 * score, 0.0)) + SLACK  # noqa: E731  the distance that a score means
    best_s, best_i, limit = np.zeros(0), np.zeros(0, np.int64), floor
    d = np.sqrt(max(square + top - 2.0 * float(root.pivot @ query), 0.0))
    heap = [(max(d - root.radius, 0.0), 0, d, root)]
    count = 0
    while heap:
        low, _, d, node = heapq.heappop(heap)
        within = reach(limit) if limit > -np.inf else np.inf
        if low > within:
            break
        if node.children is not None:
            maybe = np.flatnonzero(np.abs(d - node.child_near) - node.child_radius <= within)
            if len(maybe):
                dist = np.sqrt(np.maximum(square + top - 2.0 * (node.child_pivots[maybe] @ query), 0.0))
                lows = np.maximum(dist - node.child_radius[maybe], 0.0)
                for j in np.flatnonzero(lows <= within):
                    count += 1
                    heapq.heappush(heap, (float(lows[j]), count, float(dist[j]), node.children[maybe[j]]))
            continue
        a, b = np.searchsorted(node.near, (d - within, d + within + SLACK)) if within < np.inf else (0, len(node.ids))
        if a >= b:
            continue
        scores, found = node.rows[a:b] @ query, node.ids[a:b]
        good = (scores >= limit) & (found != own) if limit > -np.inf else found != own
        if good.any():
            best_s, best_i = np.concatenate([best_s, scores[good]]), np.concatenate([best_i, found[good]])
            if len(best_s) > k:
                order = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[order], best_i[order]
            if len(best_s) == k:
                limit = max(limit, float(best_s.min()))
    return best_i, best_s


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner product for each query row.

    Both frames hold an id and an array of whole numbers; shorter arrays count as filled with zeros, rows with a missing id
    or a missing array or element take no part. A row is no candidate of the query with the same id; other repeated rows
    each count; of query rows with one id the least vector is asked. Equal scores go to smaller ids. Fewer candidates than ``k`` give fewer rows. Scores must stay below 2**53.

    Index: up to ``PIVOTS`` pivots, drawn by hash, are the tree's upper nodes. Each row goes to its nearest pivot; a
    pivot with more than ``SUBTREE_ROWS`` rows, such as one of many equal vectors, has several subtrees, cut by a hash of the
    id. One task builds the pages of one subtree. Search: every query runs first in the subtree nearest to it, which gives a
    score that its answers must reach, then, in blocks of ``QUERY_BLOCK``, in all others, where that score closes
    most pages early. What is sent per query and subtree is at most ``k`` rows.
    """
    spark = vectors.sparkSession
    whole = F.col(vec_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull()), F.lit(False))
    rows = store(vectors.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v")), "vectors")
    asks = queries.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"),
                    F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("top")).first()
    most = asks.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not size["n"] or not most["n"]:
        return spark.createDataFrame([], schema)
    width, top = max(size["width"], most["width"]), float(size["top"])
    n_pivots = max(1, min(PIVOTS, -(-size["n"] // SUBTREE_ROWS)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()  # at most PIVOTS rows
    pivots = padded(pa.array([r["v"] for r in drawn], pa.list_(pa.int64())), width)
    pivot_lift = lifted((pivots ** 2).sum(axis=1), top)

    def nearest(lift: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    m = padded(b.column(1), width)
                    up = lifted((m ** 2).sum(axis=1), top) if lift else np.zeros(len(m))
                    d = (pivots ** 2).sum(axis=1) + pivot_lift ** 2 - 2 * (m @ pivots.T + up[:, None] * pivot_lift)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmin(d, axis=1).astype(np.int32))], names=["id", "v", "pivot"])
        return run

    typed = "id long, v array<long>, pivot int"
    placed = rows.mapInArrow(nearest(True), typed)
    cuts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(SUBTREE_ROWS)).cast("int").alias("cuts"))  # one row per pivot
    cuts = {r["pivot"]: r["cuts"] for r in cuts.collect()}
    cut = F.create_map(*[F.lit(x) for p in cuts.items() for x in p])
    placed = placed.withColumn("cut", F.pmod(F.xxhash64("id"), cut[F.col("pivot")]).cast("int"))

    def pages(t: pa.Table) -> pa.Table:
        m = padded(t.column("v"), width)
        tree = build(t.column("id").to_numpy(), m, top)
        return pa.table({"pivot": t.column("pivot")[:1].combine_chunks(), "cut": t.column("cut")[:1].combine_chunks(), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    index = store(placed.groupBy("pivot", "cut").applyInArrow(pages, "pivot int, cut int, tree binary"), "m-tree")

    def search(floors: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            if left.num_rows and right.num_rows:
                m, ids = padded(left.column("v"), width), left.column("id").to_numpy()
                limits = left.column("floor").to_numpy() if floors else np.full(len(ids), -np.inf)
                for blob in right.column("tree").to_pylist():
                    tree = pickle.loads(blob)
                    for q, own, limit in zip(m, ids.tolist(), limits.tolist()):
                        found, scores = best_first(tree, q, own, top, k, limit)
                        out["query_id"].append(np.full(len(found), own))
                        out["vec_id"].append(found)
                        out["score"].append(scores)
            flat = {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}
            return pa.table(flat)
        return run

    result = "query_id long, vec_id long, score long"
    homes = store(asks.mapInArrow(nearest(False), typed), "queries")
    home = homes.withColumn("cut", F.pmod(F.xxhash64("id"), cut[F.col("pivot")]).cast("int"))
    blocks = max(1, -(-most["n"] // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    # a tree goes once to each block of queries
    each = index.select("pivot", "cut", "tree", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    keys = ["pivot", "cut", "block"]
    first = store(home.select("id", "v", "pivot", "cut", block).groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(search(False), result), "first-answers")
    floor = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(
        F.col("query_id").alias("fq"), F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    trees = sorted((p, c) for p, n in cuts.items() for c in range(n))
    targets = F.array(*[F.struct(F.lit(p).alias("pivot"), F.lit(c).alias("cut")) for p, c in trees])
    bounded = home.join(floor, home["id"] == floor["fq"], "left").select(
        "id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.col("pivot").alias("hp"), F.col("cut").alias("hc"), block)
    spread = bounded.select("id", "v", "floor", "block", "hp", "hc", F.explode(targets).alias("t")).where(
        (F.col("t.pivot") != F.col("hp")) | (F.col("t.cut") != F.col("hc"))).select("id", "v", "floor", F.col("t.pivot").alias("pivot"), F.col("t.cut").alias("cut"), "block")
    rest = spread.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(search(True), result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def scaled(vectors: DataFrame, factor: int, vec_col: str = "embedding") -> DataFrame:
    """Each component x as floor(factor * x) in doubles; vectors that are missing or hold a missing or non-finite component are left out."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & F.coalesce(fine, F.lit(False))).withColumn(
        vec_col, F.transform(vec_col, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))
