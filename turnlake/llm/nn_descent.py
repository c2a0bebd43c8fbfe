"""Nearest vectors by inner product, over a neighbour graph that NN-descent builds.

Equal vectors are one node. Nodes are dealt into shards of about SHARD_ROWS. In each round of NN-descent (Dong and others,
2011) a node's links are joined with the links of its neighbours, unless both links are old, and the best of the
neighbours' neighbours become its new links; rounds end when few links change. First links come from random projections, by
which nodes are sorted and cut into blocks. Queries walk the graph of every shard greedily: a beam of the best nodes met is
kept and the best one not yet left is left next. A shard's graph is read once for each QUERY_ROWS queries, so that the
copies of graphs are no more bytes than the queries. A recall audit compares AUDITED queries of each block with all of
the shard, and the beam and the places where walks begin are doubled until it passes; what it scans only sets the beam, and
the answers of all queries are those of walks. Scores are inner products in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.hnsw_dedup import usable
from turnlake.llm.shared import hot_join, staged, unstaged

SHARD_ROWS = 32768
#: Links of a node; links back to a node that a round looks at; links back in the finished graph; random links of a node.
LINKS, BACK, WALK_BACK, RANDOM = 22, 8, 22, 4
#: Share of changed links at which rounds end.
SETTLED = 0.02
#: Nodes whose candidates one task scores; tables of projections, and rows of a block that are compared for the first links.
SCORED_ROWS, TABLES, FIRST_BLOCK = 4096, 4, 128
#: Queries of a block, those that walk together, those of a block that are audited, the recall they need, the first beam and
#: the places where walks begin.
QUERY_ROWS, TOGETHER, AUDITED, RECALL = 8192, 128, 32, 0.95
FIRST_BEAM, FIRST_PLACES, LEFT_AT_ONCE = 48, 16, 4
SEED = 11


def _matrix(blob: bytes, n: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(n, -1)


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard and their vectors, packed, in double and in single precision."""
    rows = rows.sort_values("node")
    vectors = np.stack(rows["embedding"].to_numpy()).astype("<f8")
    return pd.DataFrame(
        {"size": rows["size"].iloc[:1].to_numpy(), "shard": rows["shard"].iloc[:1].to_numpy(), "nodes": [rows["node"].to_numpy("<i8").tobytes()], "vectors": [vectors.tobytes()], "single": [vectors.astype("<f4").tobytes()]}
    )


def first_links(vectors: np.ndarray, links: int = LINKS, seed: int = SEED) -> np.ndarray:
    """Up to links near rows of each row (-1: none), from blocks of rows that lie together under random projections."""
    n, width = vectors.shape
    rng = np.random.default_rng(seed)
    best = np.full((n, links), -1)
    score = np.full((n, links), -np.inf, np.float32)
    bits = max(0, int(np.log2(max(1, n / FIRST_BLOCK))))
    for _ in range(TABLES):
        projected = vectors @ rng.standard_normal((width, bits + 1)).astype(np.float32)
        signs = (projected[:, 1:] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(n, int)
        order = np.lexsort((projected[:, 0], signs))
        cuts = np.array_split(order, max(1, n // FIRST_BLOCK))
        for block in cuts:
            own = vectors[block] @ vectors[block].T
            np.fill_diagonal(own, -np.inf)
            top = np.argsort(-own, axis=1, kind="stable")[:, :links]
            ids = np.where(np.isfinite(np.take_along_axis(own, top, axis=1)), block[top], -1)
            best[block], score[block] = _best_of(np.hstack([best[block], ids]), np.hstack([score[block], np.take_along_axis(own, top, axis=1)]), links)
    return best


def _best_of(ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most best ids of each row by score, without repeats; -1 where there are fewer."""
    order = np.lexsort((ids, -scores))
    ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(ids, by_id, axis=1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    repeated = np.zeros(ids.shape, bool)
    np.put_along_axis(repeated, by_id, again, axis=1)
    scores = np.where(repeated | (ids < 0), -np.inf, scores)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    ids, scores = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)
    return np.where(np.isfinite(scores), ids, -1), scores


def _first(batches):
    for batch in batches:
        for row in batch.itertuples():
            nodes = np.frombuffer(row.nodes, "<i8")
            links = first_links(_matrix(row.single, len(nodes), "<f4"))
            near = [nodes[x[x >= 0]] for x in links]
            yield pd.DataFrame({"size": row.size, "shard": row.shard, "node": nodes, "near": near, "fresh": near})


def _scored(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The LINKS best of each node's candidates, and those of them that are new."""
    if asked.empty or held.empty:
        return pd.DataFrame({"size": [], "shard": [], "node": [], "near": [], "fresh": []})
    nodes = np.frombuffer(held["nodes"].iloc[0], "<i8")
    vectors = _matrix(held["single"].iloc[0], len(nodes), "<f4")
    near, fresh = [], []
    for node, candidates, before in zip(asked["node"], asked["candidates"], asked["near"], strict=True):
        own = candidates[candidates != node]
        scores = vectors[np.searchsorted(nodes, own)] @ vectors[np.searchsorted(nodes, node)]
        if len(own) > LINKS:
            own = own[np.argpartition(-scores, LINKS)[:LINKS]]
        near.append(own)
        fresh.append(np.setdiff1d(own, before, assume_unique=True))
    return pd.DataFrame({"size": asked["size"].iloc[0], "shard": asked["shard"].iloc[0], "node": asked["node"], "near": near, "fresh": fresh})


LISTS = "size int, shard long, node long, near array<long>, fresh array<long>"


def _block_of(column: str, rows: int, of: Column) -> Column:
    """Number of the block of about rows rows that a row falls in, of which there are of in all."""
    return F.pmod(F.xxhash64(column, F.lit("block")), F.greatest(F.lit(1).cast("long"), F.ceil(of / rows)))


def neighbour_graph(packed: DataFrame, members: DataFrame) -> DataFrame:
    """One row (size, shard, node, near, fresh) for each node: its nearest nodes of the shard, as NN-descent finds them.

    A round joins each link (node, other) with the links of other: with all of them if the link is new, else with the new
    ones. It moves at most (LINKS + BACK) ^ 2 ids for a node, and few once the graph settles.
    """
    lists = staged(packed.select("size", "shard", "nodes", "single").mapInPandas(_first, LISTS))
    total = members.count()
    blocks = members.select("size", "shard", _block_of("node", SCORED_ROWS, F.col("of_shard")).alias("block")).distinct()
    held = staged(packed.select("size", "shard", "nodes", "single").join(blocks, ["size", "shard"]))
    none = F.expr("cast(array() as array<bigint>)")
    while True:
        links = lists.select("node", F.explode("near").alias("other"), "fresh").select("node", "other", F.array_contains("fresh", F.col("other")).alias("new"))
        rank = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", "other"), "node"))
        back = links.withColumn("rank", rank).where(F.col("rank") <= BACK).select(F.col("other").alias("node"), F.col("node").alias("other"), "new")
        sides = links.unionByName(back).groupBy("node").agg(F.collect_set("other").alias("around"), F.collect_set(F.when(F.col("new"), F.col("other"))).alias("newer"))
        around = staged(sides)
        hops = around.select("node", F.explode("around").alias("other"), "newer").select("node", "other", F.array_contains("newer", F.col("other")).alias("new"))
        far = hops.join(around.select(F.col("node").alias("other"), "around", F.col("newer").alias("beyond")), "other")
        beyond = far.select("node", F.when(F.col("new"), F.col("around")).otherwise(F.col("beyond")).alias("beyond")).where(F.size("beyond") > 0)
        beyond = beyond.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("beyond"))).alias("beyond"))
        candidates = (
            lists.join(around.drop("newer"), "node", "left")
            .join(beyond, "node", "left")
            .join(members.select("node", "of_shard"), "node")
            .select(
                "size",
                "shard",
                _block_of("node", SCORED_ROWS, F.col("of_shard")).alias("block"),
                "node",
                "near",
                F.array_distinct(F.concat(F.coalesce("around", none), F.coalesce("beyond", none))).alias("candidates"),
            )
        )
        keys = ["size", "shard", "block"]
        last, lists = lists, staged(candidates.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_scored, LISTS))
        unstaged(last, around)
        if (lists.agg(F.sum(F.size("fresh"))).first()[0] or 0) <= SETTLED * LINKS * total:
            unstaged(held)
            return lists


def _walkable(lists: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard for walks: each row's links, links back (the best WALK_BACK) and random links, -1 for none."""
    nodes = np.frombuffer(held["nodes"].iloc[0], "<i8")
    n = len(nodes)
    vectors = _matrix(held["single"].iloc[0], n, "<f4")
    ahead = np.full((n, LINKS), -1, "<i4")
    for node, near in zip(np.searchsorted(nodes, lists["node"].to_numpy("int64")), lists["near"], strict=True):
        ahead[node, : len(near)] = np.searchsorted(nodes, near)
    a, b = np.repeat(np.arange(n), LINKS), ahead.ravel()
    a, b = a[b >= 0], b[b >= 0]
    scores = np.concatenate([(vectors[a[i : i + 65536]] * vectors[b[i : i + 65536]]).sum(axis=1) for i in range(0, len(a), 65536)] or [np.zeros(0)])
    order = np.lexsort((a, -scores, b))
    a, b = a[order], b[order]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    back = np.full((n, WALK_BACK), -1, "<i4")
    kept = place < WALK_BACK
    back[b[kept], place[kept]] = a[kept]
    random = np.random.default_rng(SEED).integers(0, n, (n, RANDOM)).astype("<i4")
    graph = np.hstack([ahead, back, random])
    return pd.DataFrame({"size": held["size"], "shard": held["shard"], "nodes": held["nodes"], "vectors": held["vectors"], "graph": [graph.tobytes()]})


def walk(queries: np.ndarray, vectors: np.ndarray, graph: np.ndarray, most: int, width: int, places: int) -> np.ndarray:
    """Rows of the most best nodes that a greedy walk of this beam width meets for each query, best first (-1: none)."""
    n, k = len(vectors), len(queries)
    begin = np.unique(np.linspace(0, n - 1, min(n, places)).astype(np.int64))
    scores = queries @ vectors[begin].T
    beam = np.broadcast_to(begin, scores.shape)
    seen = np.zeros((k, n), bool)
    seen[:, begin] = True
    if scores.shape[1] > width:
        top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        beam, scores = np.take_along_axis(beam, top, axis=1), np.take_along_axis(scores, top, axis=1)
    beam, left = beam.copy(), np.zeros(scores.shape, bool)
    if beam.shape[1] < width:
        pad = width - beam.shape[1]
        beam = np.pad(beam, ((0, 0), (0, pad)), constant_values=-1)
        scores = np.pad(scores, ((0, 0), (0, pad)), constant_values=-np.inf)
        left = np.pad(left, ((0, 0), (0, pad)), constant_values=True)
    on = np.arange(k)
    while len(on):
        open_scores = np.where(left[on], -np.inf, scores[on])
        pick = np.argpartition(-open_scores, min(LEFT_AT_ONCE, width) - 1, axis=1)[:, :LEFT_AT_ONCE]
        going = np.isfinite(np.take_along_axis(open_scores, pick, axis=1))
        alive = going.any(axis=1)
        on, pick, going = on[alive], pick[alive], going[alive]
        if not len(on):
            break
        np.put_along_axis(marks := left[on], pick, True, axis=1)
        left[on] = marks
        new = np.where(going[:, :, None], graph[np.take_along_axis(beam[on], pick, axis=1)], -1).reshape(len(on), -1)
        new = np.sort(new, axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        fresh &= ~seen[on[:, None], new]
        rows, columns = np.nonzero(fresh)
        met = new[rows, columns]
        seen[on[rows], met] = True
        got = np.full(new.shape, -np.inf, np.float32)
        got[rows, columns] = np.einsum("ij,ij->i", queries[on[rows]], vectors[met])
        all_scores = np.hstack([scores[on], got])
        top = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        scores[on] = np.take_along_axis(all_scores, top, axis=1)
        beam[on] = np.take_along_axis(np.hstack([beam[on], new]), top, axis=1)
        left[on] = np.take_along_axis(np.hstack([left[on], ~fresh]), top, axis=1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
    return np.where(np.isfinite(np.take_along_axis(scores, order, axis=1)), np.take_along_axis(beam, order, axis=1), -1)


def audited_walk(q: np.ndarray, vectors: np.ndarray, graph: np.ndarray, most: int) -> np.ndarray:
    """Rows of the most nearest nodes found for each query of a block, best first (-1: none).

    Up to AUDITED queries are compared with all vectors; the beam and the places of walks are doubled until these find
    RECALL of their most nearest, and then serve all queries, the audited as well.
    """
    n = len(vectors)
    audited = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDITED)).astype(np.int64))
    truth = q[audited] @ vectors.T
    exact = np.argsort(-truth, axis=1, kind="stable")[:, :most]
    bound = np.take_along_axis(truth, exact[:, -1:], axis=1)
    width, places = max(FIRST_BEAM, 2 * most), FIRST_PLACES
    while True:
        own = walk(q[audited], vectors, graph, most, min(width, max(n, most)), places)
        hits = (own >= 0) & (np.take_along_axis(truth, np.maximum(own, 0), axis=1) >= bound - 1e-5)
        if hits.sum() >= RECALL * min(most, n) * len(audited) or width >= n:
            break
        width, places = 2 * width, 2 * places
    found = np.full((len(q), exact.shape[1]), -1)
    for at in range(0, len(q), TOGETHER):
        own = walk(q[at : at + TOGETHER], vectors, graph, most, min(width, max(n, most)), places)
        found[at : at + TOGETHER, : own.shape[1]] = own[:, : found.shape[1]]
    return found


def _searching(most: int):
    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The most nearest nodes of one shard for each query of a block."""
        if asked.empty or held.empty:
            return pd.DataFrame({"query": [], "node": [], "score": []})
        nodes = np.frombuffer(held["nodes"].iloc[0], "<i8")
        n = len(nodes)
        vectors = _matrix(held["vectors"].iloc[0], n)
        graph = _matrix(held["graph"].iloc[0], n, "<i4")
        exact = np.stack(asked["embedding"].to_numpy()).astype(np.float64)
        found = audited_walk(exact.astype(np.float32), vectors.astype(np.float32), graph, most)
        rows, columns = np.nonzero(found >= 0)
        hit = found[rows, columns]
        scores = np.concatenate([(exact[rows[i : i + 65536]] * vectors[hit[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
        return pd.DataFrame({"query": asked["node"].to_numpy("int64")[rows], "node": nodes[hit], "score": scores})

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding) that is_query holds for, its k nearest.

    Nearness is the inner product; candidates are all rows of another id whose vector has the same length, or all of them
    if they are fewer than k. Order: score, then the smaller vec_id; rank counts from 1. Vectors that are null, zero or
    hold null or non-finite components and rows with a null id take no part; rows that are equal in id and vector count
    once; an id with several vectors asks with each of them, and its ranks are counted for each; an empty table gives an
    empty one; other columns are not read. Of equal vectors the k + 1 smallest ids are kept, as no query can get more.
    """
    rows = usable(vectors.withColumn("_asks", F.coalesce(is_query, F.lit(False))), ["_asks"]).withColumn("size", F.size("embedding"))
    ids = rows.groupBy("size", "embedding", "vec_id").agg(F.max("_asks").alias("asks"))
    distinct = staged(rows.groupBy("size", "embedding").agg(F.max("_asks").alias("asks"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    total = distinct.agg(F.sum("copies")).first()[0] or 0
    by_hash = lambda df: df.withColumn("_hash", F.xxhash64("embedding"))
    of = by_hash(distinct.select("size", "embedding", "node", "copies"))
    named = staged(hot_join(by_hash(ids), of, ["size", "_hash", "embedding"], F.col("vec_id"), count="copies", total=total).select("node", "vec_id", "asks"))
    least = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    holders = named.withColumn("place", least).where(F.col("place") <= k + 1).select("node", "vec_id")
    shards = distinct.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("queries")).withColumn("shards", F.ceil(F.col("n") / shard_rows))
    placed = staged(hot_join(distinct, shards, ["size"], F.col("node"), count="n", total=total).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards"))))
    of_shard = placed.groupBy("size", "shard").agg(F.count("*").alias("of_shard"))
    members = placed.select("size", "shard", "node").join(of_shard, ["size", "shard"])
    packed = staged(placed.select("size", "shard", "node", "embedding").groupBy("size", "shard").applyInPandas(_packed, "size int, shard long, nodes binary, vectors binary, single binary"))
    lists = neighbour_graph(packed, members)
    graphs = staged(
        lists.groupBy("size", "shard").cogroup(packed.groupBy("size", "shard")).applyInPandas(_walkable, "size int, shard long, nodes binary, vectors binary, graph binary")
    )
    asked = staged(
        placed.where("asks")
        .withColumn("block", _block_of("node", QUERY_ROWS, F.col("queries")))
        .select("size", "block", "node", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    )
    keys = ["size", "shard", "block"]
    blocks = asked.select(*[F.col(x).alias(x) for x in keys]).distinct()
    held = graphs.join(blocks, ["size", "shard"])
    met = staged(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_searching(k + 1), "query long, node long, score double"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = met.join(holders, "node").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    answers = ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    asks = named.where("asks").select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    own = hot_join(asks, answers, ["query"], F.col("query_id")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
