"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one for each shard of a label.

The vectors of a label are dealt into shards of about SHARD_ROWS and each shard gets a graph (Malkov and Yashunin, 2018).
A vector that lies within a small angle of a node joins that node's bundle instead of the graph, so a dense group of near
copies is a few nodes. Every vector queries the graph of its own shard and of every later one, in blocks: a beam search
that does not stop while it meets nodes whose bundle could hold a vector within the threshold. A bundle whose centre and
radius prove that all its vectors link is counted as a whole; of other bundles each cosine is verified in double precision.
A recall audit compares some queries of each block with all of the shard; the beam is doubled and the block searched again
until the audit passes. A block hands on counts of links and the links of a spanning forest only, so a dense group does
not give all its pairs.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.shared import connected_components, hot_join, staged, unstaged

THRESHOLD = 0.98
SHARD_ROWS, BLOCK_ROWS = 8192, 1024
#: Links of a node on upper layers (twice as many on the lowest), up to as many more before they are thinned out; beam while building, first beam of a search.
LINKS, BUILD_BEAM, FIRST_BEAM = 12, 48, 32
#: Nearest neighbours of a node that link to it at last.
BACK = 3
#: Queries of a block that are audited, and the share of their links that must be found.
AUDITED, RECALL = 48, 1.0
#: The graph is walked in single precision; what comes this near to the threshold is verified. Angles are trusted to SLACK.
MARGIN, SLACK = 1e-4, 1e-6


class Graph:
    """A navigable small-world graph over unit vectors; layers[k][i] are the neighbours of node i on layer k.

    near is the cosine from which a vector joins the bundle of a node. members[i] are the rows of node i's bundle, itself
    first; centre and radius (an angle) bound a bundle, and reach is the largest angle of a row to its node.
    """

    def __init__(self, vectors: np.ndarray, near: float = 2.0, seed: int = 7):
        self.unit = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
        n = len(self.unit)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        self.layers: list[dict[int, np.ndarray]] = [{} for _ in range(int(levels.max()) + 1)]
        self.entry, self.top = 0, int(levels[0])
        self.into = np.zeros(n, np.int64)  # links to each node on the lowest layer
        self.seen, self.turn = np.zeros(n, np.int64), 0
        self.near, self.members = near, {}
        for i in range(n):
            self._insert(i, int(levels[i]))
        self._connect()
        exact = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.centre, self.radius, self.reach = {}, {}, 0.0
        for i, own in self.members.items():
            self.members[i] = rows = np.array(own, np.int64)
            if len(rows) > 1:
                middle = exact[rows].mean(axis=0)
                self.centre[i] = middle / np.linalg.norm(middle)
                self.radius[i] = float(np.arccos(np.clip((exact[rows] @ self.centre[i]).min(), -1, 1)))
                self.reach = max(self.reach, float(np.arccos(np.clip((exact[rows] @ exact[i]).min(), -1, 1))))

    def _insert(self, i: int, level: int) -> None:
        start = [self.entry]
        if i:
            for k in range(self.top, level, -1):
                start = [self._beam(self.unit[i], start, k, 1)[0][1]]
            best, node = self._beam(self.unit[i], start, 0, 8)[0]
            if best >= self.near:
                self.members[node].append(i)
                return
        self.members[i] = [i]
        for k in range(min(level, self.top) if i else -1, -1, -1):
            found = self._beam(self.unit[i], start, k, BUILD_BEAM)
            chosen = self._spread(found, LINKS)
            self.layers[k][i] = np.array(chosen, np.int64)
            if k == 0:
                self.into[chosen] += 1
            most = LINKS * (2 if k == 0 else 1)
            for j in chosen:
                near = np.append(self.layers[k][j], i)
                if len(near) > most + LINKS:
                    ranked = sorted(zip((self.unit[near] @ self.unit[j]).tolist(), near.tolist(), strict=True), reverse=True)
                    kept = self._spread(ranked, most)
                    if k == 0:  # a node's last link to it stays, so every node can be reached
                        kept += [x for x in set(near.tolist()).difference(kept) if self.into[x] < 2]
                        self.into[list(set(near[:-1].tolist()).difference(kept))] -= 1
                        self.into[i] += i in kept
                    near = np.array(kept, np.int64)
                elif k == 0:
                    self.into[i] += 1
                self.layers[k][j] = near
            start = [x for _, x in found]
        for k in range(len(self.layers)):
            if k <= level:
                self.layers[k].setdefault(i, np.zeros(0, np.int64))
        if level > self.top or not i:
            self.entry, self.top = i, level

    def _connect(self) -> None:
        """Link each node from the BACK nearest of its neighbours, so that a search within a dense region meets it there, and
        the nodes that no way from the entry reaches from the nearest one that is reached."""
        near, reached, todo = self.layers[0], {self.entry}, [self.entry]
        back: dict[int, list[int]] = {}
        for i in self.members:
            for j in near[i][np.argsort(-(self.unit[near[i]] @ self.unit[i]), kind="stable")[:BACK]].tolist():
                if i not in near[j]:
                    back.setdefault(j, []).append(i)
        for j, more in back.items():
            near[j] = np.append(near[j], np.array(more, np.int64))
        for i in [None, *self.members]:
            if i is not None and i not in reached:
                node = self._beam(self.unit[i], [self.entry], 0, FIRST_BEAM)[0][1]
                near[node] = np.append(near[node], i)
                reached.add(i)
                todo.append(i)
            while todo:
                new = [x for x in near[todo.pop()].tolist() if x not in reached]
                reached.update(new)
                todo += new

    def _spread(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Up to most of the ranked (similarity, node), first those that are nearer to the centre than to one taken before."""
        if len(ranked) <= most:
            return [x for _, x in ranked]
        nodes = [x for _, x in ranked]
        between = (self.unit[nodes] @ self.unit[nodes].T).tolist()
        taken: list[int] = []
        for at, (own, _) in enumerate(ranked):
            row = between[at]
            if all(row[x] < own for x in taken):
                taken.append(at)
                if len(taken) == most:
                    break
        rest = [x for x in range(len(nodes)) if x not in set(taken)]
        return [nodes[x] for x in taken + rest[: most - len(taken)]]

    def _beam(self, query: np.ndarray, start: list[int], layer: int, width: int, within: float = 2.0) -> list[tuple[float, int]]:
        """(similarity, node) of the width nearest found and all that were met with a similarity of within or more, best first."""
        self.turn += 1
        seen, turn, near = self.seen, self.turn, self.layers[layer]
        seen[start] = turn
        best = list(zip((self.unit[start] @ query).tolist(), start, strict=True))
        open_ = [(-s, x) for s, x in best]
        heapq.heapify(open_)
        heapq.heapify(best)
        hits = [x for x in best if x[0] >= within]
        while len(best) > width:
            heapq.heappop(best)
        while open_:
            s, x = heapq.heappop(open_)
            if -s < best[0][0] and len(best) >= width and -s < within:
                break
            new = near[x]
            new = new[seen[new] != turn]
            if not len(new):
                continue
            seen[new] = turn
            scores = self.unit[new] @ query
            if len(best) >= width:  # most are worse than all that are kept
                better = scores >= min(best[0][0], within)
                scores, new = scores[better], new[better]
            for s, y in zip(scores.tolist(), new.tolist(), strict=True):
                if s >= within:
                    hits.append((s, y))
                if len(best) < width:
                    heapq.heappush(best, (s, y))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, y))
                elif s < within:
                    continue
                heapq.heappush(open_, (-s, y))
        return sorted(set(best) | set(hits), reverse=True)

    def within(self, query: np.ndarray, threshold: float, width: int, node: int | None = None) -> list[int]:
        """Nodes that a search of this width meets at a similarity of threshold or more; node is the query's own, if it has one."""
        start = [self.entry]
        for k in range(self.top, 0, -1):
            start = [self._beam(query, start, k, 1)[0][1]]
        if node is not None:
            start = list({*start, node})
        return [x for s, x in self._beam(query, start, 0, width, threshold) if s >= threshold]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _build(threshold: float):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        """The graph of one shard, pickled, with its ids and vectors; bundles are as wide as half the threshold's angle."""
        rows = rows.sort_values("id")
        vectors = _matrix(rows["embedding"])
        graph = Graph(vectors, float(np.cos(np.arccos(threshold) / 2)))
        blob = pickle.dumps((rows["id"].to_numpy("int64"), rows["copies"].to_numpy("int64"), vectors, graph), protocol=5)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "size": [rows["size"].iloc[0]], "shard": [rows["shard"].iloc[0]], "graph": [blob]})

    return build


class Links:
    """What queries find in one shard: (whole bundles, single rows) that link with each."""

    def __init__(self, held: tuple, threshold: float):
        self.ids, self.copies, self.vectors, self.graph = held
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.threshold, self.angle = threshold, float(np.arccos(threshold))
        self.node_of = {x: i for i, rows in self.graph.members.items() for x in rows.tolist()}
        self.row_of = {x: row for row, x in enumerate(self.ids.tolist())}
        self.bundle_copies = {i: int(self.copies[rows].sum()) for i, rows in self.graph.members.items()}

    def verified(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return rows[(self.vectors[rows] @ q) / (self.norms[rows] * np.linalg.norm(q)) >= self.threshold]

    def of(self, q: np.ndarray, width: int, own: int | None = None) -> tuple[list[int], np.ndarray]:
        """(nodes whose bundles link as a whole, other rows that link); own is the query's id if it lies in this shard, and is among them."""
        node = self.node_of[self.row_of[own]] if own is not None else None
        graph, exact = self.graph, q / np.linalg.norm(q)
        whole, single = [], []
        for i in graph.within(exact.astype(np.float32), float(np.cos(min(np.pi, self.angle + graph.reach))) - MARGIN, width, node):
            if i in graph.centre:
                apart = float(np.arccos(np.clip(exact @ graph.centre[i], -1, 1)))
                if apart + graph.radius[i] <= self.angle - SLACK:
                    whole.append(i)
                    continue
                if apart - graph.radius[i] > self.angle + SLACK:
                    continue
            single.append(graph.members[i])
        return whole, self.verified(q, np.concatenate(single)) if single else np.zeros(0, np.int64)

    def count(self, found: tuple[list[int], np.ndarray]) -> int:
        return sum(self.bundle_copies[i] for i in found[0]) + int(self.copies[found[1]].sum())

    def truth(self, q: np.ndarray) -> int:
        near = np.nonzero(self.graph.unit @ (q / np.linalg.norm(q)).astype(np.float32) >= self.threshold - MARGIN)[0]
        return int(self.copies[self.verified(q, near)].sum())


def _search(threshold: float):
    def search(queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        """Links of one block of queries into one shard: counts (a, n) for each end, and links (a, b) of a spanning forest."""
        if queries.empty or graphs.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        held = Links(pickle.loads(graphs["graph"].iloc[0]), threshold)
        q_ids, q_copies, q = queries["id"].to_numpy("int64"), queries["copies"].to_numpy("int64"), _matrix(queries["embedding"])
        own = bool(queries["shard"].iloc[0] == graphs["shard"].iloc[0])
        audited = range(0, len(q), max(1, len(q) // AUDITED))
        truth = sum(held.truth(q[i]) for i in audited)
        width = FIRST_BEAM
        while True:
            found = [held.of(x, width, int(i) if own else None) for i, x in zip(q_ids, q, strict=True)]
            if sum(held.count(found[i]) for i in audited) >= RECALL * truth or width >= len(held.ids):
                break
            width *= 2
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest = []

        def join(one: int, other: int) -> None:
            a, b = root(one), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                forest.append((one, other, 0))

        counts: dict[int, int] = {}
        by_bundle, joined = {}, set()
        for i, (whole, single) in enumerate(found):
            one, n = int(q_ids[i]), held.count(found[i])
            n -= int(q_copies[i]) if own else 0  # a vector meets itself in its own shard
            if n:
                counts[one] = counts.get(one, 0) + n
            for node in whole:
                members = held.graph.members[node]
                for x in held.ids[members if node not in joined else members[:1]].tolist():
                    join(one, x)
                joined.add(node)
                by_bundle[node] = by_bundle.get(node, 0) + int(q_copies[i])
            for x in held.ids[single].tolist():
                join(one, x)
                if not own:
                    counts[x] = counts.get(x, 0) + int(q_copies[i])
        for node, n in by_bundle.items() if not own else ():
            for x in held.ids[held.graph.members[node]].tolist():
                counts[x] = counts.get(x, 0) + n
        return pd.DataFrame([*forest, *((x, None, n) for x, n in counts.items())], columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return search


def usable(vectors: DataFrame, extra: list[str]) -> DataFrame:
    """Rows (vec_id, embedding as doubles, extra) whose vector is not null, not zero and free of null and non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    doubles = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *extra)
    return doubles.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine is threshold or more;
    n_links counts the other rows linked directly. Equal vectors of a label are searched once and count as linked.
    component_id is the smallest vec_id reachable, kept whether it is the row's own. Null, zero and non-finite vectors and
    those with a null label or id link with nothing (a null id is its own component_id and kept). Each row is a vector of
    its own, whatever its id: rows that share one keep their own links. An empty table gives an empty one; other columns
    are not read.
    """
    rows = staged(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", "label"))
    valid = usable(rows, ["label", "row"]).where(F.col("label").isNotNull()).withColumn("size", F.size("embedding"))
    same = ["label", "size", "embedding"]
    copies = staged(valid.groupBy(*same).agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    shards = copies.groupBy("label", "size").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows))
    members = hot_join(copies, shards, ["label", "size"], F.col("id"), count="n", total=copies.count())
    members = staged(members.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards"))).withColumn(
        "block", F.pmod(F.xxhash64("id", F.lit("block")), F.ceil(F.col("n") / F.col("shards") / BLOCK_ROWS))
    ))
    kind = members.select("label").schema[0].dataType.simpleString()
    graphs = staged(members.groupBy("label", "size", "shard").applyInPandas(_build(threshold), f"label {kind}, size int, shard long, graph binary"))
    asked = members.withColumn("target", F.explode(F.sequence("shard", F.col("shards") - 1)))
    asked_blocks = asked.select("label", "size", "target", "shard", "block").distinct()
    held = graphs.withColumnRenamed("shard", "target").join(asked_blocks.withColumnRenamed("shard", "from"), ["label", "size", "target"])
    keys = ["label", "size", "target", "from", "block"]
    asked = asked.withColumn("from", F.col("shard"))
    held = held.select(*[F.col(x).alias(x) for x in keys], F.col("target").alias("shard"), "graph")
    found = staged(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_search(threshold), "a long, b long, n long"))
    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null")).withColumnRenamed("node", "id")
    joined = staged(
        copies.select("id", "least", "copies")
        .join(linked, "id", "left")
        .join(components, "id", "left")
        .select("id", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    firsts = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    total = joined.count()
    named = staged(hot_join(joined, firsts, ["component"], F.col("id"), count="nodes", total=total).select("id", "n_links", "component_id"))
    by_hash = lambda df: df.withColumn("hash", F.xxhash64(*same))
    of = by_hash(copies.join(named, "id").select(*same, "copies", "n_links", "component_id"))
    ids = hot_join(by_hash(valid), of, ["hash", *same], F.col("row"), count="copies", total=rows.count()).select("row", "n_links", "component_id")
    return (
        rows.select("row", "vec_id")
        .join(ids, "row", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op10_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same rows from all pairs of a label, for tables whose vec_ids are unique.
OP10_SQL = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM e WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), d AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.x LEFT JOIN d ON vec_id = d.x"""
