"""Nearest neighbours by inner product: a navigable small-world graph for each shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of their components. One
task builds the hierarchical graph of a shard and stores it as one row of flat arrays:
vectors, ids and, for each level, ``degree`` neighbours per node. A query walks the graph
of every shard; the shards' results are merged by score.

Largest inner product becomes nearest neighbour on a sphere: one more component brings
every vector of the shard to the greatest length. Nodes are inserted in batches that
search the graph so far together (one array operation for a step of all of them), their
neighbours are chosen among the nearest found so that they lie in different directions,
and neighbours link back. What the walk finds is scored anew in double precision on the
original components, summed from the first to the last.

Equal vectors are one node with the ids that may be asked for: of a group of copies no
more than ``k + 1`` ids, the smallest, can be among anybody's nearest ``k``, since ties go
to the smaller id and one of them may be the query itself. That limit is taken before the
shuffle, so a vector that a third of all rows share moves k + 1 ids from each partition.
Queries are streamed past the graph in batches; a very large query set is split, and each
part meets its own copy of the graph.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
and rows without id take no part; vectors are compared within their dimension; repeated
rows count once; an id with several vectors is as near as the nearest of them and never finds itself;
with fewer than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

SHARD_ROWS = 8192
DEGREE = 16
BUILD_BEAM = 64
SEARCH_BEAM = 128
BATCH = 256
AT_ONCE = 4
QUERIES_PER_PART = 50_000


class Graph:
    """Nodes on the unit sphere; ``levels[l]`` has the neighbours of each node or -1."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE):
        self.vectors, self.degree = vectors, degree
        scale = np.abs(vectors).max()
        unit = vectors / (scale or 1.0)
        square = (unit**2).sum(axis=1)
        most = square.max()
        lift = np.sqrt(np.maximum(most - square, 0.0))
        self.points = (np.column_stack([unit, lift]) / np.sqrt(most)).astype(np.float32)
        self.scale = scale
        self.levels: list[np.ndarray] = []
        self.entry = 0

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Queries as points: same direction, unit length, nothing in the added component."""
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
        return np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32)

    def walk(self, points: np.ndarray, entries: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found from ``entries``: (nodes or -1, distances), by distance."""
        table, rows = self.levels[level], np.arange(len(points))
        seen = np.zeros((len(points), len(self.points) + 1), dtype=bool)
        seen[:, -1] = True  # where -1 points to
        nodes = np.full((len(points), beam), -1)
        far = np.full((len(points), beam), np.inf, dtype=np.float32)
        done = np.ones((len(points), beam), dtype=bool)
        width = entries.shape[1]
        nodes[:, :width] = entries
        far[:, :width] = np.where(entries < 0, np.inf, 1 - np.einsum("bed,bd->be", self.points[entries], points))
        done[:, :width] = entries < 0
        seen[rows[:, None], entries] = True
        active = rows
        while len(active):
            wait = np.where(done[active], np.inf, far[active])
            count = min(AT_ONCE, beam)
            pick = np.argpartition(wait, count - 1, axis=1)[:, :count] if count < beam else np.tile(np.arange(beam), (len(active), 1))
            real = np.isfinite(np.take_along_axis(wait, pick, 1))
            busy = real.any(axis=1)
            active, pick, real = active[busy], pick[busy], real[busy]
            if not len(active):
                break
            done[active[:, None], pick] |= real
            near = table[np.where(real, nodes[active[:, None], pick], -1)].reshape(len(active), -1)
            new = ~seen[active[:, None], near]
            near = np.where(new, near, -1)
            # A node that two of the expanded nodes share is taken once.
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[active[:, None], near] = True
            away = 1 - np.einsum("bmd,bd->bm", self.points[near], points[active])
            away = np.where(near < 0, np.inf, away)
            all_far = np.concatenate([far[active], away], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            nodes[active] = np.take_along_axis(np.concatenate([nodes[active], near], axis=1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], near < 0], axis=1), best, 1)
            far[active] = np.take_along_axis(all_far, best, 1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)

    def descend(self, points: np.ndarray, to: int) -> np.ndarray:
        """Entry nodes at level ``to``, one for each point."""
        entries = np.full((len(points), 1), self.entry)
        for level in range(len(self.levels) - 1, to, -1):
            entries = self.walk(points, entries, 1, level)[0]
        return entries

    def spread(self, near: np.ndarray, far: np.ndarray, count: int) -> np.ndarray:
        """Of candidates by distance, ``count`` that are nearer to the point than to one another.

        Room that is left goes to the nearest of the others.
        """
        points = self.points[near]
        apart = 1 - points @ points.transpose(0, 2, 1)
        closest = np.full(near.shape, np.inf, dtype=np.float32)
        taken = np.zeros(near.shape, dtype=bool)
        for j in range(near.shape[1]):
            take = (near[:, j] >= 0) & (far[:, j] < closest[:, j]) & (taken.sum(axis=1) < count)
            taken[:, j] = take
            closest = np.where(take[:, None], np.minimum(closest, apart[:, :, j]), closest)
        rank = np.where(near < 0, 3e9, np.where(taken, 0, 1e9)) + np.arange(near.shape[1])
        order = np.argsort(rank, axis=1)[:, :count]
        return np.take_along_axis(near, order, 1)

    def link(self, new: np.ndarray, near: np.ndarray, far: np.ndarray, level: int) -> None:
        table = self.levels[level]
        count = min(self.degree, near.shape[1])
        chosen = self.spread(near, far, count)
        table[new, :count] = chosen
        source, target = np.repeat(new, count), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owners, first, number = np.unique(target, return_index=True, return_counts=True)
        if not len(owners):
            return
        wide = np.full((len(owners), table.shape[1] + number.max()), -1)
        wide[:, : table.shape[1]] = table[owners]
        row = np.repeat(np.arange(len(owners)), number)
        wide[row, table.shape[1] + np.arange(len(source)) - np.repeat(first, number)] = source
        away = 1 - np.einsum("bmd,bd->bm", self.points[wide], self.points[owners])
        away = np.where(wide < 0, np.inf, away)
        order = np.argsort(away, axis=1, kind="stable")
        wide, away = np.take_along_axis(wide, order, 1), np.take_along_axis(away, order, 1)
        over = (wide >= 0).sum(axis=1) > table.shape[1]
        kept = wide[:, : table.shape[1]].copy()
        if over.any():
            kept[over] = self.spread(wide[over], away[over], table.shape[1])
        table[owners] = kept

    def build(self, beam: int = BUILD_BEAM, seed: int = 7) -> Graph:
        count = len(self.points)
        draw = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - draw.random(count)) / np.log(self.degree)).astype(int)
        for level in range(height.max() + 1):
            self.levels.append(np.full((count + 1, self.degree * (2 if level == 0 else 1)), -1))
        # The tallest node comes first, so that every level has an entry from the start.
        order = np.concatenate([[height.argmax()], np.delete(np.arange(count), height.argmax())])
        self.entry, at = int(order[0]), 1
        while at < count:
            batch = order[at : at + max(1, min(BATCH, at // 4))]
            found = []
            for level in range(len(self.levels)):
                new = batch[height[batch] >= level]
                if len(new):
                    points = self.points[new]
                    found.append((new, *self.walk(points, self.descend(points, level), beam, level), level))
            # Linked only now: a node that is new above would lead nowhere below.
            for new, near, far, level in found:
                self.link(new, near, far, level)
            at += len(batch)
        return self

    def nearest(self, queries: np.ndarray, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(nodes or -1, inner products in double precision) of the nearest nodes found."""
        nodes, scores = [], []
        beam = min(beam, len(self.points))
        for start in range(0, len(queries), BATCH):
            part = queries[start : start + BATCH]
            points = self.asked(part)
            found, _ = self.walk(points, self.descend(points, 0), beam, 0)
            nodes.append(found)
            scores.append(products(part, self.vectors[found]))
        return np.concatenate(nodes), np.concatenate(scores)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products [b, m], added from the first component to the last for every pair alike."""
    total = np.zeros(vectors.shape[:2])
    for d in range(queries.shape[1]):
        total += queries[:, d, None] * vectors[:, :, d]
    return total


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vector in doubles) of the rows that take part, repeated rows once."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    good = F.forall("vector", real) & F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def indexed(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[DataFrame, int]:
    """The graphs, one row per (dim, shard), and the number of shards."""
    place = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1)
    nodes = cut_lineage(few.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.select("vector", "ids", F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"))

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(np.stack(shard["vector"].to_numpy()), degree).build(beam)
        ids = shard["ids"].tolist()
        return pd.DataFrame(
            {
                "dim": [shard["dim"].iloc[0]], "shard": [shard["shard"].iloc[0]], "vectors": [graph.vectors.ravel()],
                "ids": [np.concatenate(ids)], "copies": [np.array([len(i) for i in ids], dtype=np.int32)],
                "entry": [graph.entry], "neighbours": [[level[:-1].ravel().astype(np.int32) for level in graph.levels]],
            }
        )

    schema = "dim int, shard int, vectors array<double>, ids array<bigint>, copies array<int>, entry int, neighbours array<array<int>>"
    return cut_lineage(dealt.groupBy("dim", "shard").applyInPandas(build, schema)), shards


def _restored(row, degree: int) -> tuple[Graph, list[np.ndarray]]:
    graph = Graph(np.asarray(row.vectors).reshape(-1, row.dim), degree)
    for flat in row.neighbours:
        level = np.asarray(flat).reshape(len(graph.points), -1)
        graph.levels.append(np.concatenate([level, np.full((1, level.shape[1]), -1)]))
    graph.entry = int(row.entry)
    return graph, np.split(np.asarray(row.ids), np.cumsum(row.copies)[:-1])


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, float]]:
    """The k best other ids, an id under several vectors by its nearest one."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    chosen = order[first]
    return [(int(ids[i]), float(scores[i])) for i in chosen[ids[chosen] != own][:k]]


def searched(
    vectors: DataFrame,
    queries: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 20,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    build_beam: int = BUILD_BEAM,
    search_beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``queries`` names."""
    index, shards = indexed(usable(vectors, vec_id, vector), k, shard_rows, degree, build_beam)
    asked = usable(vectors.where(queries), vec_id, vector).distinct()
    parts = max(1, -(-asked.count() // QUERIES_PER_PART))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = asked.select(
        F.size("vector").alias("dim"), F.explode(every).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.col("id").alias("query_id"), F.col("vector").alias("query"),
    )
    graphs = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"))
    together = graphs.unionByName(asked, allowMissingColumns=True).repartition("dim", "shard", "part")
    together = together.sortWithinPartitions("dim", "shard", "part", "kind", "query_id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, owned, here = None, [], None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            change = (batch[["dim", "shard", "part", "kind"]].diff() != 0).any(axis=1).cumsum()
            for _, rows in batch.groupby(change.to_numpy(), sort=False):
                head = rows.iloc[0]
                if head["kind"] == 0:
                    graph, owned = _restored(head, degree)
                    here = (head["dim"], head["shard"])
                elif graph is not None and here == (head["dim"], head["shard"]):
                    asked, names = np.stack(rows["query"].to_numpy()), rows["query_id"].to_numpy()
                    beam = max(search_beam, k + 1)
                    while len(names):
                        nodes, scores = graph.nearest(asked, beam)
                        few = np.zeros(len(names), dtype=bool)
                        for at, own in enumerate(names.tolist()):
                            real = nodes[at] >= 0
                            ids = [owned[n] for n in nodes[at][real]]
                            flat = np.repeat(scores[at][real], [len(i) for i in ids])
                            best = _best(np.concatenate(ids), flat, own, k)
                            # Where ids repeat under many vectors, look further until k ids are found.
                            few[at] = len(best) < k and beam < len(graph.vectors)
                            if not few[at]:
                                out += [(own, i, s) for i, s in best]
                        asked, names, beam = asked[few], names[few], min(2 * beam, len(graph.vectors))
            if out:
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = together.mapInPandas(each, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
