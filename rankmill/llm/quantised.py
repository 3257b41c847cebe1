"""Near copies of embeddings by product quantisation: inverted lists, residual codes, exact rerank.

The index is fitted on a bounded sample of vectors: ``lists`` coarse centroids, and for the
residuals (vector less centroid) a codebook for each of ``SUBSPACES`` stretches of components.
Every vector is then indexed: it lies in the list of its nearest centroid, as one code a
subspace, together with the exact distance between residual and code.

A vector searches its own list and, of the others, all whose border is at most ``reach``
away, where the border of list c is the plane midway between its centroid and the vector's
own. A partner at distance r in another list lies beyond that plane, so that a reach of r
would miss none; the step to the partner has, in the direction across the plane, a share of
about 1 / sqrt(dimensions) of its length, and the default reach is ``MARGIN`` times that.
Within a list distances come from a table for each searching vector, one entry a subspace
and code (asymmetric: only the other side is quantised). The residual's distance to its code
bounds the error, so that no partner is passed over here; what is left is compared on the
original vectors, in double precision.

Equal vectors of one label are one class. Lists of many classes are cut into blocks past
which the searching vectors stream. A pair found from both sides counts on one. Pairs stay
in the task: what comes out is, for each class and block, the number of vectors linked and a
link to the least class it reaches there, from which components are made.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and vectors with null label, link with nothing; vectors of different lengths
never link; each row counts as a vector, repeated rows too; the component id is the least id
reached, null only where all its ids are null; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

from .cells import dealt, roots_of, streamed
from .components import components

SIMILARITY = 0.93
#: Vectors that the index is fitted on, and components of all of them, at most.
SAMPLE = 16_384
SAMPLE_COMPONENTS = 1 << 23
#: Components that the index looks at; the rerank looks at all.
DIMENSIONS = 1024
MOST_LISTS = 1024
SUBSPACES = 8
CODEWORDS = 256
ROUNDS = 8
MARGIN = 3.0
BLOCK = 1024
PROBES = 2048
SLACK = 1e-4


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def _centroids(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a random choice of rows."""
    rng = np.random.default_rng(seed)
    found = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(rows, found).argmin(axis=1)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, rows)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; rows hold finite numbers and are not zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    codebooks: tuple[np.ndarray, ...]

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def seen(self, units: np.ndarray) -> np.ndarray:
        """The components that the index looks at."""
        some = units[:, : self.dimensions]
        return np.pad(some, ((0, 0), (0, self.dimensions - some.shape[1])))

    def stretches(self) -> list[slice]:
        ends = np.cumsum([book.shape[1] for book in self.codebooks])
        return [slice(int(e - b.shape[1]), int(e)) for e, b in zip(ends, self.codebooks, strict=True)]

    def lists(self, seen: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """(nearest list, further lists to search) of each vector."""
        squares = _squares(seen, self.centroids)
        own = squares.argmin(axis=1)
        apart = np.sqrt(_squares(self.centroids, self.centroids))[own]
        at = np.arange(len(seen))
        with np.errstate(divide="ignore", invalid="ignore"):
            border = (squares - squares[at, own][:, None]) / (2 * apart)
        near = ~(border > reach)  # centroids that coincide are searched
        near[at, own] = False
        return own, [np.flatnonzero(row) for row in near]

    def codes(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, distances of the residuals to what the codes stand for)."""
        codes = np.empty((len(residuals), len(self.codebooks)), dtype=np.uint8)
        error = np.zeros(len(residuals))
        for m, (book, part) in enumerate(zip(self.codebooks, self.stretches(), strict=True)):
            codes[:, m] = _squares(residuals[:, part], book).argmin(axis=1)
            error += ((residuals[:, part] - book[codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def tables(self, residuals: np.ndarray) -> list[np.ndarray]:
        """For each subspace, squared distances of residuals to its codewords."""
        return [_squares(residuals[:, part], book).astype(np.float32) for book, part in zip(self.codebooks, self.stretches(), strict=True)]


def fitted(vectors: list[np.ndarray], lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
    """The index of a sample of vectors, which may differ in length."""
    if not vectors:
        return Index(np.zeros((1, 1)), (np.zeros((1, 1)),))
    width = min(DIMENSIONS, max(len(v) for v in vectors))
    units = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        part = _units(np.asarray(v, dtype=np.float64)[None, :])[0, :width]
        units[i, : len(part)] = part
    centroids = _centroids(units, lists, 0)
    residuals = units - centroids[_squares(units, centroids).argmin(axis=1)]
    parts = np.array_split(np.arange(width), min(subspaces, width))
    books = tuple(_centroids(residuals[:, p], min(codewords, 256), 1 + m) for m, p in enumerate(parts))
    return Index(centroids, books)


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each different vector of a label: ``node``, ``space``, ``vector``, ``low``, ``weight``."""
    made = rows.groupBy("space", "vector").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))
    return cut_lineage(made.withColumn("node", F.monotonically_increasing_id()))


def _sampled(classes: DataFrame) -> tuple[int, list[np.ndarray]]:
    """(number of classes, bounded sample of their vectors by smallest hash)."""
    count, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    bound = max(1, min(SAMPLE, SAMPLE_COMPONENTS // (longest or 1)))
    chosen = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(bound).toPandas()
    return count, [np.asarray(v, dtype=np.float64) for v in chosen["vector"]]


def _indexed(classes: DataFrame, index: Index, reach: float) -> DataFrame:
    """The inverted lists: each class with its list, the further lists to search, codes and their error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].str.len()):
                for at in range(0, len(part), 1024):
                    some = part.iloc[at : at + 1024]
                    vectors = np.stack(some["vector"].to_numpy()).astype(np.float64)
                    seen = index.seen(_units(vectors))
                    own, further = index.lists(seen, reach)
                    codes, error = index.codes(seen - index.centroids[own])
                    yield pd.DataFrame({
                        "node": some["node"], "space": some["space"], "weight": some["weight"], "list": own, "further": further,
                        "codes": [c.tobytes() for c in codes], "error": error, "vector": [v.tobytes() for v in vectors]})

    rows = classes.select("node", "space", "weight", "vector")
    made = rows.mapInPandas(each, "node bigint, space string, weight bigint, list int, further array<int>, codes binary, error double, vector binary")
    return cut_lineage(made)


def _searched(index: Index, similarity: float):
    """What the members of a block link with, among themselves and with vectors that stream past."""
    radius = math.sqrt(max(0.0, 2 - 2 * similarity))

    def opened(members: pd.DataFrame):
        own_list = int(members["list"].iloc[0])
        units = _units(np.stack([np.frombuffer(v) for v in members["vector"]]))
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in members["codes"]])
        bound = ((radius + members["error"].to_numpy() + SLACK) ** 2).astype(np.float32)
        node, weight = members["node"].to_numpy(), members["weight"].to_numpy()
        searches = [set(f) for f in members["further"]]

        def found(others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(other, member) of the pairs that are similar enough."""
            tables = index.tables(index.seen(others) - index.centroids[own_list])
            squares = tables[0][:, codes[:, 0]]
            for m in range(1, len(tables)):
                squares += tables[m][:, codes[:, m]]
            other, member = np.nonzero(squares <= bound)
            held = np.empty(len(other), dtype=bool)
            for at in range(0, len(other), step := max(1, (1 << 22) // others.shape[1])):
                o, m = other[at : at + step], member[at : at + step]
                held[at : at + step] = np.einsum("ij,ij->i", others[o], units[m]) >= similarity
            return other[held], member[held]

        def summed(nodes: np.ndarray, weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame | None:
            if not len(left):
                return None
            links = np.bincount(left, weights[right], len(nodes)) + np.bincount(right, weights[left], len(nodes))
            order = np.argsort(nodes)
            place = np.empty(len(nodes), dtype=np.int64)
            place[order] = np.arange(len(nodes))
            root = nodes[order[roots_of(len(nodes), place[left], place[right])[place]]]
            some = links > 0
            return pd.DataFrame({"node": nodes[some], "links": links[some].astype(np.int64), "root": root[some]})

        def probe(rows: pd.DataFrame) -> pd.DataFrame | None:
            made = []
            for at in range(0, len(rows), PROBES):
                part = rows.iloc[at : at + PROBES]
                o, m = found(_units(np.stack([np.frombuffer(v) for v in part["vector"]])))
                lists = part["from"].to_numpy()[o]
                # A pair that is found from both sides counts in the smaller list.
                twice = np.array([a < own_list and a in searches[k] for a, k in zip(lists.tolist(), m.tolist(), strict=True)], dtype=bool)
                o, m = o[~twice], m[~twice]
                names, place = np.unique(np.concatenate([part["node"].to_numpy()[o], node[m]]), return_inverse=True)
                weights = np.zeros(len(names), dtype=np.int64)
                weights[place] = np.concatenate([part["weight"].to_numpy()[o], weight[m]])
                made.append(summed(names, weights, place[: len(o)], place[len(o) :]))
            made = [x for x in made if x is not None]
            return pd.concat(made) if made else None

        o, m = found(units)
        return summed(node, weight, o[o < m], m[o < m]), probe

    return opened


def linked(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", *,
    similarity: float = SIMILARITY, lists: int | None = None, margin: float = MARGIN, block: int = BLOCK,
) -> DataFrame:
    """(id, ``n_links``, ``component_id``, ``kept``) per row: vectors of one label at cosine ``similarity`` or more.

    ``margin`` sets how far beyond a list's border partners are looked for, in multiples of
    what a step of the greatest permitted length has in one direction on average; sqrt(dimensions)
    or more looks everywhere a partner can be. ``kept`` marks the rows with the least id of their component.
    """
    if not -1 < similarity <= 1:
        raise ValueError("a cosine is above -1 and at most 1")
    space = F.concat_ws(":", F.size(embedding).cast("string"), F.col(label).cast("string"))
    usable = _usable(F.col(embedding), F.col(label))
    rows = vectors.select(F.col(vec_id).alias("id"), F.when(usable, space).alias("space"), F.when(usable, F.col(embedding)).alias("vector"))
    classes = _classes(rows.where("space is not null"))
    count, sample = _sampled(classes)
    index = fitted(sample, lists or max(1, min(MOST_LISTS, int(math.sqrt(count) / 4))))
    reach = math.sqrt(max(0.0, 2 - 2 * similarity)) * min(1.0, margin / math.sqrt(index.dimensions))
    indexed = _indexed(classes, index, reach)
    own = indexed.select("space", "list", F.lit(0).alias("role"), F.col("list").alias("from"), "further", "node", "weight", "vector", "codes", "error")
    other = indexed.select("space", F.explode("further").alias("list"), F.lit(1).alias("role"), F.col("list").alias("from"),
                           F.lit(None).cast("array<int>").alias("further"), "node", "weight", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    parts = indexed.groupBy("space", "list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")).where("parts > 1")
    cells = dealt(own.unionByName(other), ["space", "list"], "node", cut_lineage(parts))
    made = cut_lineage(cells.mapInPandas(streamed(("space", "list", "part"), _searched(index, similarity)), "node bigint, links bigint, root bigint"))
    links = made.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(made.select("node", "root"), "node", "root")
    named = classes.join(roots, "node", "left").select("node", "space", "vector", "low", "weight", F.coalesce("root", "node").alias("root"))
    named = cut_lineage(named.join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "root").select("space", "vector", "links", "component_id")
    seen = rows.where("space is not null").join(named, ["space", "vector"]).select("id", "links", "component_id")
    rest = rows.where("space is null").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component_id"))
    return seen.unionByName(rest).select(
        F.col("id").alias(vec_id), F.col("links").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
