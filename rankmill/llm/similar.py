"""Texts whose sets of word shingles agree to a given Jaccard similarity, found by prefix filtering.

Put the shingles of each set in one order that holds for all. Two sets of similarity t or
more share a shingle among the first n - ceil(t * n) + 1 of each, n being the size of the
set: these are its keys, and no pair is missed. The order puts what a bounded sample of
texts repeats last, most repeated at the very end, so that common passages seldom are keys;
which order it is changes the work and not the result.

Equal sets are one node. Sets that meet under a key are held against their sizes and
against the parities of their shingles in ``PARITIES`` cells, more for sets of more shingles:
sets of n and m shingles and similarity t differ in at most (n + m) (1 - t) / (1 + t)
shingles, and so in at most as many parities. What passes is a candidate. Under each key only
a forest of candidates is taken, and each pair is verified once on the whole sets. A link
that holds joins two labels, and nodes of one label are never compared again. A link that
fails reaches nothing: the tree that gave it is walked again without it, ``ROUNDS`` times by
forests and at last by all candidates between different labels that are left there, so that
no pair is missed; what is in no tree with such a link is not moved again, as sets of
different trees cannot agree. Keys under which the very same sets meet (two near copies share
a fifth of their shingles) count as one. Sets move only for pairs that are verified.

Candidates may come from another sketch first (``Sketch``); what it links and the sets
confirm is joined before the keys are walked. Keys are counted before they are dealt, and
one that gathers more than ``BLOCK`` sets is cut into pairs of blocks. Work grows with the
square of a group only where many texts meet under a key, pass the parities and yet fail.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, release

from .components import components
from .words import lower_words

SHINGLE = 5
PARITIES = 512
MOST_PARITIES = 4096
BLOCK = 2048
#: Rounds of forests before all candidates left are taken.
ROUNDS = 3
#: Names of texts, of 8 bytes each, that are sent to all tasks, at most; more are joined.
SENT = 200_000
#: Texts and shingles that the order is learned from, at most.
SAMPLE = 20_000
COMMON = 1_000_000
SLACK = 1e-9
#: What names a group of sets that are compared: a key, a pair of its blocks, a tree found there before (0: none).
CELL = ["key", "a", "b", "root"]


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def node_of(doc_id: str, text: str) -> Column:
    """A row's name: a hash of its id and text."""
    return F.xxhash64(F.col(doc_id), text_hash(text))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes, sorted; short texts have all their words as the one shingle."""
    words = lower_words(text)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), dtype=np.uint64).view(np.int64))


def _cells_for(count: int) -> int:
    """A power of two, ``PARITIES`` or more, at least the count of shingles up to ``MOST_PARITIES``."""
    return min(MOST_PARITIES, max(PARITIES, 1 << (count - 1).bit_length()))


def parities(values: np.ndarray, count: int = PARITIES) -> bytes:
    """Whether a set has an odd number of shingles in each of ``count`` cells."""
    cells = (values.view(np.uint64) >> np.uint64(40)).astype(np.int64) % count
    return np.packbits(np.bincount(cells, minlength=count) & 1).tobytes()


def _folded(bits: bytes, count: int) -> np.ndarray:
    """Parities in ``count`` cells, from those in a multiple of it."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint64).reshape(-1, count // 64), axis=0)


def keys_of(values: np.ndarray, similarity: float, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a set: those not in the sorted ``common`` by hash, then those in it by place."""
    count = len(values) - math.ceil(similarity * len(values) - SLACK) + 1
    if not len(common):
        return values[:count]
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    known = common[at] == values
    rare = values[~known]
    if len(rare) >= count:
        return rare[:count]
    late = values[known][np.argsort(places[at[known]])]
    return np.concatenate([rare, late[: count - len(rare)]])


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, their places in the order) of shingles that a sample of texts repeats."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"key": shingle_set(text, shingle)})

    of = max(1, math.ceil(rows.count() / SAMPLE))
    sample = rows.where(F.pmod("node", F.lit(of)) == 0).mapInPandas(each, "key bigint")
    counts = cut_lineage(sample.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2"))
    total, least = 0, 3
    for n, keys in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("keys")).collect(), reverse=True):
        total += keys
        if total > COMMON:
            least = n + 1
            break
    found = counts.where(F.col("n") >= least).toPandas().sort_values("key")
    keys, n = found["key"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)
    places = np.empty(len(keys), dtype=np.int64)
    places[np.lexsort((keys, n))] = np.arange(len(keys))
    return keys, places


def _forest(count: int, hits: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int, int]]:
    """(seed, from, to): links of a spanning forest, walked outwards from each place not yet reached."""
    links: list[tuple[int, int, int]] = []
    left = np.ones(count, dtype=bool)
    for seed in range(count):
        stack = [seed] if left[seed] else []
        left[seed] = False
        while stack:
            at = stack.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return links
            hit = rest[hits(at, rest)]
            left[hit] = False
            links += [(seed, at, h) for h in hit.tolist()]
            stack.extend(hit.tolist())
    return links


def _apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Most shingles that sets of n and of m can differ in."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + SLACK


def _may_agree(n: np.ndarray, bits: np.ndarray, wide: list[bytes], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Test of one place against others by sizes and parities, true for all that do agree."""
    cells = np.array([len(w) * 8 for w in wide])

    def hits(at: int, rest: np.ndarray) -> np.ndarray:
        most = _apart(n[rest], n[at], similarity)
        held = np.minimum(n[rest], n[at]) >= similarity * np.maximum(n[rest], n[at]) - SLACK
        held &= np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64) <= most
        for k in np.flatnonzero(held & (np.minimum(cells[rest], cells[at]) > 0)).tolist():
            count = int(min(cells[rest[k]], cells[at]))
            held[k] = np.bitwise_count(_folded(wide[rest[k]], count) ^ _folded(wide[at], count)).sum(dtype=np.int64) <= most[k]
        return held

    return hits


def _walked(similarity: float, exhaustive: bool):
    """Rows sorted by ``CELL`` in, links of each such cell out: forests, or all candidates left.

    Rows have node, label, n, bits and wide; those of role 1 are pairs (node, other) that
    this cell has given before and that failed. Trees with a link between labels (``cross``)
    come out whole, named by their seed and with their number of nodes.
    """

    def cell(rows: pd.DataFrame, failed: pd.DataFrame) -> np.ndarray:
        label = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
        counts = np.bincount(label)[label]
        order = np.lexsort((label, -counts))  # what is joined most goes first
        rows, label = rows.iloc[order], label[order]
        node = rows["node"].to_numpy()
        bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(len(rows), -1)
        may = _may_agree(rows["n"].to_numpy(), bits, rows["wide"].tolist(), similarity)
        place = {name: i for i, name in enumerate(node.tolist())}
        not_again: dict[int, list[int]] = {}
        for u, v in zip(failed["node"].tolist(), failed["other"].tolist(), strict=True):
            if u in place and v in place:
                not_again.setdefault(place[u], []).append(place[v])
                not_again.setdefault(place[v], []).append(place[u])

        def hits(at: int, rest: np.ndarray) -> np.ndarray:
            own = label[rest] == label[at]
            found = own.copy()
            other = np.flatnonzero(~own)
            found[other] = may(at, rest[other])
            if at in not_again:
                found[np.isin(rest, not_again[at])] = False
            return found

        if not exhaustive:
            made = _forest(len(node), hits)
        else:
            every = np.arange(len(node))
            made = [(i, i, j) for i in range(len(node)) for j in every[i + 1 :][hits(i, every[i + 1 :])].tolist()]
            made = [(i, i, j) for i, _, j in made if label[i] != label[j]]
        seed, u, v = np.array(made, dtype=np.int64).reshape(-1, 3).T
        cross = label[u] != label[v]
        size = np.bincount(seed, minlength=len(node))[seed] + 1
        found = np.stack([node[seed], size, node[u], node[v], cross.astype(np.int64)], axis=1)
        return found[np.isin(seed, seed[cross])]

    def links_of(rows: pd.DataFrame) -> pd.DataFrame:
        by = rows[CELL].to_numpy()
        edges = np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], edges, [len(rows)]))
        size = np.diff(bounds)
        node, label, n, role = (rows[c].to_numpy() for c in ("node", "label", "n", "role"))
        # Cells of two nodes, by far the most, are tested all at once.
        two = bounds[:-1][size == 2]
        two = two[(role[two + 1] == 0) & (label[two] != label[two + 1])]
        bits = np.frombuffer(b"".join(rows["bits"]), dtype=np.uint64).reshape(-1, PARITIES // 64)
        most = _apart(n[two], n[two + 1], similarity)
        held = np.minimum(n[two], n[two + 1]) >= similarity * np.maximum(n[two], n[two + 1]) - SLACK
        held &= np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64) <= most
        wide = rows["wide"].to_numpy()
        for k in np.flatnonzero(held).tolist():
            left, right = wide[two[k]], wide[two[k] + 1]
            if count := min(len(left), len(right)) * 8:
                held[k] = np.bitwise_count(_folded(left, count) ^ _folded(right, count)).sum(dtype=np.int64) <= most[k]
        place = two[held]
        made = [np.stack([place, node[place], np.full(len(place), 2), node[place], node[place + 1], np.ones(len(place), dtype=np.int64)], axis=1)]
        for at in np.flatnonzero(size > 2):
            low, high = bounds[at], bounds[at + 1]
            nodes = low + int((role[low:high] == 0).sum())
            if (label[low:nodes] == label[low]).all():
                continue
            found = cell(rows.iloc[low:nodes], rows.iloc[nodes:high])
            made.append(np.concatenate([np.full((len(found), 1), low), found], axis=1))
        found = np.concatenate(made)
        return pd.DataFrame({"key": by[found[:, 0], 0], "a": by[found[:, 0], 1], "b": by[found[:, 0], 2], "root": found[:, 1], "size": found[:, 2],
                             "u": found[:, 3:5].min(axis=1), "v": found[:, 3:5].max(axis=1), "cross": found[:, 5] == 1})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            if kept and tuple(kept[-1][CELL].iloc[-1]) != tuple(batch[CELL].iloc[0]):
                yield links_of(pd.concat(kept))
                kept = []
            open_ = (batch[CELL] == batch[CELL].iloc[-1]).all(axis=1).to_numpy()
            if not open_.all():
                yield links_of(pd.concat([*kept, batch[~open_]]))
                kept = []
            kept.append(batch[open_])
        if kept:
            yield links_of(pd.concat(kept))

    return each


def _cells(rows: DataFrame, parts: Column) -> DataFrame:
    """Deal a group's rows to cells (a, b): in every pair of blocks all rows of both."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")
    others = F.sequence(F.lit(0), (parts - 1).cast("int"))
    cells = F.transform(others, lambda i: F.struct(F.least(own, i).alias("a"), F.greatest(own, i).alias("b")))
    return rows.withColumn("_cell", F.explode(cells)).select(*rows.columns, "_cell.a", "_cell.b")


def _sent(names: DataFrame) -> DataFrame:
    """Names to all tasks, where their written count is within ``SENT``."""
    return F.broadcast(names) if names.count() <= SENT else names


def _verified(rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v, agree) of each pair, on the whole sets; ``rows`` has node and text, and the result is written."""

    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle) for t in texts])

    names = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    texts = rows.join(_sent(names), "node", "left_semi").dropDuplicates(["node"])
    made = cut_lineage(texts.select("node", sets("text").alias("set")))
    both = pairs.join(made.select(F.col("node").alias("u"), F.col("set").alias("x")), "u")
    both = both.join(made.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    same = F.size(F.array_intersect("x", "y"))
    found = cut_lineage(both.select("u", "v", (same + SLACK >= similarity * (F.size("x") + F.size("y") - same)).alias("agree")))
    release(names, made)
    return found


def _labels(links: DataFrame) -> DataFrame:
    return components(links, "u", "v").withColumnRenamed("root", "label")


@dataclass(frozen=True)
class Sketch:
    """A fingerprint of a text, and a function that links near fingerprints: (fp) to (x, y)."""

    fingerprint: Callable[[str | None], int]
    links: Callable[[DataFrame], DataFrame]


def _sketched(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """(u, v): each node with the least of its fingerprint, and these where fingerprints link."""
    least = cut_lineage(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    alike = nodes.select("node", "fp").join(least, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    near = sketch.links(least).join(least.select(F.col("fp").alias("x"), F.col("least").alias("p")), "x")
    near = near.join(least.select(F.col("fp").alias("y"), F.col("least").alias("q")), "y")
    return cut_lineage(alike.union(near.select(F.least("p", "q"), F.greatest("p", "q"))).distinct())


def near_links(
    docs: DataFrame, doc_id: str, text: str, similarity: float, shingle: int = SHINGLE, *, block: int = BLOCK,
    sketch: Sketch | None = None,
) -> DataFrame:
    """(u, v): pairs of rows whose sets of ``shingle``-word shingles agree to ``similarity`` or more.

    A row is named by a hash of id and text. The links join all that such pairs join,
    transitively; they are not all pairs.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    rows = docs.select(node_of(doc_id, text).alias("node"), F.col(text).alias("text"))
    common, places = _common(rows, shingle)
    shared = docs.sparkSession.sparkContext.broadcast((common, places))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingle_set(t, shingle) for t in batch["text"]]
            prints = np.array([sketch.fingerprint(t) for t in batch["text"]] if sketch else [0] * len(made), dtype=np.uint64)
            yield pd.DataFrame({
                "node": batch["node"], "sig": [xxhash.xxh3_128_digest(s.tobytes()) for s in made], "n": [len(s) for s in made],
                "bits": [parities(s) for s in made], "keys": [keys_of(s, similarity, *shared.value) for s in made],
                "wide": [parities(s, _cells_for(len(s))) if len(s) > PARITIES else b"" for s in made], "fp": prints.view(np.int64)})

    made = cut_lineage(rows.mapInPandas(each, "node bigint, sig binary, n bigint, bits binary, keys array<bigint>, wide binary, fp bigint"))
    lows = made.groupBy("sig").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    lows = cut_lineage(lows.select("sig", "low"))
    same = made.select("node", "sig").join(lows, "sig").where("node <> low").select(F.least("node", "low").alias("u"), F.greatest("node", "low").alias("v"))
    one = made.join(lows.select("sig", F.col("low").alias("node")), ["sig", "node"], "left_semi").dropDuplicates(["node"])
    nodes = cut_lineage(made.join(lows, "sig", "left_anti").unionByName(one))
    same = cut_lineage(same)
    release(made, lows)

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # Node names are hashes and meet a key once, so two sums by exclusive or name what meets.
    together = [F.count(F.lit(1)).alias("met"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")]
    met = cut_lineage(keyed.groupBy("key").agg(*together).where("met > 1").groupBy("met", "x", "y").agg(F.min("key").alias("key")).select("key", "met"))

    def filled(found: DataFrame, labels: DataFrame | None) -> DataFrame:
        found = found.join(nodes.select("node", "n", "bits", "wide"), "node")
        found = found.withColumn("label", F.col("node")) if labels is None else found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        return found.select(*CELL, F.lit(0).alias("role"), "node", F.lit(0).cast("bigint").alias("other"), "label", "n", "bits", "wide")

    def walked(found: DataFrame, exhaustive: bool = False) -> DataFrame:
        found = found.repartition(*CELL).sortWithinPartitions(*CELL, "role", "node")
        schema = "key bigint, a int, b int, root bigint, size bigint, u bigint, v bigint, cross boolean"
        return cut_lineage(found.mapInPandas(_walked(similarity, exhaustive), schema))

    verified = _verified(rows, _sketched(nodes, sketch), shingle, similarity) if sketch else None
    links = same if verified is None else cut_lineage(same.union(verified.where("agree").select("u", "v")))
    labels = None if verified is None else _labels(links)
    dealt = _cells(keyed.join(met, "key"), F.ceil(F.col("met") / F.lit(block))).withColumn("root", F.lit(0).cast("bigint"))
    given = walked(filled(dealt, labels))
    tried = given
    for turn in range(ROUNDS + 1):
        pairs = given.where("cross").select("u", "v").distinct()
        if verified is not None:
            pairs = pairs.join(verified, ["u", "v"], "left_anti")
        now = _verified(rows, cut_lineage(pairs), shingle, similarity)
        done, verified = verified, now if verified is None else cut_lineage(verified.union(now))
        before, links = links, cut_lineage(links.union(now.where("agree").select("u", "v")))
        release(*(x for x in (done, now, before) if x is not None and x is not verified))
        if turn == ROUNDS:
            break
        # The nodes of trees that have just given a link that fails, with all such links of theirs. Two nodes have no other.
        wrong = verified.where("not agree").select("u", "v")
        failing = given.where("cross and size > 2").join(wrong, ["u", "v"], "left_semi").select(*CELL).distinct()
        members = given.join(failing, CELL, "left_semi").select(*CELL, F.explode(F.array("u", "v")).alias("node")).distinct()
        members = cut_lineage(members)
        # Trees of the same nodes under several keys are one.
        trees = members.groupBy(*CELL).agg(*together)
        trees = trees.groupBy("met", "x", "y").agg(F.min(F.struct(*CELL)).alias("cell")).select("cell.*")
        every, members = members, cut_lineage(members.join(trees, CELL, "left_semi"))
        release(every)
        if members.isEmpty():
            break
        labels = _labels(links)
        old = tried.where("cross").select("key", "a", "b", "u", "v").join(wrong, ["u", "v"], "left_semi")
        old = old.join(members.withColumnRenamed("node", "u"), ["key", "a", "b", "u"])
        old = old.select(*CELL, F.lit(1).alias("role"), F.col("u").alias("node"), F.col("v").alias("other"), F.lit(0).cast("bigint").alias("label"),
                         F.lit(0).cast("bigint").alias("n"), F.lit(bytes(PARITIES // 8)).alias("bits"), F.lit(b"").alias("wide"))
        given = walked(filled(members, labels).unionByName(old), turn == ROUNDS - 1)
        before, tried = tried, cut_lineage(tried.unionByName(given))
        release(before)
    release(nodes, met)
    return links.distinct()
