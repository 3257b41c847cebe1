"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into four segments of 16. If two fingerprints differ
in at most 3 bits, then, whichever bits these are, one segment is equal and of the
other three at least two differ in at most one bit. So for each segment i taken as it
is and each of the two next segments j decoded to nearby codewords, (i, its value, a
codeword of j) is a key: each fingerprint gives 8 keys under its nearest codewords and
about 42 under all within 4 bits, and a fingerprint at most 3 bits away has one of the
8 among its own 42. Fingerprints that meet under a key are compared bit by bit.

Only different fingerprints are compared; copies share one. What a key yields are the
links of a spanning forest of the fingerprints that meet there, never all pairs. A key
that gathers more than ``BLOCK`` fingerprints is cut into blocks, and pairs of blocks
are compared in tasks of their own. Links become components in Spark.

Defined results: a null text counts as empty; texts with fewer words than a shingle
have the whole sequence as their one shingle; texts without words have fingerprint 0
and are linked like any other; repeated rows are linked at distance 0; the component id
is the least id reached, null only where all its ids are null; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

from .components import components
from .golay import BITS, near
from .similar import Sketch, near_links, node_of
from .similar import text_hash as _text_hash
from .words import lower_words

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = 4
BLOCK = 4096
#: For the rows that stay.
SIMILARITY = 0.8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits set in more than half of the shingles' XXH64 values, repeats counted."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    step = 1 << 15
    for start in range(0, total, step):
        part = words[start : start + step + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        values = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), dtype="<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(ones * 2 > total))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id``, ``text_hash``, ``fp``): one row per row, the fingerprint as a signed integer."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "text_hash": batch["text_hash"], "fp": made.view(np.int64)})

    rows = docs.select(F.col(doc_id).alias("id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInPandas(each, f"id {dict(docs.dtypes)[doc_id]}, text_hash bigint, fp bigint")


def keys_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, nearest) of each key of each fingerprint."""
    starts, indices, nearest = near()
    unsigned = values.view(np.uint64)
    segments = [(unsigned >> np.uint64(BITS * s)).astype(np.int64) & 0xFFFF for s in range(SEGMENTS)]
    out: list[tuple[np.ndarray, ...]] = []
    for plain in range(SEGMENTS):
        for turn, step in enumerate((1, 2)):
            coded = segments[(plain + step) % SEGMENTS]
            count = starts[coded + 1] - starts[coded]
            row = np.repeat(np.arange(len(values)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[coded], count)
            key = (np.int64(plain * 2 + turn) << 28) | (segments[plain][row] << 12) | indices[at]
            out.append((row, key, nearest[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _forest(probes: np.ndarray, members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of probes and members at most ``distance`` bits apart.

    Walks outwards from each fingerprint not yet reached; every comparison is made once
    for each side, and as many links come out as fingerprints are reached.
    """
    links: list[tuple[int, int]] = []
    left_p, left_m = np.ones(len(probes), dtype=bool), np.ones(len(members), dtype=bool)
    for seed in range(len(probes)):
        if not left_p[seed]:
            continue
        left_p[seed] = False
        stack = [(True, seed)]
        while stack:
            is_probe, at = stack.pop()
            mine, others, left = (probes, members, left_m) if is_probe else (members, probes, left_p)
            rest = np.flatnonzero(left)
            hit = rest[np.bitwise_count(others[rest] ^ mine[at]) <= distance]
            left[hit] = False
            for h in hit.tolist():
                if others[h] != mine[at]:
                    links.append((int(mine[at]), int(others[h])))
                stack.append((not is_probe, h))
    return links


def _compared(distance: int):
    """Rows sorted by (key, a, b) in; the links found under each of these out."""

    def links_of(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["key", "a", "b"]].to_numpy()
        edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = np.concatenate(([0], edges, [len(rows)]))
        fp, probe, member = (rows[c].to_numpy() for c in ("fp", "probe", "member"))
        found: list[tuple[int, int]] = []
        for at in np.flatnonzero(np.diff(bounds) > 1):
            part = slice(bounds[at], bounds[at + 1])
            p, m = fp[part][probe[part]], fp[part][member[part]]
            if len(p):
                found += _forest(p.view(np.uint64), m.view(np.uint64), distance)
        pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[["key", "a", "b"]].iloc[-1]
            open_ = (batch["key"] == last["key"]) & (batch["a"] == last["a"]) & (batch["b"] == last["b"])
            if not open_.all():
                yield links_of(pd.concat([*kept, batch[~open_]]))
                kept = []
            elif kept and tuple(kept[-1][["key", "a", "b"]].iloc[-1]) != tuple(last):
                yield links_of(pd.concat(kept))
                kept = []
            kept.append(batch[open_])
        if kept:
            yield links_of(pd.concat(kept))

    return each


def links(different: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(x, y): links that join what ``distance`` bits or fewer join; ``different`` has ``fp``."""
    if distance > DISTANCE:
        raise ValueError(f"the keys are made for at most {DISTANCE} bits")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(dtype=np.int64)
            for start in range(0, len(values), 4096):
                part = values[start : start + 4096]
                row, key, nearest = keys_of(part)
                yield pd.DataFrame({"key": key, "fp": part[row], "nearest": nearest})

    prints = different.select("fp")
    keyed = prints.mapInPandas(each, "key bigint, fp bigint, nearest boolean")
    # A key cannot gather more than its plain segment does. Keys are counted only where that
    # is many; there are at most 4 x 65536 segment values, so these may go to every task.
    segment = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", BITS * i).bitwiseAND(0xFFFF).alias("value")) for i in range(SEGMENTS)]
    full = prints.select("fp", F.inline(F.array(*segment))).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(cut_lineage(full.where(F.col("n") > block).select("i", "value")))
    crowded = prints.select("fp", F.inline(F.array(*segment))).join(full, ["i", "value"], "left_semi").select("fp").distinct()
    counted = crowded.mapInPandas(each, "key bigint, fp bigint, nearest boolean")
    here = (F.shiftright("key", 29) == F.col("i")) & (F.shiftright("key", 12).bitwiseAND(0xFFFF) == F.col("value"))
    counted = counted.join(full, here, "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(counted.where(F.col("n") > block))
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = keyed.join(hot.select("key", parts.alias("parts")), "key", "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("nearest").alias("probe"), F.lit(True).alias("member")))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    as_member = F.transform(others, lambda i: F.struct(i.alias("a"), own.alias("b"), F.lit(False).alias("probe"), F.lit(True).alias("member")))
    as_probe = F.transform(others, lambda i: F.struct(own.alias("a"), i.alias("b"), F.lit(True).alias("probe"), F.lit(False).alias("member")))
    cells = F.when(F.col("parts").isNull(), whole).when(F.col("nearest"), F.concat(as_member, as_probe)).otherwise(as_member)
    rows = rows.select("key", "fp", F.explode(cells).alias("cell")).select("key", "fp", "cell.*")
    rows = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return rows.mapInPandas(_compared(distance), "x bigint, y bigint").distinct()


def linked(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(id, ``text_hash``, ``fp``, ``root``, ``component_id``, ``component_size``, ``first``) per input row.

    ``first`` marks the row of the component that stays: the least id and, where rows
    repeat it, the least text hash.
    """
    made = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    different = cut_lineage(made.groupBy("fp").agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("n")))
    roots = components(links(different, distance), "x", "y").withColumnRenamed("node", "fp")
    classes = different.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = classes.groupBy("root").agg(F.min("low").alias("least"), F.sum("n").alias("component_size"))
    named = cut_lineage(classes.select("fp", "root").join(lows, "root").select("fp", "root", "least", "component_size"))
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return made.join(named, "fp").select(
        F.col("id").alias(doc_id), "text_hash", "fp", "root", F.col("least.id").alias("component_id"), "component_size",
        first.alias("first"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that stay, with their own columns: one of each group.

    Candidates are first what Golay keys link at three bits, with the fingerprints of
    ``linked``, then what prefix filtering of shingle sets adds (``near_links``): at
    ``similarity`` most pairs differ in more bits than the keys reach, and by the sets none is
    missed. Every pair of both is held against ``similarity`` on its whole sets of shingles, so
    that what only the fingerprints link stays. The row with the least id stays. Only ids and
    text hashes of the rows that stay meet the texts again, on a key made of both, which no
    group of copies shares.
    """
    place = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), _text_hash(text).alias("text_hash"))
    rows = cut_lineage(docs.select(node_of(doc_id, text).alias("node"), place.alias("place")).distinct())
    near = near_links(docs, doc_id, text, similarity, sketch=Sketch(fingerprint, links))
    roots = components(near, "u", "v").withColumnRenamed("root", "group")
    groups = rows.join(roots, "node", "left").select("place", "node", F.coalesce("group", "node").alias("group"))
    kept = groups.groupBy("group").agg(F.min_by("node", "place").alias("_y_key"), F.min("place")["id"].alias("_y_id"))
    kept = cut_lineage(kept.select("_y_key", "_y_id"))
    wide = docs.withColumn("_x_key", node_of(doc_id, text))
    same = (wide["_x_key"] == kept["_y_key"]) & wide[doc_id].eqNullSafe(kept["_y_id"])
    wide = wide.join(kept, same, "left_semi")
    again = F.row_number().over(Window.partitionBy("_x_key").orderBy("_x_key"))
    return wide.withColumn("_x_again", again).where("_x_again = 1").select(*docs.columns)
