"""Members held in small blocks, and probes streamed past them.

A cell is a key and the number of a block of its members. Members of a cell come first
(role 0) and are held; there are few of them, as a key with many is cut into blocks.
Probes (role 1) follow and are read in Arrow batches, any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Opened = tuple[pd.DataFrame | None, Callable[[pd.DataFrame], pd.DataFrame | None]]


def streamed(by: Sequence[str], opened: Callable[[pd.DataFrame], Opened]):
    """Function for ``mapInPandas`` over rows sorted by (*by, role).

    ``opened`` takes the members of a cell and returns what they yield among themselves
    and a function of the probes. Cells without members yield nothing. Keys are not null.
    """
    by = list(by)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        held: list[pd.DataFrame] = []
        probe: Callable[[pd.DataFrame], pd.DataFrame | None] | None = None

        def start() -> pd.DataFrame | None:
            nonlocal probe
            own, probe = opened(pd.concat(held, ignore_index=True))
            held.clear()
            return own

        for batch in batches:
            if not len(batch):
                continue
            edges = np.flatnonzero((batch[by] != batch[by].shift()).any(axis=1).to_numpy()[1:]) + 1
            bounds = [0, *edges.tolist(), len(batch)]
            for low, high in zip(bounds, bounds[1:], strict=False):
                part = batch.iloc[low:high]
                now = tuple(part[by].iloc[0])
                if now != key:
                    if held and (made := start()) is not None:
                        yield made
                    key, probe = now, None
                split = int((part["role"].to_numpy() == 0).sum())
                if split:
                    held.append(part.iloc[:split])
                if split == len(part):
                    continue
                if held and (made := start()) is not None:
                    yield made
                if probe is not None and (made := probe(part.iloc[split:])) is not None:
                    yield made
        if held and (made := start()) is not None:
            yield made

    return each


def dealt(rows: DataFrame, by: Sequence[str], name: str, parts: DataFrame) -> DataFrame:
    """``rows`` with their ``part``, dealt to tasks and sorted for ``streamed((*by, "part"), ...)``.

    ``parts`` has the keys that are cut into two parts or more, and ``parts``. A member lies
    in the part that the hash of ``name`` gives and passes by the later parts as a probe, so
    that any two members of a key meet once; a probe passes by all parts.
    """
    own = F.pmod(F.xxhash64(name), F.col("parts")).cast("int")
    there = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(i.alias("part"), F.when(i == own, F.col("role")).otherwise(1).alias("role")),
    )
    there = F.when(F.col("role") == 0, F.filter(there, lambda to: to["part"] >= own)).otherwise(there)
    alone = F.array(F.struct(F.lit(0).alias("part"), F.col("role")))
    others = [c for c in rows.columns if c != "role"]
    sent = rows.join(parts.select(*by, "parts"), list(by), "left")
    sent = sent.select(*others, F.explode(F.when(F.col("parts").isNull(), alone).otherwise(there)).alias("_to"))
    sent = sent.select(*others, "_to.part", "_to.role")
    return sent.repartition(*by, "part").sortWithinPartitions(*by, "part", "role")


def roots_of(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each of ``count`` places reaches over the pairs (left, right)."""
    root = np.arange(count)
    while True:
        least = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        root = root[root]
        if (root == before).all():
            return root
