"""Best-fit packing of documents into sequences of several permitted lengths.

A sequence of length c costs ``overhead + c + attention * c**2``. Items (documents, or
pieces of at most the greatest length) are packed by falling size: each goes to the open
bin with the least room that holds it; if none does, a bin is opened of the size that
costs least for each unit it may still be given. All permitted lengths take part: beside
this rule, each length is tried as the size to open by preference, and the plan that is
cheapest in the end is taken. In the end every bin shrinks to the least permitted length
that holds its contents.

Items are dealt by a hash of id, content, copy and piece to shards of ``shard_rows``
items on average, as many as the table needs, and each shard is packed by one task from
narrow rows (no text moves). A shard of ten thousand items or more wastes a few bins at
most.

Defined results: null and empty texts have no item and one row with null bin; a text
longer than the greatest length is cut into pieces, all of which are packed; ties in size
go by id and piece; repeated rows are items of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import word_count

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16.0
ATTENTION = 1 / 16384
SHARD_ROWS = 20_000


def cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + length + attention * length * length


class _Plan:
    """Open bins by room; bins are numbered in the order in which they were opened."""

    def __init__(self, lengths: Sequence[int], prefer: int | None, price):
        self.lengths, self.prefer, self.price = lengths, prefer, price
        self.rooms: list[tuple[int, int]] = []
        self.used: list[int] = []
        self.places: list[tuple[int, int]] = []

    def opened(self, size: int, rest: int) -> int:
        """Length of the bin to open for an item, when ``rest`` is still to be packed with it."""
        fitting = [c for c in self.lengths if c >= size]
        if self.prefer in fitting:
            return self.prefer
        return min(fitting, key=lambda c: (self.price(c) / min(c, rest), c))

    def add(self, size: int, rest: int) -> None:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            room, number = self.opened(size, rest), len(self.used)
            self.used.append(0)
        self.places.append((number, self.used[number]))
        self.used[number] += size
        if room > size:
            insort(self.rooms, (room - size, number))

    def downsized(self) -> list[int]:
        return [self.lengths[bisect_left(self.lengths, u)] for u in self.used]


def packed(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, price=cost) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each size, length of each bin); ``sizes`` must fall."""
    lengths = sorted(lengths)
    best = None
    for prefer in (None, *lengths):
        plan, rest = _Plan(lengths, prefer, price), sum(sizes)
        for size in sizes:
            plan.add(size, rest)
            rest -= size
        ends = plan.downsized()
        total = sum(map(price, ends))
        if best is None or total < best[0]:
            best = total, plan.places, ends
    return best[1], best[2]


def pieces(docs: DataFrame, doc_id: str, text: str, longest: int) -> DataFrame:
    """(id, content, copy, piece, start, size): the words of each text in stretches of at most ``longest``."""
    sized = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("content"), word_count(text).alias("words"))
    same = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("copies"))
    sized = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    last = F.greatest(F.ceil(F.col("words") / F.lit(longest)), F.lit(1)).cast("int") - 1
    each = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("bigint") * longest
    return each.select(
        "id", "content", "copy", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(longest).cast("bigint")).alias("size")
    )


def packings(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    lengths: Sequence[int] = LENGTHS,
    shard_rows: int = SHARD_ROWS,
    overhead: float = OVERHEAD,
    attention: float = ATTENTION,
) -> DataFrame:
    """(id, piece, start, size, bin_id, bin_size, bin_offset): where each piece is put.

    ``start`` counts words of the text, ``bin_offset`` words of the bin. Bin ids name
    the shard and the bin within it.
    """
    lengths = sorted(lengths)
    items = pieces(docs, doc_id, text, lengths[-1])
    total = items.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-total // shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", "content", "copy", "piece"), F.lit(shards)).cast("int"))

    def price(length: int) -> float:
        return cost(length, overhead, attention)

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        order = ["size", "id", "content", "copy", "piece"]
        shard = shard.sort_values(order, ascending=[False, True, True, True, True], kind="stable")
        full = shard[shard["size"] > 0].copy()
        places, ends = packed(full["size"].tolist(), lengths, price)
        full["bin_id"] = [f"{s}-{b}" for s, (b, _) in zip(full["shard"], places, strict=True)]
        full["bin_size"] = [ends[b] for b, _ in places]
        full["bin_offset"] = [o for _, o in places]
        empty = shard[shard["size"] == 0].assign(bin_id=None, bin_size=None, bin_offset=None)
        out = pd.concat([full, empty]) if len(empty) else full
        return out[["id", "piece", "start", "size", "bin_id", "bin_size", "bin_offset"]].astype(
            {"bin_size": "Int64", "bin_offset": "Int64"}
        )

    kind = dict(docs.dtypes)[doc_id]
    schema = f"id {kind}, piece int, start bigint, size bigint, bin_id string, bin_size bigint, bin_offset bigint"
    return dealt.groupBy("shard").applyInPandas(pack, schema).withColumnRenamed("id", doc_id)
