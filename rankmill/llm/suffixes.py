"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes only those are kept that start at a minimiser: in every ``window``
consecutive runs of ``gram`` words the one with the least hash. With ``window = least -
gram + 1`` any passage of ``least`` words holds a full window, and since the choice
depends on its words alone, all copies of the passage keep the same suffix. That is about
one word in twenty at the defaults.

Runs that occur once are dropped by a count over the narrow table of kept positions. The
others are sorted as suffixes and, in a second order, as reversed prefixes; in either
order each is compared with its nearest neighbours of other documents, which share the
longest beginning with it, and the match is extended word by word to the right and to the
left. Matches of ``least`` words or more become spans, and overlapping spans of a
document are merged. A suffix carries just the words that can decide that (``least`` to
either side): a longer match is found again at each of its later minimisers.

Both sorts are range partitions, so a passage that a third of all documents share is
spread over many tasks. A text that says a passage many times keeps one suffix for all places
with the same words around; the spans found are moved to the other places afterwards.
Suffixes of one text and one run that stand together are held until the next other text is
seen, over blocks and over partitions: what faces each other across a border of partitions is
compared in a step of its own, one group a border. Equal texts are one document here
(their copies are reduced before the shuffle) and get one span over all their words.

Words are compared by 32 bits of their hash. Matches whose best partner to the right is
not the best to the left are found through either order; where three or more versions of
one passage differ on both sides, a partner that is best in neither order may be missed
at one suffix, and is then found at another suffix of the passage unless the match has
hardly more than ``least`` words.

Defined results: null texts are empty; texts under ``least`` words have no span; a passage
that repeats only inside one document is none; rows with the same text have the same
spans, and a row that repeats id and text is no second document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, release

from .words import split_words, word_count

LEAST = 50
GRAM = 10
NEIGHBOURS = 2
CACHED_WORDS = 500_000
#: Names of texts, of 8 bytes each, that are sent to all tasks, at most; more are left to the join.
SENT = 500_000
DOCS_AT_ONCE = 64


class Hasher:
    """Hashes of words; remembers those it has met."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        known, words = self.known, split_words(text)
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words."""
    count = len(words) - gram + 1
    total = np.zeros(count, dtype=np.uint64)
    for j in range(gram):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + count]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash (the first of equals) of every ``window`` in a row."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _kept(docs: DataFrame, text: str, least: int, gram: int) -> DataFrame:
    """(gram, text_hash, pos) of the kept suffixes of every text."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hasher()
        for batch in batches:
            for start in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.iloc[start : start + DOCS_AT_ONCE]
                found, own, at = [], [], []
                for key, content in zip(part["text_hash"], part["text"], strict=True):
                    words = hashed(content)
                    if len(words) >= least:
                        runs = grams(words, gram)
                        pos = minimisers(runs, least - gram + 1)
                        found.append(runs[pos])
                        own.append(np.full(len(pos), key))
                        at.append(pos)
                if found:
                    yield pd.DataFrame(
                        {"gram": np.concatenate(found).view(np.int64), "text_hash": np.concatenate(own), "pos": np.concatenate(at)}
                    )

    rows = docs.select(_text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInPandas(each, "gram bigint, text_hash bigint, pos int")


def _sides(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The suffixes at ``places`` with the words on their right and, reversed, on their left."""
    reach = least - gram

    def side(words: np.ndarray, starts: np.ndarray, step: int) -> list[bytes]:
        low = (words >> np.uint64(32)).astype(">u4")
        if step > 0:
            return [low[s : s + reach].tobytes() for s in starts]
        return [low[max(0, s - reach + 1) : s + 1][::-1].tobytes() for s in starts]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hasher()
        for batch in batches:
            for start in range(0, len(batch), DOCS_AT_ONCE):
                rows = []
                for key, content, places in batch[["text_hash", "text", "places"]].iloc[start : start + DOCS_AT_ONCE].itertuples(index=False):
                    words, pos = hashed(content), np.sort(np.asarray(places))
                    made = grams(words, gram)[pos].view(np.int64)
                    alike: dict[tuple, list[int]] = {}
                    for around, at in zip(zip(made.tolist(), side(words, pos + gram, 1), side(words, pos - 1, -1), strict=True), pos.tolist(), strict=True):
                        alike.setdefault(around, []).append(at)
                    rows += [(*around, key, at[0], at[1:]) for around, at in alike.items()]
                yield pd.DataFrame(rows, columns=["gram", "right", "left", "text_hash", "pos", "more"])

    return texts.mapInPandas(each, "gram bigint, right binary, left binary, text_hash bigint, pos int, more array<int>")


def _shared(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many 4-byte words each pair has in common from the start."""
    if not a:
        return np.zeros(0, dtype=np.int64)
    width = max(4, max(map(len, a)), max(map(len, b)))
    left = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in a), ">u4").reshape(len(a), -1)
    right = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in b), ">u4").reshape(len(b), -1)
    differ = np.column_stack([left != right, np.ones(len(a), dtype=bool)]).argmax(axis=1)
    ends = np.minimum([len(x) // 4 for x in a], [len(x) // 4 for x in b])
    return np.minimum(differ, ends)


def matched(rows: pd.DataFrame, least: int, gram: int, neighbours: int) -> pd.DataFrame:
    """Spans from suffixes in sorted order: each with its next ``neighbours`` of other texts."""
    run, own = rows["gram"].to_numpy(), rows["text_hash"].to_numpy()
    right, left, pos = rows["right"].tolist(), rows["left"].tolist(), rows["pos"].to_numpy()
    count = len(rows)
    # The first suffix of the next stretch of another text, and the last of the one before.
    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [count]])
    stretch = np.searchsorted(starts, np.arange(count), side="right") - 1
    out = []
    for near, step in ((starts[stretch + 1], 1), (starts[stretch] - 1, -1)):
        here, there = np.arange(count), near
        for _ in range(neighbours):
            fit = (there >= 0) & (there < count)
            here, there = here[fit], there[fit]
            fit = run[here] == run[there]
            here, there = here[fit], there[fit]
            other = own[here] != own[there]
            a, b = here[other], there[other]
            ahead = _shared([right[i] for i in a], [right[i] for i in b])
            back = _shared([left[i] for i in a], [left[i] for i in b])
            long = ahead + back + gram >= least
            for x in (a, b):
                out.append(np.column_stack([own[x], pos[x], pos[x] - back, pos[x] + gram + ahead])[long])
            there = there + step
    spans = np.concatenate(out) if out else np.zeros((0, 4), dtype=np.int64)
    return pd.DataFrame(np.unique(spans, axis=0), columns=["text_hash", "pos", "start", "end"])


def _run(rows: pd.DataFrame, step: int) -> int:
    """How many rows at the start (step 1) or at the end (-1) have one text and one run of words."""
    own, run = rows["text_hash"].to_numpy()[::step], rows["gram"].to_numpy()[::step]
    differ = np.flatnonzero((own != own[0]) | (run != run[0]))
    return int(differ[0]) if len(differ) else len(rows)


def _compared(ordered: DataFrame, columns: list[str], least: int, gram: int, neighbours: int) -> DataFrame:
    """(text_hash, pos, start, end) found between neighbours of a range-partitioned, sorted frame.

    Rows stream by in blocks. A block begins with the open run of the one before, that is with
    all rows of the last text and run of words, and with the rows that stand before it. What a
    partition begins and ends with is passed on in the same way. A partition that is one run
    lies open to both sides, so that borders are grouped by the partitions that are not.
    """
    reach = 2 * neighbours + 2
    names = ["gram", "right", "left", "text_hash", "pos", "start", "end", "task", "edge"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        head: pd.DataFrame | None = None
        tail: pd.DataFrame | None = None
        opening = True
        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([tail, batch], ignore_index=True) if tail is not None else batch
            if opening:
                # The first run, and the rows behind it, face what the partition before ends with.
                head = batch if head is None else pd.concat([head, batch], ignore_index=True)
                first = _run(head, 1)
                opening = first == len(head)
                if not opening:
                    yield head.iloc[: first + reach].assign(start=None, end=None, task=task, edge=0)
                    head = None
            yield matched(rows, least, gram, neighbours).assign(gram=None, right=None, left=None, task=task, edge=None)
            tail = rows.iloc[-(_run(rows, -1) + reach) :]
        if head is not None:
            yield head.assign(start=None, end=None, task=task, edge=2)
        elif tail is not None:
            yield tail.assign(start=None, end=None, task=task, edge=1)

    def ints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for made in each(batches):
            yield made[names].astype({"gram": "Int64", "pos": "Int32", "start": "Int64", "end": "Int64", "edge": "Int32"})

    def border(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["task", *columns], ignore_index=True)
        return matched(rows, least, gram, neighbours)

    schema = "gram bigint, right binary, left binary, text_hash bigint, pos int, start bigint, end bigint, task int, edge int"
    made = cut_lineage(ordered.mapInPandas(ints, schema))
    found = "text_hash", F.col("pos").cast("bigint").alias("pos"), "start", "end"
    inside = made.where("edge is null").select(*found)
    edges = made.where("edge is not null").select("gram", "right", "left", "text_hash", "pos", "task", "edge")
    # One row a partition: how many with both ends have come so far.
    counted = edges.groupBy("task").agg(F.max((F.col("edge") < 2).cast("int")).alias("ends"))
    counted = counted.select("task", F.sum("ends").over(Window.orderBy("task")).alias("so_far"))
    edges = edges.join(counted, "task").withColumn("border", F.col("so_far") - (F.col("edge") == 0).cast("int"))
    across = edges.groupBy("border").applyInPandas(border, "text_hash bigint, pos bigint, start bigint, end bigint")
    spans = cut_lineage(inside.union(across).distinct())
    release(made)
    return spans


def repeated(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    *,
    least: int = LEAST,
    gram: int = GRAM,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """(id, start, end, copies): word spans of each row that occur in other documents too.

    ``copies`` is the number of rows with different ids that have the whole text.
    """
    kept = cut_lineage(_kept(docs, text, least, gram))
    twice = kept.groupBy("gram").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    twice = cut_lineage(twice.where("a <> b").select("gram"))
    places = kept.join(twice, "gram", "left_semi").groupBy("text_hash").agg(F.collect_set("pos").alias("places"))
    places = cut_lineage(places)
    release(kept, twice)
    texts = docs.select(_text_hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Texts that share no run need not move; their names go to all tasks where they are few.
    if places.count() <= SENT:
        texts = texts.join(F.broadcast(places.select("text_hash")), "text_hash", "left_semi")
    texts = texts.groupBy("text_hash").agg(F.first("text").alias("text")).join(places, "text_hash")
    sides = cut_lineage(_sides(texts, least, gram))
    release(places)
    spans, founds = None, []
    for order in (["gram", "right", "left"], ["gram", "left", "right"]):
        columns = [*order, "text_hash", "pos"]
        ranged = sides.drop("more").repartitionByRange(*columns).sortWithinPartitions(*columns)
        found = _compared(ranged, columns, least, gram, neighbours)
        founds.append(found)
        spans = found if spans is None else spans.union(found)
    # The same words around another place of the text repeat there too.
    moved = spans.distinct().join(sides.where(F.size("more") > 0).select("text_hash", "pos", "more"), ["text_hash", "pos"])
    moved = moved.select("text_hash", F.col("start") - F.col("pos"), F.col("end") - F.col("pos"), F.explode("more").alias("at"))
    moved = moved.toDF("text_hash", "before", "after", "at").select("text_hash", (F.col("at") + F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    spans = spans.select("text_hash", "start", "end").union(moved)
    # One text's spans number at most its words; they are merged along its positions.
    along = Window.partitionBy("text_hash").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.distinct().withColumn("new", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(along))
    merged = spans.groupBy("text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("id"), _text_hash(text).alias("text_hash"), word_count(text).alias("n")).distinct()
    rows = cut_lineage(rows)
    same = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    same = same.join(merged, "text_hash", "left").where((F.col("copies") > 1) & (F.col("n") >= least) | F.col("spans").isNotNull())
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n").cast("bigint").alias("end")))
    same = cut_lineage(same.select("text_hash", "copies", F.when((F.col("copies") > 1) & (F.col("n") >= least), whole).otherwise(F.col("spans")).alias("spans")))
    release(sides, *founds)
    each = rows.select("id", "text_hash").join(same, "text_hash").select("id", F.explode("spans").alias("s"), "copies")
    return each.select(F.col("id").alias(doc_id), "s.start", "s.end", "copies")
