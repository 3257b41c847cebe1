"""Periodic runs of words, found by catching squares in dyadic blocks.

A run of period q and length of at least 2q is a chain of squares, that is of q words said
twice. Squares are caught as words are appended:

* Whenever 2^k further words are complete, their block gets a catcher of level k. It waits
  for the block to come again p words later, p from 2^(k+1) - 1 to 2^(k+2) - 2, and is
  dropped when its wait is over. These ranges cover every p once, and as 2^(k+1) - 1 words in a
  row hold a whole block of 2^k, the first half of every square holds a block that catches it.
* With each appended word, at each level, the suffix of 2^k words is compared with the
  blocks that wait, two at any time: one comparison of fingerprints each, n log n in all. The
  comparisons of a level are made as one array operation over all words of many texts;
  fingerprints of 2^(k+1) words are mixed from two of 2^k.
* A catch is extended to both sides as far as words p apart are equal, by galloping over prefix
  hashes. Catches of adjacent blocks at one distance are one stretch, and of these the
  first is extended. Squares of a multiple of the period extend to the very same stretch,
  so that the least period of a stretch names the run; runs are then verified word by word.

Texts in which no ``shortest // 2`` words in a row come again hold no run of ``shortest``
words and get no catchers. Texts are independent rows: no shuffle, and one text at a time,
or many short ones together, is all that a task holds.

Defined results: a null text has no words; an empty text, and one without runs, has an empty
list; repeated rows are repeated results; a null id stays; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import split_words

SHORTEST = 12
#: Words of texts that are looked at together.
TOGETHER = 400_000
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_299_709_091)
ODD = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprints of the pairs (left, right)."""
    x = (left ^ (left >> np.uint64(29))) * ODD + right
    return (x ^ (x >> np.uint64(32))) * ODD


class _Prefixes:
    """Whether two stretches of words are equal, from prefix sums of word values times powers of a base."""

    def __init__(self, words: np.ndarray):
        self.tables = []
        for prime, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(len(words) + 1, dtype=np.int64)
            filled = 1
            while filled < len(power):
                more = min(filled, len(power) - filled)
                power[filled : filled + more] = power[:more] * pow(base, filled, prime) % prime
                filled += more
            value = (words.astype(np.int64) * 48_271 + 11) % prime
            sums = np.concatenate([[0], np.cumsum(value * power[:-1] % prime)]) % prime
            self.tables.append((prime, power, sums))

    def equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """words[at : at + length] against words[at + shift : at + shift + length], row by row."""
        same = np.ones(len(at), dtype=bool)
        for prime, power, sums in self.tables:
            here = (sums[at + length] - sums[at]) % prime * power[shift] % prime
            there = (sums[at + shift + length] - sums[at + shift]) % prime
            same &= here == there
        return same

    def extent(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words on from ``at`` (step 1), or back from before it (step -1), equal those ``shift`` later."""
        length = np.zeros(len(at), dtype=np.int64)

        def holds(rows: np.ndarray, width: np.ndarray) -> np.ndarray:
            start = at[rows] + length[rows] if step > 0 else at[rows] - length[rows] - width
            fits = length[rows] + width <= most[rows]
            held = np.zeros(len(rows), dtype=bool)
            held[fits] = self.equal(start[fits], shift[rows][fits], width[fits])
            return held

        # Doubling widths until a comparison fails, then halving ones.
        width = np.ones(len(at), dtype=np.int64)
        growing = np.arange(len(at))
        while len(growing):
            held = holds(growing, width[growing])
            growing = growing[held]
            length[growing] += width[growing]
            width[growing] *= 2
        shrinking = np.flatnonzero(width > 1)
        while len(shrinking):
            width[shrinking] //= 2
            held = holds(shrinking, width[shrinking])
            length[shrinking[held]] += width[shrinking[held]]
            shrinking = shrinking[width[shrinking] > 1]
        return length


def _caught(words: np.ndarray, longest: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of catches that begin a stretch; words are numbered, and no word is in two texts."""
    prints = _mixed(words.astype(np.uint64), np.uint64(7))
    places, distances = [], []
    size = 1
    while 2 * (2 * size - 1) <= longest and size <= len(prints):
        near, far = 2 * size - 1, 4 * size - 2
        blocks = prints[::size]
        wide = np.concatenate([prints, np.zeros(far + size, dtype=np.uint64)])
        starts = np.arange(len(blocks)) * size
        # A stretch that makes a run of the shortest length or two periods spans so many whole blocks.
        spans = [max(1, (max(shortest - p, p) - size + 1) // size) for p in range(near, far + 1)]
        step = max(1, (1 << 23) // (far - near + 1))
        for low in range(0, len(blocks), step):
            high = min(len(blocks), low + step)
            first = max(0, low - 1)
            last = min(len(blocks), high + max(spans) - 1)
            live = np.lib.stride_tricks.sliding_window_view(wide, far - near + 1)[starts[first:last] + near]
            hit = live == blocks[first:last, None]
            if first == low:
                hit = np.vstack([np.zeros((1, hit.shape[1]), dtype=bool), hit])
            begins = hit[1:] & ~hit[:-1]
            begins = begins[: high - low]
            row, column = np.nonzero(begins)
            held = np.ones(len(row), dtype=bool)
            need = np.array(spans)[column]
            for more in range(1, max(spans)):
                at = row + 1 + more
                inside = at < len(hit)
                held &= (need <= more) | (inside & hit[np.minimum(at, len(hit) - 1), column])
            row, column = row[held], column[held]
            places.append(starts[low + row])
            distances.append(column + near)
        if len(prints) <= size:
            break
        prints = _mixed(prints[:-size], prints[size:])
        size *= 2
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(distances)


def _runs(words: np.ndarray, starts: np.ndarray, shortest: int) -> pd.DataFrame:
    """(start, length, period) of the runs, by start and period; ``starts`` has each text's first place and the end."""
    at, period = _caught(words, int(np.diff(starts).max(initial=0)), shortest)
    text = np.searchsorted(starts, at, side="right") - 1
    begin, end = starts[text], starts[text + 1]
    inside = at + period < end
    at, period, begin, end = at[inside], period[inside], begin[inside], end[inside]
    prefixes = _Prefixes(words)
    after = prefixes.extent(at, period, end - at - period, 1)
    before = prefixes.extent(at, period, at - begin, -1)
    found = _least_periods(at - before, before + after + period, period, shortest)
    if not all(_verified(words, start, start + length, p) for start, length, p in found.itertuples(index=False)):
        # Two prefix hashes agreed by chance: the same stretches, word by word.
        spans = [_stretch(words, *catch) for catch in zip(at, period, begin, end, strict=True)]
        low, high = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        found = _least_periods(low, high - low + period, period, shortest)
    return found.sort_values(["start", "period"], ignore_index=True)


def _least_periods(start: np.ndarray, length: np.ndarray, period: np.ndarray, shortest: int) -> pd.DataFrame:
    found = pd.DataFrame({"start": start, "length": length, "period": period})
    found = found[found["length"] >= np.maximum(shortest, 2 * found["period"])]
    return found.groupby(["start", "length"], as_index=False)["period"].min()


def _verified(words: np.ndarray, start: int, end: int, period: int) -> bool:
    return bool((words[start : end - period] == words[start + period : end]).all())


def _stretch(words: np.ndarray, at: int, period: int, begin: int, end: int) -> tuple[int, int]:
    """Where the words from ``at`` on, and before it, stop being equal to those ``period`` later."""
    differ = np.flatnonzero(words[begin : end - period] != words[begin + period : end]) + begin
    place = int(np.searchsorted(differ, at))
    low = int(differ[place - 1]) + 1 if place else begin
    return low, max(low, int(differ[place]) if place < len(differ) else end - period)


def _may_repeat(words: list[bytes], shortest: int) -> bool:
    """Whether some ``shortest // 2`` words in a row come again, or their hashes do."""
    if len(words) < shortest:
        return False
    width = shortest // 2
    values = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    grams = values[: len(values) - width + 1]
    for k in range(1, width):
        grams = grams * ODD + values[k : len(values) - width + 1 + k]
    grams = np.sort(grams)
    return bool((grams[1:] == grams[:-1]).any())


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[pd.DataFrame]:
    """The runs of each text, given as words: frames of start, length and period."""
    none = pd.DataFrame({"start": [], "length": [], "period": []}, dtype=np.int64)
    made = [none] * len(texts)
    chosen = [i for i, words in enumerate(texts) if _may_repeat(words, shortest)]
    if not chosen:
        return made
    numbers: list[np.ndarray] = []
    used = 0
    for i in chosen:
        known: dict[bytes, int] = {}
        for word in texts[i]:
            known.setdefault(word, len(known))
        numbers.append(np.fromiter(map(known.__getitem__, texts[i]), dtype=np.int64, count=len(texts[i])) + used)
        used += len(known)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    found = _runs(np.concatenate(numbers), starts, shortest)
    text = np.searchsorted(starts, found["start"].to_numpy(), side="right") - 1
    bounds = np.searchsorted(text, np.arange(len(chosen) + 1))
    for place, i in enumerate(chosen):
        part = found.iloc[bounds[place] : bounds[place + 1]]
        made[i] = part.assign(start=part["start"] - starts[place])
    return made


def _collapsed(words: list[bytes], runs: pd.DataFrame) -> str:
    """The words but those that a run says again."""
    again = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(again, (runs["start"] + runs["period"]).to_numpy(dtype=np.int64), 1)
    np.add.at(again, (runs["start"] + runs["length"]).to_numpy(dtype=np.int64), -1)
    keep = np.flatnonzero(np.cumsum(again)[:-1] == 0)
    return b" ".join([words[i] for i in keep]).decode() if len(keep) < len(words) else b" ".join(words).decode()


def periodic(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shortest: int = SHORTEST) -> DataFrame:
    """(id, ``n_words``, ``runs``, ``collapsed``) per row.

    ``runs`` lists start, length (in words) and period of every maximal run of at least
    ``shortest`` words and two periods, by start and period. ``collapsed`` is the text with
    single spaces and without the words that lie in a run after its first period.
    """
    if shortest < 2:
        raise ValueError("a run has at least two words")
    kind = dict(docs.dtypes)[doc_id]

    def answers(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        runs = runs_of(texts, shortest)
        return pd.DataFrame({
            "id": ids, "n_words": [len(t) for t in texts], "runs": [r.to_dict("records") for r in runs],
            "collapsed": [_collapsed(t, r) for t, r in zip(texts, runs, strict=True)]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: list = []
            texts: list[list[bytes]] = []
            held = 0
            for name, body in zip(batch["id"], batch["text"], strict=True):
                words = split_words(body)
                if held + len(words) > TOGETHER and texts:
                    yield answers(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(name)
                texts.append(words)
                held += len(words)
            if texts:
                yield answers(ids, texts)

    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = rows.mapInPandas(each, f"id string, n_words bigint, runs {RUNS}, collapsed string")
    return made.select(F.col("id").cast(kind).alias(doc_id), "n_words", "runs", "collapsed")
