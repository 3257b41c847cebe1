"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Let x be the counts of a word's letters. One replaced letter moves x by a squared distance
of exactly 2 and leaves the length; one inserted or deleted letter moves it by exactly 1 and
the length by one. So words are dealt into blocks, and for two blocks of equal or adjacent
lengths one matrix product gives all squared distances: with -|x|^2 / 2 and 1 as two further
columns, and the other way round on the other side, the product itself is -d^2 / 2. The
pairs at 2 (equal lengths) or 1 (adjacent lengths) are verified letter by letter.

Blocks are finer than a length: letters fall into ``CLASSES`` classes by code point, and the
counts of the classes, whose sum is the length, name the block. One edit moves these counts
as it moves x, by a squared distance of at most 2, so that a block meets itself, the blocks
with one letter less and those with one letter in another class, each pair of blocks on one
side only. Each word is sent to at most 1 + C + C (C - 1) / 2 = 22 blocks, whatever the size
of the vocabulary; a block of many words is cut into parts, past which the others stream.
No pair leaves a task: what comes out is, for a word in a block, the number of near words
there and the most frequent of them.

Defined results: a null text has no words; a null id counts as the text ``null``; words are
counted over all rows, repeated rows included; among near words of one frequency the smallest
in code-point order is the form; an empty table gives no words; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

from .cells import dealt, streamed
from .words import UPPER

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST = 7
LEAST = 2
FACTOR = 10
CLASSES = 6
#: Words of a part of a block, and letters of all its words.
BLOCK = 4096
BLOCK_LETTERS = 1 << 20
#: Words counted in a task before they are handed on.
HELD = 500_000
#: Characters of a text looked at together.
PIECE = 1 << 20
LOWER = str.maketrans(UPPER, UPPER.lower())


def _pieces(text: str, letter: re.Pattern[str]) -> Iterator[str]:
    """The text in pieces that part no run of letters, as long as runs are shorter than memory."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and letter.match(text, end):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def vocabulary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
    shortest: int = SHORTEST, least: int = LEAST, damage: int | None = None,
) -> DataFrame:
    """(``word``, ``n``): runs of letters, A-Z in lower case, of ``shortest`` code points, seen ``least`` times.

    With ``damage``, a run loses one letter wherever ``damage`` divides the CRC-32 h of
    ``<id>:<run>``: the letter at h modulo its length. It serves to plant known misspellings.
    Each task counts what it reads and hands on one row a word.
    """
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
    letter = re.compile(f"[{LETTERS}]")

    def counts(name: str, body: str) -> Counter:
        raw: Counter = Counter()
        for piece in _pieces(body, letter):
            raw.update(runs.findall(piece))
        found: Counter = Counter()
        start = zlib.crc32(f"{name}:".encode())
        for run, n in raw.items():
            word = run.lower() if run.isascii() else run.translate(LOWER)
            if damage is not None and not (h := zlib.crc32(word.encode(), start)) % damage:
                word = word[: (at := h % len(word))] + word[at + 1 :]
            found[word] += n
        return found

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def made() -> pd.DataFrame:
            return pd.DataFrame({"word": list(total), "n": list(total.values())})

        for batch in batches:
            for name, body in zip(batch["id"], batch["text"], strict=True):
                for word, n in counts(name, body).items():
                    if len(word) >= shortest:
                        total[word] += n
                if len(total) > HELD:
                    yield made()
                    total.clear()
        if total:
            yield made()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seen = rows.mapInPandas(each, "word string, n bigint")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _profile(word: str | Column) -> list[Column]:
    """How many letters of each class a word has."""
    column = F.col(word) if isinstance(word, str) else word
    letters = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0xC0, 0x100))]
    of = ["".join(x for x in letters if ord(x) % CLASSES == k) for k in range(CLASSES)]
    return [F.char_length(column) - F.char_length(F.translate(column, of[k], "")) for k in range(CLASSES)]


def _counted(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): a row of letters and a row of letter counts for each word of one length."""
    codes = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), length)
    kind = np.float32 if length < 2000 else np.float64
    counts = np.empty((len(words), 256), dtype=kind)
    step = max(1, (1 << 22) // (length + 256))
    for at in range(0, len(words), step):
        part = codes[at : at + step].astype(np.int64) + np.arange(len(codes[at : at + step]))[:, None] * 256
        counts[at : at + step] = np.bincount(part.ravel(), minlength=len(part) * 256).reshape(-1, 256)
    return codes, counts


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row by row, whether one edit leads from the one to the other; rows differ in length by at most one."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    width = short.shape[1]
    begins = np.logical_and.accumulate(short == long[:, :width], axis=1).sum(axis=1)
    ends = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return begins + ends >= width


class _Block:
    """Words of one profile, and their product with others."""

    def __init__(self, words: pd.Series, n: pd.Series):
        self.text = [w.encode("latin-1") for w in words]
        self.length = len(self.text[0])
        self.codes, counts = _counted(self.text, self.length)
        self.n = n.to_numpy()
        self.letters = np.flatnonzero(counts.any(axis=0))
        half = (counts**2).sum(axis=1, keepdims=True) / 2
        self.left = np.hstack([counts[:, self.letters], -half, np.ones_like(half)])

    def pairs(self, codes: np.ndarray, counts: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(member, other) of the pairs one edit apart; ``own``: the others are the members themselves."""
        half = (counts**2).sum(axis=1, keepdims=True) / 2
        right = np.hstack([counts[:, self.letters], np.ones_like(half), -half])
        wanted = -1.0 if codes.shape[1] == self.length else -0.5
        found = []
        for at in range(0, len(codes), 1024):
            member, other = np.nonzero(self.left @ right[at : at + 1024].T == wanted)
            other += at
            if own:
                member, other = member[member < other], other[member < other]
            step = max(1, (1 << 22) // (self.length + 1))
            for low in range(0, len(member), step):
                m, o = member[low : low + step], other[low : low + step]
                held = _one_edit(*((self.codes[m], codes[o]) if self.length <= codes.shape[1] else (codes[o], self.codes[m])))
                found.append((m[held], o[held]))
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _best(words: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> pd.DataFrame | None:
    """For each word of the pairs: how many it is near to, and the first of them by falling n, then by letters."""
    if not len(left):
        return None
    ends, others = np.concatenate([left, right]), np.concatenate([right, left])
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = np.arange(len(words))
    near = np.bincount(ends, minlength=len(words))
    first = np.full(len(words), len(words))
    np.minimum.at(first, ends, rank[others])
    some = np.flatnonzero(near)
    best = order[first[some]]
    return pd.DataFrame({
        "word": [words[i].decode("latin-1") for i in some], "n_near": near[some],
        "best": [words[i].decode("latin-1") for i in best], "best_n": n[best]})


def _opened(members: pd.DataFrame):
    block = _Block(members["word"], members["n"])

    def probe(rows: pd.DataFrame) -> pd.DataFrame | None:
        made = []
        lengths = rows["word"].str.len().to_numpy()
        for length in np.unique(lengths):
            part = rows[lengths == length]
            text = [w.encode("latin-1") for w in part["word"]]
            m, o = block.pairs(*_counted(text, length))
            used_m, used_o = np.unique(m), np.unique(o)
            words = [block.text[i] for i in used_m] + [text[i] for i in used_o]
            n = np.concatenate([block.n[used_m], part["n"].to_numpy()[used_o]])
            made.append(_best(words, n, np.searchsorted(used_m, m), np.searchsorted(used_o, o) + len(used_m)))
        made = [x for x in made if x is not None]
        return pd.concat(made) if made else None

    m, o = block.pairs(block.codes, _counted(block.text, block.length)[1], own=True)
    return _best(block.text, block.n, m, o), probe


def near_words(words: DataFrame) -> DataFrame:
    """(``word``, ``n_near``, ``best``, ``best_n``) of words with a near word; ``words`` has ``word`` and ``n``.

    Words are different and have letters of Latin-1 only.
    """
    profile = [c.alias(f"_{k}") for k, c in enumerate(_profile("word"))]
    rows = words.select("word", "n", *profile)
    names = [F.col(f"_{k}") for k in range(CLASSES)]

    def block(move: dict[int, int]) -> Column:
        return F.concat_ws(".", *[(c + move.get(k, 0)).cast("string") for k, c in enumerate(names)])

    rows = cut_lineage(rows.select("word", "n", *names, block({}).alias("own")))
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.char_length("word")) / BLOCK_LETTERS)
    crowded = cut_lineage(rows.groupBy("own").agg(F.ceil(size).cast("int").alias("parts")).where("parts > 1"))
    meets = [({i: -1}, names[i] > 0) for i in range(CLASSES)]
    meets += [({i: -1, j: 1}, names[i] > 0) for j in range(CLASSES) for i in range(j)]
    others = F.filter(F.array(*[F.when(ok, block(move)) for move, ok in meets]), lambda x: x.isNotNull())
    own = rows.select(F.col("own").alias("cell"), F.lit(0).alias("role"), "word", "n")
    there = rows.select(F.explode(others).alias("cell"), F.lit(1).alias("role"), "word", "n")
    there = there.join(rows.select(F.col("own").alias("cell")).distinct(), "cell", "left_semi")
    rows = dealt(own.unionByName(there), ["cell"], "word", crowded.withColumnRenamed("own", "cell"))
    made = rows.mapInPandas(streamed(("cell", "part"), _opened), "word string, n_near bigint, best string, best_n bigint")
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    made = made.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return made.select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.n")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) of words that have a form: the last one of the way, which doubles in each round.

    A form is ``FACTOR`` times as frequent as its word, so a way has few steps and no circle.
    """
    ways = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = cut_lineage(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        ways = longer.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Each word with its form and root: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    The form is the most frequent near word if it is ``factor`` times as frequent as the
    word, else null. The root is the end of the way of forms, or the word itself.
    """
    if factor < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    words = cut_lineage(words.select("word", "n"))
    formed = F.col("best_n") >= factor * F.col("n")
    made = words.join(near_words(words), "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"))
    made = cut_lineage(made)
    made = made.join(_roots(made.where("form is not null")), "word", "left")
    return made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
