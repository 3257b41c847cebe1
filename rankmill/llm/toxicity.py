"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with features, different words and beginnings of
words, has a probability, a logistic function of these, and the document's probability is
their noisy-or: one minus the product of what is left of each sentence, and of one leak,
which stands for all that no feature tells and is the same for each document. Sentences
without features say nothing, and in scoring neither do those below ``FAINT``, so that a text
does not become toxic by being long. Only documents carry labels; the loss of the noisy-or
is what trains the sentence weights, so that the weights end up on the sentences that explain
the labels, and a trained model locates those sentences.

The model is fitted on at most ``fit_rows`` labels, those whose document has the smallest
hash of its id; that table is small enough to be sent to every task, so that no text but
theirs is moved. Document frequencies by label are summed in Spark; the words and
beginnings, ``vocabulary`` at most, that part the labels most by the G statistic become
features, all others are background. A bag is then a few sentences with features, equal
ones as one with a count, and the weights are fitted to the bags on the driver.

Scoring takes every sentence of every whole text, in one pass without a shuffle; the
model, at most ``vocabulary`` numbers, travels with the tasks.

Defined results: null and empty texts have no sentence and get the score of the leak
alone; where the labels name no feature every score is the share of toxic labels (0
if there are none); labels that are null or belong to no document are ignored, and a
document labelled several times is trained once for each. Long texts are scored whole.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import cut_lineage

VOCABULARY = 2048
FIT_ROWS = 20_000
LEAST_ROWS = 5
ROUNDS = 300
PENALTY = 0.3
OFFENDING = 0.5
#: Sentences less probable than this do not add to a score.
FAINT = 0.05

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
#: The same words and the same sentence ends for Spark's regular expressions.
TOKEN_SQL = r"[^\p{L}]+"
#: Lengths of the beginnings, written with a hyphen, that count as features.
STEMS = range(3, 10)
CACHED_WORDS = 500_000


@dataclass
class Model:
    """Weights of words; ``bias`` is added for each sentence that has some, ``leak`` is the log-odds of a text without.

    ``constant`` is the score of every document where nothing could be learned.
    """

    bias: float = -20.0
    weights: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    leak: float | None = None

    def base(self) -> float:
        """Probability of a text in which no sentence speaks."""
        logit = self.bias if self.leak is None else self.leak
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    def sentence(self, words: Iterable[str]) -> float:
        logit = self.bias + sum(self.weights.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences, in code points; together they are the whole text."""
    for found in SENTENCE.finditer(text):
        yield found.start(), found.end()


class Finder:
    """Finds the features of sentences; remembers those of the words it has met."""

    def __init__(self, features: Container[str]):
        self.features = features
        self.known: dict[str, tuple[str, ...]] = {}

    def of_word(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            spelled = [word, *(f"{word[:n]}-" for n in STEMS if n < len(word))]
            found = self.known[word] = tuple(f for f in spelled if f in self.features)
        return found

    def of_text(self, text: str) -> list[tuple[int, int, set[str]]]:
        """The sentences with features, as (start, end, features)."""
        if not any(self.of_word(w) for w in set(TOKEN.findall(text.lower()))):
            return []
        marked = []
        for start, end in sentences(text):
            found = {f for w in TOKEN.findall(text[start:end].lower()) for f in self.of_word(w)}
            if found:
                marked.append((start, end, found))
        return marked


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit_rows: int) -> DataFrame:
    """(text, label) of at most ``fit_rows`` labels, written once: the only texts that are moved."""
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    named = named.select(F.col(doc_id).alias("_x_id"), (F.col(label) > 0).cast("int").alias("label"))
    picked = F.broadcast(named.orderBy(F.xxhash64("_x_id"), "_x_id", "label").limit(fit_rows))
    rows = docs.select(F.col(doc_id).alias("_x_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return cut_lineage(rows.join(picked, F.col("_x_doc") == F.col("_x_id")).select("text", "label"))


def vocabulary(rows: DataFrame, size: int = VOCABULARY, least_rows: int = LEAST_ROWS) -> list[str]:
    """The words whose presence in a text parts the labels most (G statistic)."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n1")).first()
    if not totals["n1"] or totals["n1"] == totals["n"]:
        return []
    tokens = F.array_distinct(F.split(F.lower("text"), TOKEN_SQL))

    def beginnings(n: int) -> Column:
        longer = F.filter(tokens, lambda w: F.char_length(w) > n)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))))

    words = F.explode(F.concat(tokens, *map(beginnings, STEMS))).alias("word")
    seen = rows.select(words, "label").where("word <> ''").groupBy("word")
    seen = seen.agg(F.count(F.lit(1)).alias("with"), F.sum("label").alias("with1")).where(F.col("with") >= least_rows)
    n, n1 = float(totals["n"]), float(totals["n1"])

    def term(cell, row, column):
        return F.when(cell > 0, cell * F.log(cell * n / (row * column))).otherwise(F.lit(0.0))

    with_, with1 = F.col("with").cast("double"), F.col("with1").cast("double")
    without = n - with_
    g = term(with1, with_, n1) + term(with_ - with1, with_, n - n1)
    g += term(n1 - with1, without, n1) + term(without - (n1 - with1), without, n - n1)
    # Only words that speak for the label: noisy-or needs one offending sentence, and
    # words of harmless sentences would only tell the background apart.
    raising = with1 / with_ > n1 / n
    best = seen.where(raising).select("word", g.alias("g")).where("g > 6").orderBy(F.desc("g"), "word").limit(size)
    return [r["word"] for r in best.collect()]


def _bags(rows: DataFrame, words: list[str]) -> DataFrame:
    """Each labelled text as its different sentences of word numbers, with their counts: ``bag``.

    A bag is packed as 32-bit numbers: for each sentence its count, its number of words and these.
    The driver holds all bags at once, and as rows and lists they would take it many times that.
    """
    number = {w: i for i, w in enumerate(words)}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(number)
        for batch in batches:
            bags = []
            for text in batch["text"]:
                held = Counter(tuple(sorted(number[w] for w in found)) for _, _, found in finder.of_text(text))
                flat = [x for s, n in sorted(held.items()) for x in (n, len(s), *s)]
                bags.append(np.asarray(flat, dtype="<i4").tobytes())
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "bag": bags})

    keyed = rows.withColumn("key", F.xxhash64("text"))
    return keyed.mapInPandas(each, "key bigint, label int, bag binary")


def packed(bags: list[tuple[int, list[tuple[list[int], int]]]]) -> list[tuple[int, bytes]]:
    """Bags of sentences, (words, count), as :func:`_bags` packs them."""
    flat = [(label, [x for s, n in bag for x in (n, len(s), *s)]) for label, bag in bags]
    return [(label, np.asarray(bag, dtype="<i4").tobytes()) for label, bag in flat]


def fitted(bags: list[tuple[int, list[tuple[list[int], int]]]], words: list[str], rounds: int = ROUNDS) -> Model:
    """The model of bags, each a label and its sentences as word numbers with a count."""
    return fitted_packed(packed(bags), words, rounds)


def fitted_packed(bags: list[tuple[int, bytes]], words: list[str], rounds: int = ROUNDS) -> Model:
    """Weights that maximise the penalised likelihood of the noisy-or, by Adam steps.

    With q the leak's and all sentences' product of 1 - p, the document's probability is 1 - q, and
    the derivative of its log-likelihood by a sentence's logit is p * (y * q / (1 - q) - (1 - y)),
    once for each count.
    """
    y = np.array([label for label, _ in bags], dtype=float)
    ends = np.cumsum([0, *(len(bag) // 4 for _, bag in bags)])
    data = np.frombuffer(b"".join(bag for _, bag in bags), dtype="<i4")
    heads, at = array("q"), 0
    while at < len(data):
        heads.append(at)
        at += 2 + int(data[at + 1])
    head = np.frombuffer(heads, dtype=np.int64) if heads else np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(ends, head, side="right") - 1
    times = data[head].astype(float)
    sizes = data[head + 1]
    held = np.ones(len(data), dtype=bool)
    held[head] = held[head + 1] = False
    flat = data[held].astype(np.int64)
    owner = np.repeat(np.arange(len(head)), sizes)
    theta = np.zeros(len(words) + 2)
    theta[-2:] = -7.0, -5.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        logit = theta[-2] + np.bincount(owner, theta[flat], len(head))
        p, p0 = 1 / (1 + np.exp(-logit)), 1 / (1 + np.exp(-theta[-1]))
        q = np.exp(np.log1p(-p0) + np.bincount(doc, times * np.log1p(-np.minimum(p, 1 - 1e-9)), len(bags)))
        pull = y * q / np.maximum(1 - q, 1e-9) - (1 - y)
        by_sentence = times * p * pull[doc]
        slope = np.bincount(flat, by_sentence[owner], len(theta)) if len(flat) else np.zeros_like(theta)
        slope[-2] += by_sentence.sum()
        slope[-1] += p0 * pull.sum()
        slope[:-2] -= PENALTY * theta[:-2]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        theta[-2:] = np.minimum(theta[-2:], -0.5)
    weights = {w: float(t) for w, t in zip(words, theta, strict=False) if abs(t) > 1e-3}
    return Model(float(theta[-2]), weights, leak=float(theta[-1]))


def trained(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    *,
    size: int = VOCABULARY,
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Learn from the labelled rows given; which rows these are is the caller's choice."""
    rows = _labelled(docs, labels, doc_id, text, label, fit_rows)
    words = vocabulary(rows, size)
    if not words:
        return Model(constant=rows.agg(F.avg("label")).first()[0] or 0.0)
    # Documents that repeat an id may be more than the labels; the bound holds for them too.
    bags = _bags(rows, words).orderBy("key", "label").limit(fit_rows).select("label", "bag").collect()
    return fitted_packed([(r["label"], bytes(r["bag"])) for r in bags], words)


def score(model: Model, text: str | None, finder: Finder | None = None) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability and its sentences with features: (start, end, probability)."""
    if model.constant is not None:
        return model.constant, []
    marked = (finder or Finder(model.weights)).of_text(text or "")
    scored = [(start, end, model.sentence(found)) for start, end, found in marked]
    left = math.log1p(-min(model.base(), 1 - 1e-9))
    left += sum(math.log1p(-min(p, 1 - 1e-9)) for _, _, p in scored if p >= FAINT)
    return -math.expm1(left), scored


def scored(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *, offending: float = OFFENDING
) -> DataFrame:
    """(id, ``score``, ``offending``): per row the score and the sentences at or above ``offending``.

    Spans are in code points, end exclusive, in the order of the text.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(model.weights)
        for batch in batches:
            made = [score(model, t, finder) for t in batch["text"]]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s if p >= offending] for _, s in made]
            yield pd.DataFrame({"id": batch["id"], "score": [s for s, _ in made], "offending": spans})

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = dict(docs.dtypes)[doc_id]
    spans = "array<struct<start int, end int, score double>>"
    return rows.mapInPandas(each, f"id {kind}, score double, offending {spans}").withColumnRenamed("id", doc_id)


def without_toxic(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", *, reject: float = 0.5
) -> DataFrame:
    """The rows whose score is below ``reject``, with their own columns."""

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(model.weights)
        for texts in parts:
            yield pd.Series([score(model, t, finder)[0] for t in texts], dtype=float)

    return docs.where(scores(F.col(text)) < reject)
