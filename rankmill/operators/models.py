"""Density readings and batched scoring of candidate models on observation pairs.

Candidates are a small table (candidate, scale, values). Scoring reads every
pair under every candidate in place and keeps only sums, so the pairs are scanned
once and nothing the size of pairs x candidates is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import numbered



def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def above_steps(shares: Column) -> Column:
    """Share at or above the foot of each bin, with a closing 0."""
    n = F.size(shares)
    sums = F.transform(F.sequence(F.lit(1), n), lambda k: F.aggregate(
        F.slice(shares, k, n), F.lit(0.0), lambda acc, v: acc + v))
    return F.concat(sums, F.array(F.lit(0.0)))


def masses(values: Column) -> Column:
    """Shares of the segments of a piecewise-linear density on [0, 1]."""
    n = F.size(values) - 1
    return F.transform(F.sequence(F.lit(1), n), lambda k: (
        F.element_at(values, k) + F.element_at(values, k + 1)) / (2 * n))


def _segment(above: Column, top: Column) -> Column:
    bins = F.size(above) - 1
    reached = F.size(F.filter(above, lambda a: a >= top)) - 1
    return F.greatest(F.lit(0), F.least(bins - 1, reached))


def level_constant(top: Column, shares: Column, above: Column) -> Column:
    """Level of a top share under a piecewise-constant density."""
    top = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top))
    bins = F.size(shares)
    return _bind(_segment(above, top), lambda k: (k + 1) / bins - (
        top - F.get(above, k + 1)) / (F.get(shares, k) * bins))


def level_linear(top: Column, values: Column, above: Column) -> Column:
    """Level of a top share under a piecewise-linear density (closed form per segment)."""
    top = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top))
    width = 1.0 / (F.size(values) - 1)
    packed = _bind(_segment(above, top), lambda k: F.struct(
        k.alias("k"), (top - F.get(above, k + 1)).alias("need"), F.get(values, k).alias("left"),
        F.get(values, k + 1).alias("right")))

    def read(s: Column) -> Column:
        slope = (s["right"] - s["left"]) / width
        radical = F.greatest(s["right"] * s["right"] - 2 * slope * s["need"], F.lit(0.0))
        down = s["right"] + F.sqrt(radical)
        return (s["k"] + 1) * width - F.when(down != 0, 2 * s["need"] / down).otherwise(0.0)

    return _bind(packed, read)


def unimodal(values: Column) -> Column:
    """Rises then falls; either end may be the peak."""
    n = F.size(values)

    def shape(peak: Column) -> Column:
        rises = F.forall(F.sequence(F.lit(1), n - 1), lambda i: (i >= peak) | (
            F.element_at(values, i + 1) - F.element_at(values, i) >= -1e-9))
        falls = F.forall(F.sequence(F.lit(1), n - 1), lambda i: (i < peak) | (
            F.element_at(values, i + 1) - F.element_at(values, i) <= 1e-9))
        return rises & falls

    return F.when(n < 2, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(1), n), shape))


def softmax(raw: Column) -> Column:
    """Positive shares summing to 1."""
    weights = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
    return F.transform(weights, lambda v: v / F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w))


def trapezoid_mean(values: Column) -> Column:
    return F.aggregate(masses(values), F.lit(0.0), lambda acc, v: acc + v)


def bend_penalty(values: Column) -> Column:
    """Sum of squared second differences."""
    n = F.size(values)
    bends = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.pow(
        F.element_at(values, i + 2) - 2 * F.element_at(values, i + 1) + F.element_at(values, i), 2)))
    return F.aggregate(F.coalesce(bends, F.array().cast("array<double>")), F.lit(0.0), lambda acc, v: acc + v)


def step_penalty(values: Column) -> Column:
    """Sum of squared first differences."""
    n = F.size(values)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.pow(
        F.element_at(values, i + 1) - F.element_at(values, i), 2)))
    return F.aggregate(F.coalesce(steps, F.array().cast("array<double>")), F.lit(0.0), lambda acc, v: acc + v)


def with_above(densities: DataFrame, linear: bool) -> DataFrame:
    shares = masses(F.col("values")) if linear else F.col("values")
    return densities.withColumn("above", above_steps(shares))


def feasible(densities: DataFrame, sizes: Mapping[str, float], cover: Sequence[str], overlap: float = 0.0,
             retake: tuple[str, str] | None = None, require_unimodal: bool = False) -> DataFrame:
    """Candidates whose densities can be a population.

    Each averages 1 and stays within the cohort's share; the covering scales fill
    every place of the cohort; a retake never exceeds the exam it repeats.
    """
    cohort = sum(sizes[s] for s in cover) / (1.0 + overlap)
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in (pair[0], float(pair[1]))])
    cap = F.lit(cohort) / size[F.col("scale")]
    single = (F.abs(trapezoid_mean(F.col("values")) - 1.0) < 1e-6) & F.forall(
        "values", lambda v: (v >= -1e-9) & (v <= F.lit(1e-9) + cap))
    if require_unimodal:
        single = single & unimodal(F.col("values"))
    rows = densities.withColumn("_ok", single)
    one = rows.groupBy("candidate").agg(F.every("_ok").alias("_ok"), *[
        F.first(F.when(F.col("scale") == s, F.col("values")), True).alias("v_" + s) for s in sizes])
    nodes = F.sequence(F.lit(1), F.size("v_" + cover[0]))
    filled = F.forall(nodes, lambda i: sum(
        (F.lit(float(sizes[s])) * F.element_at(F.col("v_" + s), i) for s in cover[1:]),
        F.lit(float(sizes[cover[0]])) * F.element_at(F.col("v_" + cover[0]), i)) >= cohort * (1 - 1e-9))
    test = F.col("_ok") & filled
    if retake:
        second, first = retake
        test = test & F.forall(nodes, lambda i: F.lit(float(sizes[second])) * F.element_at(F.col("v_" + second), i)
                               <= F.lit(float(sizes[first])) * F.element_at(F.col("v_" + first), i) + 1e-9)
    return densities.join(one.where(test).select("candidate"), "candidate", "left_semi")


def read_pairs(pairs: DataFrame, densities: DataFrame, linear: bool = True) -> DataFrame:
    """Both levels of every pair under every candidate.

    One row for each pair and candidate by definition; the joins are left to the
    optimizer, which sends a small table of candidates to every task.
    """
    read = level_linear if linear else level_constant
    known = with_above(densities, linear)
    side = {x: known.select(
        F.col("candidate").alias("candidate" if x == "a" else "_cand"), F.col("scale").alias("_scale" + x),
        F.col("values").alias("_v" + x), F.col("above").alias("_above" + x)) for x in "ab"}
    both = pairs.join(side["a"], F.col("scale_a") == F.col("_scalea"))
    both = both.join(side["b"], (F.col("candidate") == F.col("_cand")) & (F.col("scale_b") == F.col("_scaleb")))
    both = both.withColumn("level_a", read(F.col("top_a"), F.col("_va"), F.col("_abovea")))
    both = both.withColumn("level_b", read(F.col("top_b"), F.col("_vb"), F.col("_aboveb")))
    return both.drop("_va", "_vb", "_abovea", "_aboveb", "_cand", "_scalea", "_scaleb")


def score(pairs: DataFrame, densities: DataFrame, linear: bool = True, curvature: float = 0.0,
          steps: float = 0.0) -> DataFrame:
    """Loss of every candidate: weighted squared gap plus shape penalties."""
    gap = F.col("level_a") - F.col("level_b")
    w = F.col("weight")
    sums = read_pairs(pairs, densities, linear).groupBy("candidate").agg(
        (F.sum(w * gap * gap) / F.sum(w)).alias("squared"),
        (100.0 * F.sum(w * F.abs(gap)) / F.sum(w)).alias("mae"),
    )
    shape = densities.groupBy("candidate").agg(
        (curvature * F.sum(bend_penalty(F.col("values"))) + steps * F.sum(step_penalty(F.col("values")))).alias("_p"))
    return sums.join(shape, "candidate").select(
        "candidate", "mae", (F.col("squared") + F.col("_p")).alias("loss"))


def balanced_folds(groups: DataFrame, key: str, weight: str, folds: int, **options) -> DataFrame:
    """Deal whole groups to folds back and forth by falling weight."""
    placed = numbered(groups, [], [-F.col(weight), F.col(key)], "_n", **options)
    turn = F.pmod(F.col("_n") - 1, F.lit(2 * folds))
    fold = F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn)
    return placed.withColumn("fold", fold.cast("int")).drop("_n")


def _gap_sums(read: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap, w = F.col("level_a") - F.col("level_b"), F.col("weight")
    return read.groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * F.abs(gap)).alias("a"), F.sum(w * gap * gap).alias("q"))


def _loss_cube(pairs: DataFrame, densities: DataFrame, group: str, folds: int, linear: bool, **options) -> DataFrame:
    """(candidate, fold, w, a, q): loss sums of each candidate on each fold, from one read of the pairs.

    All that a comparison asks is sums of these cells: a fold is one cell, the rest of the data
    is the whole less that cell, and a full fit is the whole.
    """
    weights = pairs.groupBy(group).agg(F.sum("weight").alias("_gw"))
    dealt = balanced_folds(weights, group, "_gw", folds, **options).select(group, "fold")
    return cut_lineage(_gap_sums(read_pairs(pairs.join(dealt, group), densities, linear), ["candidate", "fold"]))


def _held_out(cells: DataFrame, families: DataFrame) -> DataFrame:
    whole = cells.groupBy("candidate").agg(F.sum("w").alias("tw"), F.sum("q").alias("tq"))
    table = cells.join(whole, "candidate").join(families.select("candidate", "family"), "candidate")
    train = (F.col("tq") - F.col("q")) / (F.col("tw") - F.col("w"))
    test = F.struct((100.0 * F.col("a") / F.col("w")).alias("mae"), F.col("w").alias("w"))
    best = table.groupBy("family", "fold").agg(F.min_by(test, F.struct(train, "candidate")).alias("t"))
    return best.groupBy("family").agg(
        (F.sum(F.col("t.mae") * F.col("t.w")) / F.sum("t.w")).alias("mae"), F.stddev_pop("t.mae").alias("fold_sd"))


def held_out(pairs: DataFrame, densities: DataFrame, families: DataFrame, group: str, folds: int = 5,
             linear: bool = True, **options) -> DataFrame:
    """Held-out error per model family and its spread over the folds.

    A family is a set of candidates; on each fold its best candidate on the rest
    is judged on the fold. Losses are sums, so the rest is the whole minus the
    fold and the pairs are read once.
    """
    return _held_out(_loss_cube(pairs, densities, group, folds, linear, **options), families)


def compared(pairs: DataFrame, densities: DataFrame, families: DataFrame, group: str, reference: str, folds: int = 5,
             linear: bool = True, observations: Column | None = None, **options) -> DataFrame:
    """Families by their fit to everything and by their held-out error, from one cube of losses.

    ``families`` has candidate, family and ``degrees`` (free parameters). The full fit is the
    family's best candidate on all pairs, with its MAE and MSE in points and the difference of
    Gaussian BIC to the family ``reference``, over ``observations`` independent pairs (by
    default the count of all pairs). Ranks count from 1, ties by name.
    """
    cells = _loss_cube(pairs, densities, group, folds, linear, **options)
    whole = cells.groupBy("candidate").agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("q").alias("q")).join(families, "candidate")
    loss = F.col("q") / F.col("w")
    fit = whole.groupBy("family").agg(F.min_by(F.struct("degrees", (100.0 * F.col("a") / F.col("w")).alias("mae"), (1e4 * loss).alias("mse")), F.struct(loss, "candidate")).alias("f"))
    fit = fit.select("family", "f.*")
    first = fit.where(F.col("family") == reference)
    n = pairs.agg(F.count(F.lit(1))).scalar() if observations is None else observations
    delta = n * F.ln(F.col("mse") / first.agg(F.max("mse")).scalar()) + (F.col("degrees") - first.agg(F.max("degrees")).scalar()) * F.ln(n)
    judged = _held_out(cells, families).withColumnsRenamed({"mae": "held_out_mae"})
    both = fit.withColumn("bic_delta", delta).join(judged, "family")
    # Families are a short list by design.
    place = lambda by: F.row_number().over(Window.orderBy(by, "family"))
    return both.withColumn("full_rank", place("mae")).withColumn("held_out_rank", place("held_out_mae"))


def resample_count(key: Column, resample: Column, seed: int) -> Column:
    """Poisson(1) count of a group in a resample, a fixed function of both."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), resample.cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("double") / float(1 << 28)
    out, chance, total = F.lit(7), math.exp(-1.0), 0.0
    steps = []
    for k in range(7):
        total += chance
        steps.append((k, total))
        chance /= k + 1
    for k, edge in reversed(steps):
        out = F.when(u < edge, F.lit(k)).otherwise(out)
    return out


def out_of_bag(pairs: DataFrame, densities: DataFrame, families: DataFrame, group: str, resamples: int = 20,
               seed: int = 20260809, linear: bool = True) -> DataFrame:
    """Paired out-of-bag error per family over resamples of whole groups.

    Each group's losses are summed once per candidate; a resample then weights
    groups by a hashed Poisson count and tests on those it left out. Every family
    sees the same resamples, so the gaps to the best are paired.
    """
    per_group = _gap_sums(read_pairs(pairs, densities, linear), [group, "candidate"])
    drawn = per_group.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    drawn = drawn.withColumn("k", resample_count(F.col(group), F.col("resample"), seed))
    out = F.col("k") == 0
    sums = drawn.groupBy("candidate", "resample").agg(
        (F.sum(F.col("k") * F.col("q")) / F.sum(F.col("k") * F.col("w"))).alias("train"),
        (100.0 * F.sum(F.when(out, F.col("a"))) / F.sum(F.when(out, F.col("w")))).alias("test"),
    ).where("train is not null and test is not null").join(families, "candidate")
    best = sums.groupBy("family", "resample").agg(F.min_by("test", F.struct("train", "candidate")).alias("error"))
    means = best.groupBy("family").agg(F.avg("error").alias("mean"))
    leader = means.agg(F.min_by("family", F.struct("mean", "family"))).scalar()
    lead = best.where(F.col("family") == leader).select("resample", F.col("error").alias("_lead"))
    return best.join(lead, "resample").groupBy("family").agg(
        F.avg("error").alias("mean"),
        F.avg(F.col("error") - F.col("_lead")).alias("gap"),
        F.avg((F.col("_lead") < F.col("error")).cast("double")).alias("leader_wins"),
        F.count("*").alias("resamples"),
    )
