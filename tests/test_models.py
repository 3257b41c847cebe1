"""Densities, noisy bars and eligible groups against numpy and planted truth."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.functions import normal
from rankmill.operators import atoms, latent, models

ND = NormalDist()
SCHOOLS = [-0.6, -0.2, 0.0, 0.4, 1.1, 1.9]


def test_density_readings_invert_their_own_tail(spark):
    values = [0.4, 1.6, 0.9, 1.1]
    fine = np.linspace(0, 1, 300001)
    dens = np.interp(fine, np.linspace(0, 1, 4), values)
    total = np.trapezoid(dens, fine)
    tops = [0.0, 0.02, 0.3, 0.5, 0.77, 1.0]
    tail = 1 - np.concatenate([[0], np.cumsum((dens[1:] + dens[:-1]) / 2 * np.diff(fine))]) / total
    table = spark.createDataFrame([(1, [float(v / total) for v in values])], "k int, values array<double>")
    side = models.with_above(table, True)
    rows = spark.createDataFrame([(1, t) for t in tops], "k int, t double").join(side, "k")
    got = {r.t: r.level for r in rows.withColumn("level", models.level_linear(F.col("t"), F.col("values"), F.col("above"))).collect()}
    for t in tops:
        assert got[t] == pytest.approx(np.interp(t, tail[::-1], fine[::-1]), abs=2e-4)


def test_planted_density_wins(spark):
    truth = {"a": [1.0, 1.0, 1.0], "b": [0.45, 0.9, 1.75]}
    other = {"flat": {"a": [1.0] * 3, "b": [1.0] * 3}, "wrong": {"a": [1.0] * 3, "b": [1.75, 0.9, 0.45]}}
    rows = [("truth", s, v) for s, v in truth.items()] + [(c, s, v) for c, d in other.items() for s, v in d.items()]
    densities = spark.createDataFrame(rows, "candidate string, scale string, values array<double>")

    def tail(level, v):
        fine = np.linspace(level, 1, 2001)
        return float(np.trapezoid(np.interp(fine, [0, .5, 1], v), fine))

    obs = [(g, "a", tail(l, truth["a"]), "b", tail(l, truth["b"]), 1.0 + g % 5) for g, l in enumerate(np.linspace(.05, .95, 60))]
    pairs = spark.createDataFrame(obs, "grp int, scale_a string, top_a double, scale_b string, top_b double, weight double")
    got = {r.candidate: r.loss for r in models.score(pairs, densities).collect()}
    assert min(got, key=got.get) == "truth" and got["truth"] < 1e-6
    families = spark.createDataFrame([("truth", "right"), ("flat", "none"), ("wrong", "none")], "candidate string, family string")
    held = {r.family: r.mae for r in models.held_out(pairs, densities, families, "grp", 4).collect()}
    assert held["right"] < 0.1 < held["none"]
    bag = {r.family: (r.gap, r.leader_wins) for r in models.out_of_bag(pairs, densities, families, "grp", 8).collect()}
    assert bag["right"] == (0.0, 0.0) and bag["none"][0] > 0 and bag["none"][1] == 1.0


def test_folds_are_balanced(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.uniform(1, 10)) for i in range(200)], "g int, w double")
    sums = [r.s for r in models.balanced_folds(df, "g", "w", 5, slice_rows=32).groupBy("fold").agg(F.sum("w").alias("s")).collect()]
    assert len(sums) == 5 and max(sums) - min(sums) < 10


def test_unimodal(spark):
    cases = {(1.0, 2.0, 1.0): True, (3.0, 2.0, 1.0): True, (1.0, 2.0, 3.0): True, (2.0, 1.0, 2.0): False, (1.0, 1.0, 1.0): True}
    df = spark.createDataFrame([(list(k),) for k in cases], "v array<double>")
    assert {tuple(r.v): r.u for r in df.select("v", models.unimodal(F.col("v")).alias("u")).collect()} == cases


BAR = "id int, scale string, top double, score double, gates array<double>"


def test_sharp_reader_agrees_with_the_density(spark):
    tops = [.05, .2, .5, .8]
    df = spark.createDataFrame([(i, "a", t, None, None) for i, t in enumerate(tops)], BAR)
    read = lambda load: [r.level for r in latent.noisy_levels(df, {"a": [1.0] * 3}, F.lit(load), F.lit(.8)).orderBy("id").collect()]
    sharp, noisy = read(.999), read(.8)
    assert sharp == pytest.approx([1 - t for t in tops], abs=5e-3)
    assert all(abs(n - .5) <= abs(.5 - t) + 1e-9 for n, t in zip(noisy, tops))


def test_gates_lift_a_rank_bar(spark):
    rows = [(1, "a", None, 0.5, []), (2, "a", None, 0.5, [0.1, 0.1]), (3, "a", .3, None, None), (4, "z", .3, None, None), (5, "a", None, None, None)]
    df = spark.createDataFrame(rows, BAR)
    got = {r.id: r.level for r in latent.noisy_levels(df, {"a": [1.0, 1.0]}, F.lit(.9), F.lit(.8)).collect()}
    assert got[2] > got[1] and got[3] == pytest.approx(.7, abs=.06) and got[4] is None and got[5] is None


def test_noisy_levels_equal_numerical_integration(spark):
    """A fine sum over abilities, for a bar by share and a bar by rank behind a gate."""
    import numpy as np
    density, load, rank = [0.5, 1.0, 1.5], .9, .8
    x = np.linspace(-8, 8, 16001)
    cdf = np.array([ND.cdf(v) for v in x])
    base = np.interp(cdf, [0, .5, 1], density) * np.exp(-x * x / 2)
    above = lambda bar: np.array([1 - ND.cdf(v) for v in (bar - load * x) / (1 - load**2) ** .5])

    def bar_of(top):
        low, high = -6.0, 6.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if (base * above(mid)).sum() / base.sum() > top else (low, mid)
        return low

    at = lambda bar, l: base * np.exp(-((bar - l * x) / (1 - l * l) ** .5) ** 2 / 2)
    one = at(bar_of(.2), load)
    two = at(.4, rank) * above(bar_of(.3))
    want = [ND.cdf((w * x).sum() / w.sum()) for w in (one, two)]
    df = spark.createDataFrame([(1, "a", .2, None, None), (2, "a", None, .4, [.3])], BAR)
    got = [r.level for r in latent.noisy_levels(df, {"a": density}, F.lit(load), F.lit(rank)).orderBy("id").collect()]
    assert got == pytest.approx(want, abs=2e-3)


def test_planted_trait_correlation(spark):
    marks, grades = ("A", "B", "C"), {m: m for m in "ABC"}
    points = {"A": 3, "B": 2, "C": 1}
    share = spark.createDataFrame([(s, m, p) for s in "xyz" for m, p in zip(marks, (.25, .45, .3))], "subject string, mark string, share double")
    table = latent.score_table(latent.mark_chances(share, marks, [0.7], 30), list("xyz"), points, grades)
    assert table.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    category = latent.category_text([F.col("n_A"), F.col("n_B")], "ABC", 3)
    seen = table.groupBy(category.alias("category")).agg((F.sum("share") * 1e6).alias("count"))
    rho, error = latent.fit_correlation(share, seen, marks, points, grades, "ABC", list("xyz"), 3, 7, 30)
    assert rho == pytest.approx(.7, abs=.03) and error < 500


def atom_frame(spark, means, size=300):
    return spark.createDataFrame([(float(m), size) for m in means], "mean double, size int")


def bars(spark, *rows):
    return spark.createDataFrame([(i, r, list(g), float(w), 1) for i, (r, g, w) in enumerate(rows)],
                                 "id int, rank double, gates array<double>, wanted double, year int")


def test_one_atom_averages_its_own_top_slice(spark):
    got = atoms.eligible_mean(bars(spark, (.05, [], 0)), atom_frame(spark, [0.0]), "rank", "gates").first().reading
    assert got == pytest.approx(.75 * ND.pdf(ND.inv_cdf(.95)) / .05, abs=.01)


def test_bars_only_push_one_way(spark):
    rows = bars(spark, (.5, [], 0), (.5, [.12], 0), (.5, [.12, .12], 0), (.05, [], 0), (.03, [.25] * 4, 0), (.03, [.12] * 4, 0), (None, [.3], 0))
    got = {r.id: r.reading for r in atoms.eligible_mean(rows, atom_frame(spark, SCHOOLS), "rank", "gates").collect()}
    assert got[0] < got[1] < got[2] and got[3] > got[0] and got[5] > got[4] and got[6] is not None


def test_a_small_atom_cannot_fill_a_strict_bar(spark):
    none = atoms.eligible_mean(bars(spark, (.01, [], 0)), atom_frame(spark, [0.0], 60), "rank", "gates").first().reading
    some = atoms.eligible_mean(bars(spark, (.01, [], 0)), atom_frame(spark, [0.0], 300), "rank", "gates").first().reading
    assert none is None and some is not None


def test_gate_wall_sits_between_product_and_least(spark):
    tops = [.181, .141, .11, .14]
    share = float((atoms._passing(tops, .9) * normal.np_pdf(atoms.LEVEL) * atoms.STEP).sum())
    assert np.prod(tops) < share < min(tops)


def test_a_served_row_leaves_less(spark):
    rows = bars(spark, (.01, [], 4000), (.20, [], 20))
    alone = atoms.eligible_mean(rows, atom_frame(spark, SCHOOLS), "rank", "gates").where("id = 1").first().reading
    swept = {r.id: r.reading for r in atoms.depleting_sweep(rows, atom_frame(spark, SCHOOLS), "year", "id", "rank", "gates", "wanted", 200_000.0).collect()}
    assert swept[1] < alone


def test_margin_laws(spark):
    rng = np.random.default_rng(14)
    few = [(i, float(rng.uniform(.02, .9)), float(rng.normal(0, 1)), float(rng.integers(5, 400))) for i in range(60)]
    free = [(100 + i, float(rng.uniform(.1, .9)), None, float(rng.integers(5, 2000))) for i in range(60)]
    more = [(200 + i, r, g, w * 2) for i, (_, r, g, w) in enumerate(free)]
    df = spark.createDataFrame(few + free + more, "id int, rank double, gate double, wanted double")
    frame = atom_frame(spark, SCHOOLS)
    mean = {r.id: r.reading for r in atoms.qualifying_mean(df, frame, "id", "rank", "gate").collect()}
    edge = {r.id: r.reading for r in atoms.marginal_level(df, frame, "id", "rank", "gate", "wanted", 200_000.0).collect()}
    assert all(edge[i] <= mean[i] + 1e-6 for i in range(60))
    assert all(edge[200 + i] >= edge[100 + i] - 1e-6 for i in range(60))


def test_noise_summary_reads_rank_bars_and_gates(spark, sf_dir):
    from rankmill.catalog import modelling

    got = modelling.noise_summary(spark, sf_dir).first()
    bars = modelling.noisy_bars(spark, sf_dir)
    bars = latent.noisy_levels(bars, modelling.READER, F.lit(0.999), F.lit(0.999), "exact")
    rows = latent.noisy_levels(bars, modelling.READER, F.lit(0.9), F.lit(0.8), "noisy").toPandas()
    rows["shift"] = 100 * (rows["noisy"] - rows["exact"]).abs()
    assert rows["shift"].notna().all() and (rows["bucket"] == "R").any()
    spans = rows.groupby("grp").agg(n=("shift", "size"), w=("weight", "sum"), e=("exact", np.ptp), o=("noisy", np.ptp))
    spans = spans[spans["n"] > 1]
    want = [rows["shift"].mean(), rows["shift"].max(), *(100 * spans[c].mean() for c in "eo")]  # each group counts alike
    assert list(got) == pytest.approx(want, abs=1e-3)


def test_levels_behind_bars_move_one_row_a_bar(spark):
    bars = spark.createDataFrame([(("k", i), "a", i / 10, 0.9, [(0.1, 0.8), (-0.2, 0.7)][: i % 3]) for i in range(6)],
                                 "key struct<n:string,i:int>, scale string, bar double, loading double, gates array<struct<bar:double,loading:double>>")
    got = latent._posterior(bars, {"a": [0.5, 1.0, 1.5]}, 96)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    at, weight = latent.nodes_of(96)
    for r in got.collect():
        i = r.key.i
        ability = 0.9 * i / 10 + np.sqrt(1 - 0.81) * at
        mass = weight * (0.5 + latent.normal.np_cdf(ability))
        for bar, load in [(0.1, 0.8), (-0.2, 0.7)][: i % 3]:
            mass = mass * latent.normal.np_sf((bar - load * ability) / np.sqrt(1 - load**2))
        assert abs(r.level - latent.normal.np_cdf((mass * ability).sum() / mass.sum())) < 1e-12
