"""Slicing a hot key must never change an answer."""

import random

from pyspark.sql import functions as F

from rankmill.operators import hist, interp, rollup
from rankmill.operators.ordered import carried, numbered, running, sliced


def skewed(spark, rows=6000):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", float(rng.randrange(50)), i,
             float(rng.randrange(1, 9))) for i in range(rows)]
    return data, spark.createDataFrame(data, "k string, v double, id long, w double")


def test_hot_key_is_cut_even_inside_one_value(spark):
    rows = [("hot", 1.0, i) for i in range(4000)] + [("cold", 2.0, 9000)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = sliced(df, ["k"], ["v", "id"], slice_rows=256).groupBy("k", "__slice").count().collect()
    hot = [r["count"] for r in got if r["k"] == "hot"]
    assert len(hot) > 8 and max(hot) < 1000 and sum(hot) == 4000
    assert [r["count"] for r in got if r["k"] == "cold"] == [1]


def test_running_sum_matches_brute_force(spark):
    data, df = skewed(spark)
    got = running(df, ["k"], ["v", "id"], {"s": "w"}, before=True, totals={"t": "w"}, slice_rows=128).collect()
    want, totals = {}, {}
    for k, v, i, w in sorted(data, key=lambda r: (r[1], r[2])):
        want[i] = totals.get(k, 0.0)
        totals[k] = want[i] + w
    assert len(got) == len(data)
    assert all(r.s == want[r.id] and r.t == totals[r.k] for r in got)


def test_global_rank_is_a_permutation(spark):
    data, df = skewed(spark)
    got = rollup.ranked(df, "v", ["id"], slice_rows=200).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(data) + 1))
    assert [(-r.v, r.id) for r in got] == sorted((-v, i) for _, v, i, _ in data)


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0, i) for i in range(900)] + [("a", 1.0, 1000)], "k string, v double, id long")
    got = numbered(df, ["k"], ["v", "id"], "n", slice_rows=64).where("k is null").agg(F.max("n"), F.count("*")).first()
    assert tuple(got) == (900, 900)


def test_carried_matches_brute_force(spark):
    data, df = skewed(spark, 3000)
    seen = F.when(F.col("id") % 37 == 0, F.col("id"))
    got = {r.id: (r.lo, r.hi) for r in
           carried(df, ["k"], ["v", "id"], last={"lo": seen}, following={"hi": seen}, slice_rows=100).collect()}
    groups = {}
    for k, v, i, _ in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(k, []).append(i)
    for ids in groups.values():
        for n, i in enumerate(ids):
            lo = next((j for j in reversed(ids[: n + 1]) if j % 37 == 0), None)
            hi = next((j for j in ids[n + 1:] if j % 37 == 0), None)
            assert got[i] == (lo, hi)


def test_top_share_sliced_equals_plain(spark):
    _, df = skewed(spark)
    h = hist.histogram(df, ["k"], "id", F.col("w")).withColumn("id", F.col("id").cast("double"))
    levels = df.select("k", (F.col("id") + 0.5).alias("lev"))
    plain = hist.top_share(levels, h, ["k"], "lev", "id", bounded=True)
    cut = hist.top_share(levels, h, ["k"], "lev", "id", slice_rows=100)
    assert sorted(plain.collect()) == sorted(cut.collect())


def test_interpolation_is_held_at_ends_and_last_tie_wins(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 5.0, 1.0), ("a", 5.0, 2.0), ("a", 9.0, 3.0),
                                   ("b", 0.0, 0.0), ("b", 10.0, 100.0)], "k string, x double, y double")
    probes = spark.createDataFrame([("a", 5.0), ("b", 20.0), ("b", -5.0), ("b", 2.5)], "k string, at double")
    got = {(r.k, r.at): r.value for r in interp.asof_interpolate(probes, knots, ["k"], "at").collect()}
    assert got == {("a", 5.0): 2.0, ("b", 20.0): 100.0, ("b", -5.0): 0.0, ("b", 2.5): 25.0}
    off = {(r.k, r.at): r.value for r in interp.asof_interpolate(probes, knots, ["k"], "at", hold=False).collect()}
    assert off[("b", 20.0)] is None and off[("b", -5.0)] is None


def test_top_k_per_group_of_a_hot_key(spark):
    data, df = skewed(spark)
    got = rollup.top_k_per_group(df, ["k"], [F.desc("v"), F.col("id")], 3).collect()
    groups = {}
    for k, v, i, _ in data:
        groups.setdefault(k, []).append((-v, i))
    want = {(k, n + 1, i) for k, g in groups.items() for n, (_, i) in enumerate(sorted(g)[:3])}
    assert {(r.k, r.position, r.id) for r in got} == want


def test_milestones(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(1, 101)], "k string, id long, w double")
    got = {r.milestone: r.id for r in hist.milestones(df, ["k"], ["id"], "w", [0.1, 0.5, 1.0], "id", slice_rows=16).collect()}
    assert got == {0.1: 10, 0.5: 50, 1.0: 100}

def _frames(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_values_ahead_are_not_read_anew_for_every_row(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), i // 2, i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at int, id int, v int").repartition(5)
    for options in ({"bounded": True}, {"slice_rows": 40}, {}):
        got = carried(df, ["k"], ["at", "id"], last={"lo": "v"}, following={"hi": "v"}, **options)
        assert options.get("bounded") or "unboundedfollowing" not in _frames(got)
        for r in got.collect():
            ahead = sorted((q[1], q[2], q[3]) for q in rows if q[0] == r.k and (q[1], q[2]) > (r.at, r.id) and q[3] is not None)
            assert r.hi == (ahead[0][2] if ahead else None)
    # Rows that tie in the order see one another from one side only.
    tied = spark.createDataFrame([(1, 1, i) for i in range(9)], "k int, at int, v int")
    got = carried(tied, ["k"], ["at"], previous={"lo": "v"}, following={"hi": "v"}).collect()
    assert sorted(r.hi is None for r in got) == [False] * 8 + [True]
    assert {(r.v, r.hi) for r in got if r.hi is not None} == {(r.lo, r.v) for r in got if r.lo is not None}


def test_wrapped_names_look_ahead_in_one_pass(spark):
    from rankmill.functions import names

    rows = [("k", i, f"n{i} FOUNDATION", "School1" if i % 7 == 0 else " ") for i in range(60)]
    df = spark.createDataFrame(rows, "k string, at int, name string, line string")
    got = names.unwrapped(df, ["k"], ["at"], "name", "line", ["FOUNDATION"], ["1", "2"])
    assert "unboundedfollowing" not in _frames(got)
    assert {r.at: r["name"] for r in got.collect()} == {i: "School1" if i < 56 else f"n{i} FOUNDATION" for i in range(60)}


def test_crosswalk_reads_both_curves_in_one_pass(spark):
    probes = spark.createDataFrame([(1, i, i / 10) for i in range(40)], "k int, id int, at double")
    up = spark.createDataFrame([(1, float(x), x / 4) for x in range(5)], "k int, x double, y double")
    twice = up.withColumn("x", F.col("x") * 2)
    got = interp.crosswalk(probes, up, twice, ["k"], "at")
    assert "unboundedfollowing" not in _frames(got)
    assert all(abs(r.value - 2 * r.at) < 1e-9 for r in got.collect())
