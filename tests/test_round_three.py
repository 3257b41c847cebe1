"""What the findings of round 3 asked for: work that does not grow with the rounds or the steps."""

import random

import pytest
from pyspark.sql import functions as F

from rankmill.operators import tiling

NAMES = dict(year="year", group="grp", subgroup="sub", route="route", scale="scale", weight="weight")


def bars(spark, count=600):
    rng = random.Random(11)
    rows = []
    for i in range(count):
        sub = rng.randrange(12)
        # The scales share bars, so scores tie across them; some subgroups have rows without a bar.
        top = None if sub < 2 and i % 3 == 0 else rng.choice((.1, .25, .4, .7, .85))
        rows.append((f"r{i:04}", 2000 + i % 2, f"g{sub % 3}", f"s{sub}", rng.choice("FO"), rng.choice("AB"), top, float(rng.randint(1, 9))))
    return spark.createDataFrame(rows, "id string, year int, grp string, sub string, route string, scale string, top double, weight double")


def test_summed_bars_have_the_points_of_their_rows(spark):
    df = bars(spark)
    totals = df.groupBy("year", "route").agg((F.sum("weight") * 1.5).alias("total")).where("route = 'F'")
    cells, plain = tiling.gathered(df, **NAMES, bar="top", unique="id")
    assert cells.count() < df.count() / 2
    # Levels of which some tie across scales, and some do not.
    level = F.when(F.col("scale") == "A", 1 - F.col("top")).otherwise(F.when(F.col("top") < .5, 1 - F.col("top")).otherwise(1 - F.col("top") ** 2))
    placed = tiling.place(df.withColumn("lev", level), totals, level="lev", **NAMES)
    tiled = tiling.tile(placed, ["year"], "score", ["id"], "placed_weight").where("top is not null")
    want = {(r.year, r.scale, r.x): (r.y, r.w) for r in tiling.pooled(tiled, ["year", "scale"], "top", "level", "placed_weight").collect()}
    placed = tiling.place(cells.withColumn("lev", level), totals, level="lev", **NAMES)
    names = {k: v for k, v in NAMES.items() if k != "subgroup"}
    got = {(r.year, r.scale, r.x): (r.y, r.w) for r in tiling.tiled_points(placed, plain, None, **names, bar="top", unique="id").collect()}
    assert len(want) == 20 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_rounds_place_bars_not_rows(spark, monkeypatch):
    df, placed = bars(spark), []
    whole = tiling.place
    monkeypatch.setattr(tiling, "place", lambda rows, *rest, **more: placed.append(rows.count()) or whole(rows, *rest, **more))
    _, levels, _ = tiling.fixed_point(df, None, None, rounds=2)
    assert levels.count() == 600 and max(placed) < 300


def test_weights_that_are_not_positive_keep_their_rows(spark):
    df = bars(spark, 60).withColumn("weight", F.when(F.col("id") == "r0003", 0.0).otherwise(F.col("weight")))
    cells, plain = tiling.gathered(df, **NAMES, bar="top", unique="id")
    assert cells.where("year = 2001").count() == 30 and plain.where("year = 2001").isEmpty()
