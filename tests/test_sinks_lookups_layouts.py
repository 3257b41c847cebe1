"""Commit table of the incremental sink, measured lookups, sheet layouts and the model comparison."""

import math

import pytest
from pyspark.sql import functions as F

from rankmill.catalog import distributions
from rankmill.operators import lookup, models
from rankmill.session import scratch_path
from rankmill.sources import layouts
from rankmill.streaming import incremental


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_write_that_dies_is_not_seen(spark):
    path = scratch_path(spark, "sink")
    first = spark.createDataFrame([("007", 1), ("007", 2), ("b", 3), (None, 9)], "k string, v int")
    incremental.replace_by_key(first, path, "k")
    assert rows_of(incremental.current(spark, path)) == rows_of(first)
    second = spark.createDataFrame([("007", 5), ("c", 6)], "k string, v int")
    version, sizes = incremental.write_version(second, path, "k")  # and no commit
    assert rows_of(incremental.current(spark, path)) == rows_of(first)
    incremental.commit(spark, path, version, sizes)
    assert rows_of(incremental.current(spark, path)) == rows_of(spark.createDataFrame([("007", 5), ("c", 6), ("b", 3), (None, 9)], "k string, v int"))


def test_sources_are_skipped_by_key_or_content(spark):
    path = scratch_path(spark, "sink")
    held = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert rows_of(incremental.pending(held, spark, path, "k")) == rows_of(held)
    incremental.replace_by_key(held, path, "k")
    now = spark.createDataFrame([("a", 2), ("a", 1), ("b", 4), ("c", 5)], "k string, v int")
    assert rows_of(incremental.pending(now, spark, path, "k")) == [("c", 5)]
    assert rows_of(incremental.pending(now, spark, path, "k", by_content=True)) == [("b", 4), ("c", 5)]
    assert rows_of(incremental.pending(now, spark, path, "k", refresh=True)) == rows_of(now)
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "k string, v int")
    assert incremental.pending(twice, spark, path, "k", by_content=True).count() == 3


def test_files_follow_the_rows_of_a_key(spark):
    path = scratch_path(spark, "sink")
    df = spark.range(10_000).select(F.when(F.col("id") < 9000, "big").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), "id")
    version, _ = incremental.write_version(df.repartition(16), path, "k", rows_a_file=1500)
    files = spark.read.parquet(f"{path}/data/{version}").select("_key", F.col("_metadata.file_path").alias("f")).distinct().groupBy("_key").count()
    counts = {r["_key"]: r["count"] for r in files.collect()}
    assert counts.pop("big") in range(6, 13) and len(counts) == 20 and set(counts.values()) == {1}


def test_other_errors_of_a_sink_are_not_swallowed(spark):
    with pytest.raises(Exception, match="(?i)scheme"):
        incremental.pending(spark.range(1), spark, "nosuchscheme://x/y", "id")


@pytest.mark.parametrize("bounds", [{}, {"most_rows": 0}, {"most_bytes": 0}])
def test_lookups_agree_whatever_their_size(spark, bounds):
    rows = spark.range(5000).select((F.when(F.col("id") < 4500, 1).otherwise(F.col("id"))).alias("k"), "id")
    small = spark.createDataFrame([(1, "one"), (4700, "x"), (9, "none")], "k bigint, name string")
    for how in ("inner", "left"):
        got = lookup.looked_up(rows, small, ["k"], how, **bounds)
        assert rows_of(got) == rows_of(rows.join(small, "k", how))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan and "hashpartitioning" not in plan) if not bounds else "_salt" in got._jdf.queryExecution().toString()


def test_histogram_lookup_leaves_the_rows_in_place(spark, sf_dir):
    got = distributions.histogram_lookup(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_sheets_of_all_layouts(spark):
    known = {
        "totals": layouts.totals("total", "all", 75), "grades": layouts.grades("grade", "grade"), "marks": layouts.marks("mark", (0, 2)),
        "categories": layouts.categories("cat", r"^\d[A-C]"), "levels": layouts.levels("lev", r"^\d[A-C]", ["six"], 1)}
    cells = {
        "a-total": [["total", "n"], ["75", "1,000"], ["76", "5"], ["12", ""], []],
        "b-grade": [["1", "2"], ["grade", "", "X", "Y"], ["15", "", "3", "-"], ["14", "", "", "4"], ["grade", "Z"], ["13", "6"]],
        "c-mark": [["10.00", "7"], ["Art"], ["49.00 - 49.99", "2", "50", "1"], ["Music", ""], ["100", "3"]],
        "d-cat": [["5A", "10", "1.5%"], ["x"], ["1C", "2"]],
        "e-lev": [["5A", "4", "9", "40%"], ["5A", "4"]],
        "other": [["1", "2"]],
    }
    rows = [(name, i, row) for name, sheet in cells.items() for i, row in enumerate(sheet)]
    df = spark.createDataFrame(rows, "name string, row int, cells array<string>")
    got = {(r.layout, r.subject, r.label, r.score and round(r.score, 6), r.count_, r.share) for r in layouts.read_sheets(df, known).withColumnRenamed("count", "count_").collect()}
    assert got == {
        ("totals", "all", None, 75.0, 1000.0, None), ("grades", "X", None, 15.0, 3.0, None), ("grades", "Y", None, 14.0, 4.0, None),
        ("grades", "Z", None, 13.0, 6.0, None), ("marks", "Art", None, 49.495, 2.0, None), ("marks", "Art", None, 50.0, 1.0, None),
        ("marks", "Music", None, 100.0, 3.0, None), ("categories", None, "5A", None, 10.0, 1.5), ("levels", "six", "5A", None, 4.0, 40.0)}
    assert rows_of(layouts.unknown_sheets(df, known)) == [("other", 1)]


def test_full_fit_prefers_flexibility_and_bic_charges_for_it(spark):
    pairs = spark.createDataFrame([(f"g{i}", "A", "B", 0.3 + i / 100, 0.3 + i / 120, 1.0) for i in range(30)],
                                  "grp string, scale_a string, scale_b string, top_a double, top_b double, weight double")
    made = [("flat", s, [1.0, 1.0, 1.0]) for s in "AB"] + [("tilt", "A", [0.9, 1.0, 1.1]), ("tilt", "B", [1.0, 1.0, 1.0])]
    densities = spark.createDataFrame(made, "candidate string, scale string, values array<double>")
    families = spark.createDataFrame([("flat", "plain", 0), ("tilt", "bent", 3), ("flat", "bent", 3)], "candidate string, family string, degrees int")
    got = {r.family: r for r in models.compared(pairs, densities, families, "grp", "plain", 3).collect()}
    assert got["plain"].bic_delta == 0 and got["bent"].mse <= got["plain"].mse
    assert got["bent"].bic_delta == pytest.approx(30 * math.log(got["bent"].mse / got["plain"].mse) + 3 * math.log(30))
    assert sorted(r.full_rank for r in got.values()) == sorted(r.held_out_rank for r in got.values()) == [1, 2]
