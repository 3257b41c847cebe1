"""Panel steps on entities move their cells once (findings F11, F12 and F14 of round 3)."""

from pyspark.sql import functions as F

from rankmill.plans import panel
from rankmill.session import cut_lineage

ROW = "grp string, sub string, year int, route string, weight double, score double, label string, source string"
RULES = panel.PanelRules(quota_routes=("a",), capacity_route="a", return_order=("b",), complete_years={"b": (1, 2)})


def seats(spark):
    rows = [("g", s, y, r, 1.0, v, f"l{y}", n) for s, y, r, v, n in (
        ("p", 1, "a", 5.0, "old"), ("p", 4, "b", None, "new"), ("p", 4, "b", None, "also"), ("q", 2, "b", 7.0, None), ("p", 2, None, 1.0, "x"))]
    return spark.createDataFrame([*rows, (None, "n", 1, "a", 1.0, 2.0, "l", "s")], ROW)


def moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_cells_move_once_from_entity_to_own_means(spark):
    rows = seats(spark)
    cells = cut_lineage(panel.observed_cells(rows.where("score is not null"), rows))
    dense = panel.densify(cells, rows, RULES)
    assert moves(panel.fill_own_series(dense)) == 1
    got = {(r.sub, r.year, r.route): (r.weight, r.weight_method) for r in dense.collect()}
    # Cells with a null in their key are none of the grid; no source covers a group without a name.
    assert got == {("p", 1, "a"): (1.0, "observed"), ("p", 2, "a"): (None, ""), ("p", 3, "a"): (None, ""), ("p", 4, "a"): (None, ""),
                   ("p", 1, "b"): (0.0, "structural_zero"), ("p", 2, "b"): (0.0, "structural_zero"), ("p", 3, "b"): (None, ""),
                   ("p", 4, "b"): (2.0, "observed"), ("q", 2, "b"): (1.0, "observed"), ("n", 1, "a"): (None, "")}


def test_fallbacks_write_the_cells_once(spark, monkeypatch):
    cells = cut_lineage(panel.fill_own_series(panel.densify(cut_lineage(panel.observed_cells(
        seats(spark).where("score is not null"), seats(spark))), seats(spark), RULES)))
    written, write = [], panel.cut_lineage
    monkeypatch.setattr(panel, "cut_lineage", lambda df: written.append(df.columns) or write(df))
    got = {(r.sub, r.year, r.route): (r.ability, r.ability_method) for r in panel.fill_fallbacks(cells).collect()}
    assert sum("weight_method" in columns for columns in written) == 1
    assert got["p", 3, "a"] == (5.0, "nearest:1") and got["p", 4, "b"] == (5.0, "department_year")
    assert got["p", 1, "b"] == (5.0, "department_year") and got["n", 1, "a"][1] == "route_year"


def test_output_rows_meet_one_row_an_entity(spark):
    rows = seats(spark).where("grp is not null and route is not null")
    cells = spark.createDataFrame([("g", s, y, "a", 1.0, 2.0, "", 1.0, "", 1) for s, y in (("p", 1), ("p", 2), ("p", 3), ("p", 4), ("q", 2), (None, 1))],
        "grp string, sub string, year int, route string, weight double, ability double, weight_method string, weight_scale double, ability_method string, input_rows int")
    out = panel.output_rows(cells, rows)
    assert moves(out) <= 2
    got = {(r.sub, r.year): (r.year_name, r.label) for r in out.collect()}
    assert got == {("p", 1): ("old", "l4"), ("p", 2): ("old", "l4"), ("p", 3): ("also | new", "l4"), ("p", 4): ("also | new", "l4"), ("q", 2): ("", "l2")}


def test_ranking_writes_only_what_it_reads(spark, monkeypatch):
    cells = spark.createDataFrame([("g", "p", 1, "a", 1.0, 2.0, "m"), ("h", "p", 1, "a", 1.0, 3.0, "m")],
        "grp string, sub string, year int, route string, weight double, ability double, weight_method string")
    written, write = [], panel.cut_lineage
    monkeypatch.setattr(panel, "cut_lineage", lambda df: written.append(df.columns) or write(df))
    direct = cells.groupBy("grp").agg(F.max("ability").alias("top"))
    assert [r.grp for r in panel.rank_entities(cells, direct, ["grp"]).orderBy("rank").collect()] == ["h", "g"]
    assert sorted(written[0]) == ["ability", "grp", "route", "weight", "year"]
