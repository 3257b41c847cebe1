"""Run a registered query and its SQL twin on the same tables and compare them."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark, con, function, sql, sf_dir):
    """Empty string when both sides agree, else what differs."""
    frame = function(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    kinds = {c[0]: str(c[1]) for c in answer.description}
    want = answer.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(got)
    for name, kind in frame.dtypes:
        if TYPES.get(kind, kind).upper() != kinds[name].upper():
            return f"type of {name}: {kind} != {kinds[name]}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    left, right = _rows(frame.columns, got), _rows(names, want)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(got)
    return "", len(got)


def main(argv):
    from rankmill import catalog
    from rankmill.session import local_session

    sf_dir = argv[1]
    wanted = argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    queries, sql = catalog.queries(), catalog.oracle_sql()
    failed = []
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                text, rows = differences(spark, con, function, sql[name], sf_dir)
            else:
                rows, text = len(function(spark, sf_dir).collect()), ""
        except Exception as error:  # noqa: BLE001
            text, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        mark = "ok  " if not text else "FAIL"
        print(f"{mark} {name:<36} {rows:>7} rows {time.time() - start:6.2f}s {'' if name in sql else '(no sql)'} {text}",
              flush=True)
        if text:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
