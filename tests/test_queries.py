"""Every registered query of the library against its DuckDB SQL, at sf0.001 or as far as the tables are there."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tessera import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, data):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple("nan" if isinstance(r[k], float) and math.isnan(r[k]) else r[k] for k in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_repeats(spark, name):
    first = sorted(map(repr, catalogue.QUERIES[name](spark, FOLDER).collect()))
    assert first and first == sorted(map(repr, catalogue.QUERIES[name](spark, FOLDER).collect()))


def test_heading_of_copied_events(spark, tmp_path):
    """With every event six times the filters cancel at the series' ends, where only rounding is left of the velocity."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + 10000000 * r AS event_id, ts, user_id, event_type, value, props FROM '{FOLDER}/events.parquet', range(6) AS q(r)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalogue.QUERIES["heading_angle"](spark, str(tmp_path))
    want = con.execute(catalogue.ORACLES["heading_angle"])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_flagship():
    assert catalogue.FLAGSHIP in catalogue.ORACLES
