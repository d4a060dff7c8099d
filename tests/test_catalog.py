"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import TABLES, canonical  # noqa: E402
from seqseg.plans.catalog import all_oracles, all_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_names():
    queries, oracles = all_queries(), all_oracles()
    assert set(oracles) == set(queries)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, database, name):
    df = all_queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name == "unknown_labels":
        assert rows  # the gap is chosen by name, so it is there at every size
    result = database.execute(all_oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(result.fetchall(), names)


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events of which two users have values of zero, and the database over them."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("zeros"), duckdb.connect()
    value = "CASE WHEN user_id IN (1, 2) AND event_id % 5 = 0 THEN 0 ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["score_bce", "score_boundary_composite", "score_smooth"])
def test_logits_of_zero(spark, zeros, name):
    folder, con = zeros
    result = con.execute(all_oracles()[name])
    df = all_queries()[name](spark, folder)
    expected = canonical(result.fetchall(), [d[0] for d in result.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == expected
    assert any("nan" in row for row in expected) == (name != "score_smooth")


ODD = {
    "no label": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type",
    "no value": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value",
    "nan": "CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS value",
    "below zero": "CASE WHEN event_id % 97 = 0 THEN -1.0 ELSE value END AS value",
}


@pytest.mark.parametrize("kind", ODD)
def test_boundary_scores_of_odd_events(spark, tmp_path, kind):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({ODD[kind]}) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("score_boundary_composite", "score_smooth", "score_bce"):
        result = con.execute(all_oracles()[name])
        df = all_queries()[name](spark, str(tmp_path))
        expected = canonical(result.fetchall(), [d[0] for d in result.description])
        assert canonical([tuple(r) for r in df.collect()], df.columns) == expected


def test_logarithm_by_ieee_rules(spark):
    from seqseg.functions import vectors as vx

    df = spark.createDataFrame([(0.0,), (-0.0,), (-1.0,), (1.0,), (None,)], "v double")
    found = [str(r[0]) for r in df.select(vx.log(df["v"])).collect()]
    assert found == ["-inf", "-inf", "nan", "0.0", "None"]
