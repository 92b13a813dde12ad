"""Every registered query of the library against its SQL in DuckDB, on small tables."""

import math

import duckdb
import pytest

from issuetime import registry

DIR = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v if isinstance(v, str | bool) else round(float(v), 5) + 0.0
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)


#: Queries that SQL can't express, tested in the other files: against plain Python or, for fitted trees, a plain loop over days and properties of what they give.
PLAIN = {
    "a49_path_summary", "l05_separated_cases", "l05_separated_nearest", "l07_filled_slots", "l11_hash_sample", "m04_ridge_heads", "m05_boosted_heads", "m06_logistic_change", "m07_change_chances", "m08_class_forest", "m09_hazards",
    "m10_leaf_distribution", "m13_quantile_forest", "m15_stacked_chances", "m16_isotonic_quality", "m16_isotonic_tails", "m23_back_trajectories", "m24_sampled_field", "m25_class_medians", "m26_session_regressor", "m27_log_linear", "m28_joint_extrema", "t07_stream_detector",
}


def test_every_query_without_sql_is_tested_elsewhere():
    assert set(QUERIES) - set(SQL) == PLAIN


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = rows(columns, cursor.fetchall())
    assert len(have) == len(want)
    assert all(close(x, y) for a, b in zip(have, want, strict=True) for x, y in zip(a, b, strict=True))
