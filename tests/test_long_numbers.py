"""Queries on keys of six digits, which the catalogue's raw codes and addresses cut to five."""

import duckdb
import pytest

from catalogkit.plans.queries import ORACLE_SQL, QUERIES
from test_queries import SF, canonical


@pytest.fixture(scope="module")
def long_keys(tmp_path_factory):
    at, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    for name, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        # every other key has six digits, and five of these are one when cut
        con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {key} % 2 = 1 THEN 100000 + {key} ELSE {key} END AS {key}) FROM '{SF}/{name}.parquet') TO '{at}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", ["curated_ranking", "url_candidates"])
def test_query_equals_its_oracle_on_long_keys(spark, long_keys, name):
    at, con = long_keys
    assert canonical(QUERIES[name](spark, at).toPandas()) == canonical(con.execute(ORACLE_SQL[name]).df())
