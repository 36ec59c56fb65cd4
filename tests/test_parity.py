"""Every query against its SQL, and those without SQL for rows."""

import duckdb
import pytest
from parity import compare

from sondeo import registry, registry_flow, registry_models, registry_reports  # noqa: F401  (these add to the registry)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows or name == "q11_residual_names"
