"""Every registered query of the engine itself against its SQL."""

import duckdb
import pytest

from fathom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _values(frame, columns):
    return sorted(tuple("None" if v is None or v != v else v if isinstance(v, str) else repr(float(v) + 0.0) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, name):
    if name in ("coef_table_cluster",):
        sf = sf.replace("0.001", "0.01")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, wanted = registry.QUERIES[name](spark, sf).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _values(got, sorted(got.columns)) == _values(wanted, sorted(got.columns))
