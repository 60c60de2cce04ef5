"""Catalog queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from scribegauge import catalog, catalog_more

QUERIES, ORACLE_SQL = catalog.QUERIES | catalog_more.QUERIES, catalog.ORACLE_SQL | catalog_more.ORACLE_SQL

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    return "" if value is None else str(round(float(value), 6)) if isinstance(value, (int, float)) else str(value)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize(
    "name", ["scores_grouping_sets", "scores_by_type", "normalized_documents", "wer_by_role", "detected_terms", "slot_values", "annotation_violations", "bootstrap", *catalog_more.QUERIES]
)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(n) for n in names]
    frame = QUERIES[name](spark, str(DATA)).select(*names)
    assert sorted(tuple(map(plain, r)) for r in frame.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
