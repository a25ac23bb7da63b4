"""Every query against its SQL on the smallest tables, and the driver's contract."""

import os

import duckdb
import pytest

from stacklore.errors import Validation
from stacklore.operators import topics
from stacklore.plans import catalogue

NAMES = sorted(catalogue.ENTRIES)


def plain(v):
    return None if v is None or v != v else v if isinstance(v, (str, bool)) else round(float(v), 6)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, smallest, name):
    rows = catalogue.queries()[name](spark, smallest)
    got = sorted(str([plain(r[c]) for c in sorted(rows.columns)]) for r in rows.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:  # then only that it gives rows, of the same columns each time
        assert got and rows.columns == catalogue.queries()[name](spark, smallest).columns
        return
    db = duckdb.connect()
    for t in os.listdir(smallest):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{smallest}/{t}'")
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(rows.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(str([plain(r[i]) for i in order]) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark)
    assert rows.columns == ["id", "rank"] and rows.count() == 20


def test_unknown_topic_is_an_error(spark):
    briefs = spark.createDataFrame([("a",)], ["topic_id"])
    with pytest.raises(Validation):
        topics.report_material(["a", "b"], briefs)
