"""Every registered core query with SQL is held against it on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

from glintsieve.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    result = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted(tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(columns)) for r in frame.collect()) == expected


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_every_query_reads_the_given_tables(spark):
    """On a folder that does not exist no query can be built or run."""
    for name in sorted(QUERIES):
        with pytest.raises(Exception, match="(?i)path|not.found|exist"):
            QUERIES[name](spark, "/nowhere").count()


def test_findings_are_not_cut_at_larger_sizes(spark):
    """sf0.01 has more findings than the default budget of a scan."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    for name in ("g04_by_rule", "o01_report_order", "w05_finding_budget"):
        frame = QUERIES[name](spark, folder)
        result = con.execute(ORACLE_SQL[name])
        columns = sorted(d[0] for d in result.description)
        order = [[d[0] for d in result.description].index(c) for c in columns]
        expected = sorted(tuple(norm(r[k]) for k in order) for r in result.fetchall())
        assert sorted(tuple(norm(r[c]) for c in columns) for r in frame.collect()) == expected


def test_files_made_of_a_narrow_table_are_dealt_out(spark):
    """customer is read by one task; the files that are made of its rows are analysed by many."""
    from glintsieve.queries import registry

    keys = registry.customers(spark, SMALL)
    assert registry.table(spark, SMALL, "customer").rdd.getNumPartitions() == 1
    sizes = keys.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == registry.table(spark, SMALL, "customer").count() and len(sizes) == 8 and max(sizes) < sum(sizes) / 3


def test_lexical_queries_write_no_lines(spark, monkeypatch):
    """Queries of some columns work out these only, instead of a table of all lines with all columns."""
    from glintsieve.queries import registry

    def not_asked(*_):
        raise AssertionError("all lines are written")

    monkeypatch.setattr(registry, "kept", not_asked)
    assert QUERIES["g03_complete"](spark, SMALL).collect()[0].complete is True
    for name in ("t02_sources", "l06_comments", "a03_node_classes"):
        assert "path_call" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().analyzed().toString()
