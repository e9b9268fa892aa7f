"""The driver's contract: entry, and some queries against their SQL on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"jaccard_dedup_pairs", "op1_source_mix", "op5_line_dedup"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("hidden", ["zstandard", "evigrid.llm", "corpus_pipeline"])
def test_what_is_missing_leaves_out_its_own_queries_only(hidden):
    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r}:
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names = set(entry.queries())
assert "doc_normalise" in names and "fact_audit" in names and not any(n.startswith("op1") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)), timeout=120)


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def against_sql(spark, folder, name, **tables):
    """The query's rows over the given tables (name to SQL) and those of its SQL."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = c.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    want = sorted(tuple(plain(v) for v in r) for r in found.fetchall())
    return sorted(tuple(plain(v) for v in r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()), want


def test_spam_filter_ends_words_as_its_sql_does(spark, tmp_path):
    pages = """SELECT i::BIGINT AS page_id, 'http://a.example.net/' || i AS url, '<p>' || chr(160) || repeat('mot ', 148 + i % 3) || ['action', 'étioné', 'Tionè', 'action_a', 'action cooKie', 'action ſubscribe', 'action' || chr(8195)][i % 7 + 1] || '</p>' AS html FROM range(42) t(i)"""
    got, want = against_sql(spark, tmp_path, "spam_filter", pages=pages)
    assert got == want and {r[1] for r in want} == {"True", "False"}
