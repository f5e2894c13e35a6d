"""Each registered query against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(r) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = catalogue.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry_has_a_query_for_each_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_structured_documents_are_whole(spark, sf_dir):
    made = {r.doc_id: r.text for r in catalogue._made_whole(catalogue._read(spark, sf_dir, "documents")).collect()}
    for r in catalogue._read(spark, sf_dir, "documents").collect():
        half = len(r.text) // 2
        assert r.text[:half] in made[r.doc_id] and r.text[half:] in made[r.doc_id]
    # Sections, articles and lists over the size limit are split.
    rows = catalogue.queries()["chunk_all"](spark, sf_dir).collect()
    for kind in (1, 2, 3):
        of = [r for r in rows if r.doc_id % 4 == kind]
        assert max(sum(len(x.content) for x in of if x.doc_id == d) for d in {x.doc_id for x in of}) > 1000
