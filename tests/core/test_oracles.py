"""Every query against its SQL over the smallest tables."""

import datetime

import pytest

duckdb = pytest.importorskip("duckdb")

from weftline.plans import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
#: Queries over pages and short texts, whose larger tables hold cases that the smallest do not.
AGAIN = "wiki_text_strip wiki_search wiki_link_extract link_extract title_extract edge_list node_count pagerank_1 pagerank_converged tweet_csv_parse tweet_csv_source lexicon_classify lexicon_source clean_text_handles nb_classify_documents stored_substring stored_top_30 knn_all wiki_dump_pages event_runs ordered_sink".split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    found = {}
    for sf in (SF, MORE):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return found


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name, sf", [(n, SF) for n in sorted(catalog.ORACLES)] + [(n, MORE) for n in AGAIN])
def test_query(spark, sql, name, sf):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = sql[sf].execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
    ranked = catalog.ENTRY(spark, SF).collect()
    assert ranked and [r.score for r in ranked] == sorted((r.score for r in ranked), reverse=True)
