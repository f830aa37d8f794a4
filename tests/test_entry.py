"""The entry module, and queries against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomgraph.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIGHT = ["f1_clean_text", "f3_fixed_chunks", "f5_word_chunks", "f20_concept_words", "e1_all_patterns", "a6_p2_weighted_edges", "j6_c13_contradictions_all", "c1_components", "c2_simple_paths", "c12_w4_gaps", "c8_pagerank", "j8_similar_pairs", "c24_w12_search", "u6_split"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    ref = duck.execute(ORACLES[name])
    names = [c[0] for c in ref.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(ref.fetchall(), names)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) > 90
