import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["evaluate", "spearman", "kendall_tau_b", "average_raters", "per_bootstrap_scores", "group_kfold", "score_balanced_softmax", "topk_similar",
        "parse_response", "chunk_text", "strip_gold_blocks", "read_ratings", "metricwise_ensemble"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["scope", "lang", "metric", "stat", "value"]


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, con, name):
    from tools.check import rows_of, same

    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    assert sorted(df.columns) == sorted(columns) and len(got) == len(want)
    assert all(same(p, q) for a, b in zip(got, want) for p, q in zip(a, b))


def test_evidence_goes_behind_answers_of_many_lines(spark, con):
    name = "insert_evidence_after_gold_all"
    got = {tuple(r) for r in entry.queries()[name](spark, SF).select("doc_id", "digest").collect()}
    assert got == set(con.execute(entry.oracle_sql()[name]).fetchall())
    assert len(got) == con.execute("SELECT count(DISTINCT doc_id) FROM documents").fetchone()[0]
    assert len(got) > entry.queries()["insert_evidence_after_gold"](spark, SF).count()
