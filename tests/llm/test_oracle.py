"""The registered SQL against the queries on a small table with odd rows (the driver compares them on whole tables)."""

import duckdb
import pytest

from lodestone.llm.catalog import ORACLE, QUERIES

from .test_llm import SCHEMA, TEXTS, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Odd texts with a repeated row, a source of failing documents and a null source."""
    path = tmp_path_factory.mktemp("oracle")
    rows = [(i, t, "en", ("b", "a", None)[i % 3], len(t or "")) for i, t in TEXTS]
    rows += [rows[0], *((200 + i, "spam ham " * 60, "en", "farm", 540) for i in range(40)), (300, prose(300, 70), "en", "farm", 9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["op4_suffix_dedup", "op6_substring_dedup", "op7_quality_rules", "op10_ngram_jaccard"])
def test_query_equals_sql(spark, folder, name):
    got = QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        found = con.execute(ORACLE[name])
        columns = [d[0] for d in found.description]
        want = found.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_jaccard_of_shared_and_null_ids_equals_sql(spark, tmp_path):
    """Two texts of one doc_id, each linked to other rows, and null ids that are copies or connect two documents."""
    words = prose(81, 200).split()
    step = [" ".join([f"x{i}" for i in range(k)] + words[k:]) for k in (0, 13, 25)]  # neighbours link, the ends do not
    other, alone = prose(82, 90), prose(83, 90)
    texts = [(5, step[0]), (None, step[1]), (4, step[2]), (7, other), (7, alone), (6, other), (8, alone + " end"), (None, other), (None, prose(84, 90)), (None, None), (9, None)]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_ngram_jaccard"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = con.execute(ORACLE["op10_ngram_jaccard"]).fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(want, key=key)
    assert {r[0]: r[2] for r in want if r[0] in (4, 5, 6, 8)} == {4: 4, 5: 4, 6: 6, 8: 7}
