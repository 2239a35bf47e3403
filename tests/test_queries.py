"""Every query with SQL gives its rows; the others run and give rows."""

import pytest

from lexmill import catalog
from tests.oracle import rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    assert rows(spark, catalog.queries()[name], SF) == sql_rows(catalog.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"near_duplicates", "clean_chunk_tag"}))
def test_runs(spark, name):
    assert rows(spark, catalog.queries()[name], SF)[1]


def test_whole_texts_are_read(spark, tmp_path):
    filler = "Some plain words fill up this sentence well enough here. " * 20
    text = filler + "The end of privacy policy, personal data, data retention and cookie rules. Sign in"
    spark.createDataFrame([(1, "s", text), (2, "s", filler), (3, "s", None)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.near for r in run("within_window_whole")] == [True, False, False]
    assert [r.near for r in run("within_window")] == [True, False, False]
    whole = run("classify")
    assert len(text) > 1000 and whole[0].confidence > whole[1].confidence and run("classify_whole") == whole
    menuish = [(r.k, r.menuish) for r in run("is_menuish_sentences") if r.doc_id == 1]
    assert sorted(menuish)[-1] == (22, True) and not any(m for k, m in menuish if 0 < k < 21)
    assert sorted(r.k for r in run("signal_score_sentences") if r.doc_id == 1) == list(range(23))
