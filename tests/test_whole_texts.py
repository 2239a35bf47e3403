"""Queries read texts to their end, as their SQL does, whatever the length."""

import duckdb

from lexmill import catalog
from lexmill.functions import texts as T
from lexmill.operators import html
from tests.test_rules import one


def both(spark, name, folder, *tables):
    """Rows of a query and of its SQL, columns in the SQL's order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    order = [x[0] for x in found.description]
    return sorted(map(tuple, catalog.queries()[name](spark, str(folder)).select(*order).collect())), sorted(found.fetchall())


def test_long_lines_of_pages_stay_whole(spark, tmp_path):
    """html_to_text."""
    line = "word  and \t word " * 3000 + "the last words"
    pages = [(1, "https://a.com/x", f"<p>{line}</p><p>&amp;  next </p>"), (2, "https://a.com/x", "x" * 20_000 + " y"), (3, "https://a.com/x", "é😀" * 30_000), (4, "https://a.com/x", " " * 50_000 + "z"), (5, "https://a.com/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, "html_to_text", tmp_path, "pages")
    assert got == want
    assert [r[-1] for r in got] == ["word and word " * 3000 + "the last words\n\n& next", "x" * 20_000 + " y", "é😀" * 30_000, "z", ""]
    assert one(spark, T.html_to_text, pages[1][2]) == pages[1][2]
    whole = {r.id: r.text for r in catalog.queries()["html_to_text_entities"](spark, str(tmp_path)).collect()}
    assert whole[1].endswith("the last words\n\n& next") and len(whole[3]) == 60_000


def test_pages_without_clean_text_are_read_whole(spark, tmp_path):
    """pick_text; every third page has no clean text."""
    line = "word  and \t word " * 3000 + "the last words"
    pages = [(3, "https://a.com/x", f"<p>{line}</p><p>&amp;  next </p>"), (4, "https://a.com/x", f"<p>{line}</p>"), (6, "https://a.com/x", "<td>" + "x y" * 10_000), (9, "https://a.com/x", "<br>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got, want = both(spark, "pick_text", tmp_path, "pages")
    assert got == want
    short = "word and word " * 3000 + "the last words"
    assert got == [(3, "body-fallback", short + "\n\n& next"), (4, "clean", line), (6, "body-fallback", "x y" * 10_000), (9, "body-fallback", "")]
    whole = {r.id: r.text for r in catalog.queries()["pick_text_entities"](spark, str(tmp_path)).collect()}
    assert whole == {k: x for k, _, x in got}
    df = spark.createDataFrame([(1, f"<p>{line}</p>", None)], "id long, body string, clean_text string")
    assert html.pick_text(df).first().text == short


FILLER = "Some plain words fill up this line well enough here. "
END = "At last: privacy notice, DMCA and GDPR, for the press. Please sign in to continue. Effective: March 5, 2024; last updated 2 Jan 2024 "
LATE = {"surface:privacy", "surface:ip", "framework:dmca", "framework:gdpr", "audience:publishers", "auth-wall:true", "effective:2024-03-05", "updated:2024-01-02"}


def documents(spark, folder, *texts):
    spark.createDataFrame([(12 * k + 11, "s", x) for k, x in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(folder / "documents.parquet"))


def test_tags_are_of_whole_texts(spark, tmp_path):
    """tag_documents_array; beginnings of 4,000, 8,000 and 12,000 characters hold none of what the end does."""
    documents(spark, tmp_path, FILLER * 300 + END, FILLER * 300, END, None, FILLER * 20_000 + END)
    got, want = both(spark, "tag_documents_array", tmp_path, "documents")
    assert got == want
    tags = [set(x.split("|")) for _, x in got]
    plain = {t for t in tags[1] if not t.startswith(("host:", "platform:", "doc:", "locale:", "region:"))}
    assert LATE <= tags[0] and LATE <= tags[2] and LATE <= tags[4] and not (LATE - {"surface:privacy", "surface:ip"}) & plain
    assert set(one(spark, lambda d, x: T.document_tags(d, "'https://a.com/'", x), FILLER * 300 + END)) >= LATE
    assert one(spark, T.policy_dates, FILLER * 300 + END) == ["effective:2024-03-05", "updated:2024-01-02"]


def test_dates_behind_long_runs_of_spaces(spark, tmp_path):
    """in whole texts runs of spaces may be of any length; a search that tries all ways to cut them in two does not end."""
    run = " \n\t" * 70_000
    documents(spark, tmp_path, "updated" + run + "x", "last" + run + "updated" + run + ":" + run + "2024-06-01", "effective" + run + "-5 March 2024", "updated:: 2024-06-01", "updated - : 2024-06-01", "updated-2024-06-01", "updated " * 50_000)
    got, want = both(spark, "tag_documents_array", tmp_path, "documents")
    assert got == want
    dates = [[t for t in x.split("|") if t.startswith(("effective:", "updated:"))] for _, x in got]
    assert dates == [[], ["updated:2024-06-01"], ["effective:2024-03-05"], [], [], ["updated:2024-06-01"], []]


def test_policy_tags_are_of_whole_texts(spark, tmp_path):
    """tag_documents_policy."""
    documents(spark, tmp_path, FILLER * 300 + END, FILLER * 300, END, None, FILLER * 20_000 + END)
    got, want = both(spark, "tag_documents_policy", tmp_path, "documents")
    assert got == want and len(got) == len(set(got))
    tags = [{t for k, t in got if k == 12 * n + 11} for n in range(5)]
    assert LATE <= tags[0] and LATE <= tags[2] and LATE <= tags[4] and not (LATE - {"surface:privacy", "surface:ip"}) & tags[1]
    beginnings, of_sql = both(spark, "tag_documents", tmp_path, "documents")  # its SQL reads beginnings
    assert beginnings == of_sql and set(beginnings) < set(got) and (11, "framework:gdpr") not in beginnings
