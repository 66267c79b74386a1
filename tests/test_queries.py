"""Every registered query against the SQL that gives the same rows."""

import pytest

from quire.plans.catalogue import QUERIES, SQL


def rows(frame):
    return sorted(tuple(sorted((k, None if v != v else v) for k, v in r.items())) for r in frame)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    ours = QUERIES[name](spark, sf)
    got = [r.asDict(recursive=True) for r in ours.collect()]
    assert len(got) > 0 or name == "retry_giveup"
    if name in SQL:
        cursor = duck.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
        assert sorted(columns) == sorted(ours.columns)
        key = lambda r: str(sorted(r.items()))
        assert sorted(got, key=key) == sorted(want, key=key)


def test_entry_works_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("quire.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quire.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50


ODD_PAGES = [
    (1, "http://a.example/1", '<title>token = &quot</title><h1>token = &quot</h1><div class="ad">x &copy</div><a href="/1">1</a>'),  # cut within a reference
    (2, "http://a.example/2", "<title>a &lt; &l &am &amp &amp;quot; &eacute; &#233; &middot;</title><h1>&gt b&ampc &</h1>"),
    (3, "http://a.example/3", None),
    (4, "a.example", ""),
    (5, "http://a.example/5", '<nav><a href="/1">1</a></nav><p><a href="/2">2</a></p><p><a href="/3?a=1&amp;b=2&quot">3</a></p>'),
]


@pytest.mark.parametrize("name", ["page_title", "parser_elements"])
def test_odd_pages(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(ODD_PAGES, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    ours = QUERIES[name](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(ours.columns)} FROM ({SQL[name]}) ORDER BY page_id").fetchall()
    assert [tuple(r) for r in ours.orderBy("page_id").collect()] == want
