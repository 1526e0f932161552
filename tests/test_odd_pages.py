"""Queries over pages with character references, against their SQL."""

import duckdb
import pytest

from tallyshelf.operators.pages import extract_images_breadcrumb_tags
from tallyshelf.plans import queries  # noqa: F401
from tallyshelf.plans.registry import ORACLE_SQL, QUERIES

HEADINGS = ["token = &quot;2a&quot;", "a &amp;&amp; b &amp", "x  y", "&#39;q&#39; &lt;b&gt;", "&nbsp;", ""]


@pytest.mark.parametrize("name", ["x1_page_fields", "x1_selected_fields"])
def test_character_references_as_in_sql(spark, tmp_path, name):
    page = '<html lang="en"><body><nav><ul><li><a href="/a?b=1&amp;c">a</a></li></ul></nav><article><h1>{}</h1></article></body></html>'
    spark.createDataFrame([(i, f"u{i}", page.format(h)) for i, h in enumerate(HEADINGS if name == "x1_page_fields" else HEADINGS[:2] + HEADINGS[3:])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_breadcrumbs_and_tags_are_plain_text(spark):
    crumbs = '<nav class="breadcrumb"><ol><a href="/"> Home </a><a><b>A</b> &amp; &quot;B&quot;</a><a><i></i></a></ol></nav>'
    page = f'<img src="m.jpg"><img src="n.jpg"><img src="m.jpg">{crumbs}<li class="highlight">x&nbsp;<b>y</b></li><li>other</li><li class="highlight">&lt;8 GB&gt;</li>'
    pages = spark.createDataFrame([(1, "u", page), (2, "v", "<p>none</p>"), (3, "w", None)], "page_id long, url string, html string")
    rows = [tuple(r)[2:] for r in extract_images_breadcrumb_tags(pages).orderBy("page_id").collect()]
    assert rows == [("m.jpg", ["m.jpg", "n.jpg"], ["Home", 'A & "B"'], ["x y", "<8 GB>"]), (None, [], [], []), (None, None, None, None)]
