from pyspark.sql import functions as F

from tallyrail.llm import lines


def test_drops_only_what_exceeds_the_ratio(spark):
    rows = [(k, "http://A.example/x?y", f"<p>own {k}</p><div>menu</div><p>menu</p>") for k in range(20)]
    rows += [(20 + k, "http://b.example", f"<li>menu</li>b{k}<script>x<p>y</script>") for k in range(4)]
    rows += [(30, None, None), (31, "nohost", ""), (32, "http://a.example", "<p>menu</p><!-- <p>own 1</p> -->")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").selectExpr("*", "1 AS row", "2 AS lines", "3 AS boilerplate")
    got = {r.row.page_id: r for r in lines.drop_boilerplate(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).collect()}
    assert len(got) == len(rows)
    assert got[3].host == "a.example" and got[3].lines == ["own 3", "menu", "menu"] and got[3].kept == ["own 3"]
    assert (got[3].row.host, got[3].row.row, got[3].row.lines, got[3].row.boilerplate) == ("x", 1, 2, 3)
    assert got[21].kept == ["menu", "b1"]  # four pages are too few to tell
    assert got[30].lines == got[31].lines == got[32].kept == []


def test_joined_by_host_beyond_the_broadcast_bound(spark, small, monkeypatch):
    before = {tuple(r) for r in lines.op7_site_line_dedup(spark, small).collect()}
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert {tuple(r) for r in lines.op7_site_line_dedup(spark, small).collect()} == before


def test_text_lines_keep_blank_lines(spark):
    docs = spark.createDataFrame([(k, "s", f"same\n\nown {k}") for k in range(8)] + [(9, None, None)], "doc_id long, source string, text string")
    got = {r.row.doc_id: r.kept for r in lines.drop_boilerplate(docs, F.col("source"), lines.text_lines(F.col("text"))).collect()}
    assert got[3] == ["", "own 3"] and got[9] == [""]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert lines.drop_boilerplate(pages, lines.host_of(F.col("url")), lines.html_lines(F.col("html"))).count() == 0
