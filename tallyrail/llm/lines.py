"""Site-relative line deduplication, in DataFrame functions only.

Per host, the number of pages that contain a line is divided by the host's pages; lines above ``RATIO`` are
boilerplate and are dropped from the host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table

#: A line in more than this share of its host's pages, and in this many pages at least, is boilerplate.
RATIO, LEAST_PAGES = 0.1, 5
#: Boilerplate lines up to which the hosts' lists are broadcast: 100,000 hashes are below one MB.
BROADCAST_LINES = 100_000
#: Patterns that both Java and RE2 read alike: parts without text, tags that end a line, and other tags.
UNSEEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK_TAG = r"(?i)</?(p|div|li|ul|ol|nav|article|h[1-6]|br|hr|tr|td|th|table|section|header|footer|head|title|body|html|main|aside|pre|blockquote)\b[^>]*>"
OTHER_TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """The trimmed non-empty lines of a page's text, cut at block tags and line breaks; none of a null page."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, " "), BLOCK_TAG, "\n"), OTHER_TAG, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda line: line != "")


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def drop_boilerplate(df: DataFrame, host: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """row (a struct of all columns of ``df``), host, lines and kept: all lines and those that aren't boilerplate.

    Lines are compared without surrounding spaces; a blank line is never boilerplate. A line counts once for a page.
    A null host is a host of its own (the empty name), a row without lines counts as a page, repeated rows count as
    pages each, and an empty table gives no rows. Columns of ``df`` may have any names.

    A page's distinct lines are reduced to hashes before the shuffle and counted with partial sums, so a hot host or
    line is combined where it is read. A host has at most (lines of a page) / ratio boilerplate lines, so its list is
    small. The lists are broadcast up to ``BROADCAST_LINES`` and joined by host otherwise; they are written first, so
    the pages of a hot host can be dealt to several tasks.
    """
    rows = df.select(F.struct("*").alias("row"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    hashed = rows.select("host", F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), lambda x: F.xxhash64(F.trim(x)))).alias("hashes"))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = hashed.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    found = counts.join(pages, "host").filter(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    lists = checkpointed(found.groupBy("host").agg(F.collect_list("hash").alias("boilerplate"), F.count(F.lit(1)).alias("n")))
    if (lists.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    joined = rows.join(lists.drop("n"), "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("boilerplate", F.xxhash64(F.trim(x))))
    )
    return joined.select("row", "host", "lines", kept.alias("kept"))


def op7_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return drop_boilerplate(pages, host_of(F.col("url")), html_lines(F.col("html"))).select(
        "row.page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join("kept", "\n")).alias("kept_md5"),
    )


OP7_SQL = rf"""
WITH text AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', ' ', 'g'), '{BLOCK_TAG}', chr(10), 'g'), '{OTHER_TAG}', '', 'g') AS body
  FROM pages),
page AS (
  SELECT row_number() OVER () AS r, page_id, host,
         list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM text),
counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT r, host, unnest(list_distinct(lines)) AS line FROM page) GROUP BY host, line),
pages_of AS (SELECT host, count(*) AS pages FROM page GROUP BY host),
bad AS (
  SELECT host, list(line) AS lines FROM counts JOIN pages_of USING (host)
  WHERE n >= {LEAST_PAGES} AND n > pages * {RATIO}::DOUBLE GROUP BY host),
kept AS (
  SELECT page_id, page.host AS host, page.lines AS lines,
         list_filter(page.lines, lambda x: NOT coalesce(list_contains(bad.lines, x), false)) AS kept
  FROM page LEFT JOIN bad ON page.host = bad.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, len(kept)::BIGINT AS n_kept, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM kept
"""
