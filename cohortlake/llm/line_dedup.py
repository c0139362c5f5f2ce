"""Line dedup: lines that stand on too large a part of a site's pages are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm.common import as_row, stored
from cohortlake.llm.registry import query, table
from cohortlake.llm.url_filters import url_host

#: A line on more than this percentage of a site's pages is boilerplate, if at least so many pages hold it.
MOST_PERCENT, LEAST_PAGES = 30, 5
#: For sites of many texts: also a line on more than this percentage of the site's different texts, if at least so
#: many hold it. So many texts tell a share to about a fifth of it, and a site with fewer is not judged by it.
WIDE_PERCENT, WIDE_TEXTS = 5, 20

#: What ends a line of a page's text.
_BLOCK = (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html"
          r"|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>")
_SPACES = " \t\n\x0b\x0c\r"


def html_lines(html: str) -> Column:
    """Visible lines of a page: text between block tags and line feeds, trimmed, without empty ones."""
    text = F.coalesce(F.col(html), F.lit(""))
    for pattern, by in ((r"(?is)<script\b.*?</script>", ""), (r"(?is)<style\b.*?</style>", ""), (r"(?s)<!--.*?-->", ""),
                        (_BLOCK, "\n"), (r"<[^>]*>", "")):
        text = F.regexp_replace(text, pattern, by)
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)))
    return F.filter(lines, lambda x: x != "")


def text_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def site_key(site: Column) -> Column:
    """A site's key; null is a site of its own."""
    return F.xxhash64(site.isNull(), site)


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(pages: DataFrame, most_percent: int = MOST_PERCENT, least_pages: int = LEAST_PAGES,
                wide_percent: int | None = None, wide_texts: int = WIDE_TEXTS) -> DataFrame:
    """``(_site, _lines)``: hashes of each site's boilerplate lines, from ``(_site, _lines)`` of its pages.

    Pages count a line once. With ``wide_percent``, lines on more than that
    percentage of a site's different texts count too, if ``wide_texts`` hold
    them. Pages with the same lines are one text there, so a group of copies
    does not lose its own lines; copies that differ in a line are several.

    Tasks combine counts before the shuffle, so a large site, a line on all its
    pages or a page with many copies sends one row per task. The set of a site
    is bounded: its lines hold more than a percentage p of the pages or texts
    each, so there are at most 100 / p times as many as a page or text of the
    site has lines on average.
    """
    hashed = F.array_distinct(F.transform(F.filter("_lines", has_word), lambda x: F.xxhash64(x)))
    texts = pages.select("_site", "_lines", F.lit(1).cast("long").alias("_copies"))
    if wide_percent is not None:
        kinds = texts.groupBy("_site", hashed.alias("_hashed")).agg(F.sum("_copies").alias("_copies"))
        texts, hashed = stored(kinds, "line-hashes"), F.col("_hashed")
    # the expression itself, not a column of it: Spark filters such a column by its size, and computes it once more for that
    counts = texts.select("_site", F.explode(hashed).alias("_line"), "_copies").groupBy("_site", "_line").agg(
        F.sum("_copies").alias("_pages"), F.count(F.lit(1)).alias("_texts")
    )
    totals = texts.groupBy("_site").agg(F.sum("_copies").alias("_total"), F.count(F.lit(1)).alias("_kinds"))
    common = (F.col("_pages") >= least_pages) & (F.lit(100) * F.col("_pages") > F.lit(most_percent) * F.col("_total"))
    enough = F.col("_pages") >= least_pages
    if wide_percent is not None:
        common |= (F.col("_texts") >= wide_texts) & (F.lit(100) * F.col("_texts") > F.lit(wide_percent) * F.col("_kinds"))
        enough |= F.col("_texts") >= wide_texts
    often = counts.where(enough).join(totals, "_site").where(common)
    return stored(often.groupBy("_site").agg(F.collect_set("_line").alias("_often")), "boilerplate")


def without_boilerplate(rows: DataFrame, **settings) -> DataFrame:
    """Adds ``_kept``, the lines that stay in order, to rows with ``_site`` and ``_lines``.

    The sets join by site: the planner broadcasts them while they are small,
    else the pages of a large site are split among tasks.
    """
    sets = boilerplate(rows.select("_site", "_lines"), **settings)
    stays = F.filter("_lines", lambda x: ~has_word(x) | ~F.array_contains("_often", F.xxhash64(x)))
    return rows.join(sets, "_site", "left").withColumn(
        "_kept", F.when(F.col("_often").isNull(), F.col("_lines")).otherwise(stays)
    )


def page_lines(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **settings) -> DataFrame:
    """``(key, host, lines, kept)`` of every page: its text lines, and those that are not boilerplate of its host.

    Null urls form the site with the empty host; null html has no lines.
    Repeated pages count as pages of their own. Empty tables give empty results.
    """
    rows = pages.select(F.col(key).alias("_key"), url_host(url).alias("host"), html_lines(html).alias("_lines"))
    rows = rows.withColumn("_site", site_key(F.col("host")))
    return without_boilerplate(rows, **settings).select(
        F.col("_key").alias(key), "host", F.col("_lines").alias("lines"), F.col("_kept").alias("kept")
    )


def documents_without_boilerplate(docs: DataFrame, site: str = "source", text: str = "text",
                                  n_chars: str | None = "n_chars", **settings) -> DataFrame:
    """The documents without boilerplate lines of their site, all columns kept.

    A document whose lines all go stays with an empty text; null text stays
    null. ``n_chars`` follows a changed text where the table has that column.
    """
    rows = docs.select(as_row(docs), site_key(F.col(site)).alias("_site"), text_lines(text).alias("_lines"))
    cut = without_boilerplate(rows, **settings).withColumn("_cut", F.size("_kept") < F.size("_lines"))

    def column(name: str) -> Column:
        old = F.col("row")[name]
        if name == text:
            return F.when(F.col("_cut"), F.array_join("_kept", "\n")).otherwise(old).alias(name)
        if name == n_chars:
            kind = cut.schema["row"].dataType[name].dataType
            return F.when(F.col("_cut"), F.length(F.array_join("_kept", "\n")).cast(kind)).otherwise(old).alias(name)
        return old.alias(name)

    return cut.select(*[column(c) for c in docs.columns])


@query(r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<script\b.*?</script>', '', 'gis'), '<style\b.*?</style>', '', 'gis'), '<!--.*?-->', '', 'gs'),
      '</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>',
      chr(10), 'gi'), '<[^>]*>', '', 'g') AS body
  FROM pages),
l AS (
  SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)),
    lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM p),
often AS (
  SELECT host, line FROM (
    SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL)
  JOIN (SELECT host, count(*) AS total FROM l GROUP BY host) USING (host)
  WHERE n >= 5 AND 100 * n > 30 * total),
sets AS (SELECT host, list(line) AS often FROM often GROUP BY host),
k AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(often, []), x)) AS kept
  FROM l LEFT JOIN sets USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_lines(table(spark, sf_dir, "pages")).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )
