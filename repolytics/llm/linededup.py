"""Line dedup by site-relative frequency.

Pages are grouped by host; a line that stands on more than ``ratio`` of a host's
pages, and on ``least_pages`` at least, is boilerplate there and is dropped from
them.  A page counts once however often it repeats a line.  Only DataFrame
functions are used.  Counts are combined before the shuffle, so a frequent line
or a large host is a few rows; and a host has at most (lines a page / ratio)
boilerplate lines, which are kept as one array of digests for each host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolytics.llm.common import packed, saved

RATIO = 0.1
#: A line on one page only repeats nothing, however few pages its host has.
LEAST_PAGES = 2
#: For sources as for hosts, but documents that are near copies of each other haven't been merged yet.
LEAST_DOCS = 5
#: For sources, which are far larger than sites: lines of so many words at least, and the ratio for them.
#: On sf0.1 lines of one to three words stand by chance on up to 3 % of a source, repeated lines of five
#: words or more on 1 to 13 %, and no line of over 30 words on more than 4 documents of 500.
SOURCE_RATIOS = ((0, 0.03), (5, 0.004), (31, 0.001))
#: Digests that may be broadcast (32 characters each).
BROADCAST_LINES = 500_000
SALTS = 64


def _digest(line: Column) -> Column:
    """A line without outer spaces and tabs, as 128 bits; null if nothing is left."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def source_boilerplate(docs: DataFrame, source: Column, text: Column, *, ratios: tuple[tuple[int, float], ...] = SOURCE_RATIOS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``host, lines``: the digests of each source's boilerplate lines, with a ratio by their number of words.

    Exact copies of a text count once, among the lines' documents and the source's.
    """
    known = docs.select(source.alias("host"), text.alias("text"), F.xxhash64(text).alias("row")).filter(F.col("host").isNotNull())
    totals = known.select("host", "row").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))

    def line(x: Column) -> Column:
        bare = F.btrim(x, F.lit(" \t\r"))
        words = F.size(F.split(bare, r"[ \t\r]+"))
        level = F.lit(ratios[0][1])
        for least, ratio in ratios[1:]:
            level = F.when(words >= least, F.lit(ratio)).otherwise(level)
        return F.struct(_digest(x).alias("line"), level.alias("ratio"))

    lines = known.select("host", "row", F.explode(F.array_distinct(F.transform(F.split(F.col("text"), "\n"), line))).alias("l")).select("host", "row", "l.line", "l.ratio").filter(F.col("line").isNotNull())
    counts = lines.distinct().groupBy("host", "line", "ratio").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= least_docs)
    common = counts.join(totals, "host").filter(F.col("held") > F.col("pages") * F.col("ratio"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def boilerplate(pages: DataFrame, host: Column, text: Column, *, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, lines``: the digests of each host's boilerplate lines.

    Blank lines never count.  Pages without host have no site, hence no boilerplate.
    """
    known = pages.select(host.alias("host"), text.alias("text")).filter(F.col("host").isNotNull())
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = known.select("host", F.explode(F.array_distinct(F.transform(F.split(F.col("text"), "\n"), _digest))).alias("line")).filter(F.col("line").isNotNull())
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= least_pages)
    common = counts.join(totals, "host").filter(F.col("held") > F.col("pages") * F.lit(float(ratio)))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: Column, *, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: bool = False, found: DataFrame | None = None) -> DataFrame:
    """``pages`` without the lines that are boilerplate on their host.

    Lines end at "\\n"; a line's outer spaces and tabs don't matter.  Kept lines
    are as they were and in their order.  Blank lines, null and empty texts, and
    pages without host stay as they are; repeated rows count each; all columns
    stay, whatever their names.  With ``counts`` the columns ``n_lines``
    and ``n_dropped`` are added (null texts: 0).  ``found`` are boilerplate lines of other rules.
    """
    found = saved(boilerplate(pages, host, F.col(text), ratio=ratio, least_pages=least_pages) if found is None else found, "boilerplate")
    held = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)), F.count(F.lit(1))).first()
    rows = pages.select(packed(pages).alias("own"), host.alias("host"), F.col(text).alias("body"))
    if held[0] + held[1] <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(found.select("host", "lines")), "host", "left")
    else:
        # Too much for a broadcast: a host's pages are dealt over SALTS parts, and its array goes to each of them.
        salt = F.pmod(F.xxhash64("body", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        spread = found.select("host", "lines", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    lines = F.split(F.col("body"), "\n")
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("lines"), _digest(x)), F.lit(True)))
    out = rows.withColumn("kept", F.when(F.col("lines").isNotNull(), kept))
    body = F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join("kept", "\n"))
    own = [body.alias(c) if c == text else F.col("own")[c].alias(c) for c in pages.columns if not counts or c not in ("n_lines", "n_dropped")]
    if counts:
        n = F.when(F.col("body").isNull(), F.lit(0)).otherwise(F.size(lines))
        own += [n.cast("long").alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long").alias("n_dropped")]
    return out.select(*own)


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_lines(html: Column) -> Column:
    """The text of a page, a line for each block element or line break."""
    for pattern, by in (
        (r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)", ""),
        (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|td|th|title|body|head|html|blockquote|pre|aside|main|form)\b[^>]*>", "\n"),
        (r"<[^>]*>", ""),
    ):
        html = F.regexp_replace(html, pattern, by)
    lines = F.transform(F.split(html, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def page_report(pages: DataFrame, *, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text``: every page's text without its site's boilerplate.

    A null page has a null text and no lines; a page whose url is null or names no
    host has a null host and keeps all lines; repeated rows count as pages of their
    own; no rows give no rows.
    """
    rows = saved(pages.select("page_id", host_of(F.col("url")).alias("host"), page_lines(F.col("html")).alias("text")), "page-text")
    return drop_boilerplate(rows, F.col("host"), ratio=ratio, least_pages=least_pages, counts=True).select("page_id", "host", "n_lines", "n_dropped", "text")


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)', '', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|td|th|title|body|head|html|blockquote|pre|aside|main|form)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS text
  FROM pages
), l AS (
  SELECT r, host, k, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM p)
), c AS (
  SELECT host, bare FROM l JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t USING (host) WHERE bare <> ''
  GROUP BY host, bare, pages HAVING count(DISTINCT r) >= 2 AND count(DISTINCT r) > pages * 0.1::DOUBLE
), o AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE c.bare IS NOT NULL) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE c.bare IS NULL) AS kept
  FROM l LEFT JOIN c ON l.host = c.host AND l.bare = c.bare GROUP BY r
)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM p LEFT JOIN o USING (r)
"""
