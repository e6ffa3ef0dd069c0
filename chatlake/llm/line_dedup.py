"""Boilerplate lines by their frequency within a site.

A page's visible lines are counted once a page; a line that stands on more than
``max_ratio`` of its host's pages is boilerplate there and is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import cols, fresh, without, written

MAX_RATIO = 0.25
MIN_PAGES = 3       # pages of the host that a line must be on to be boilerplate

# Patterns that Java's and RE2's syntax read alike.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main"
          r"|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>")
TAGS = r"<[^>]*>"
BLANKS = r"[ \t\x0B\f\r]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; NULL if there is none."""
    h = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(h != "", h)


def lines_of(html: Column) -> Column:
    """Visible lines: scripts, styles and comments out, block tags and line feeds
    end a line, other tags out, blanks squeezed, empty lines out."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, HIDDEN, "")
    t = F.regexp_replace(t, BREAKS, "\n")
    t = F.regexp_replace(t, TAGS, "")
    t = F.regexp_replace(t, BLANKS, " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with host, n_lines, n_dropped and clean_text (the kept lines) in
    place of ``html_col``. Columns of these names in the input are replaced.

    A line on fewer than ``min_pages`` pages of its host is never boilerplate, whatever
    its ratio: on a host of one or two pages every line would be. 1 leaves the ratio alone.

    A line counts once a page and every row is a page, repeated rows too. Pages
    without a host (NULL or other urls) are no site and keep all lines; NULL
    and empty pages have no lines and an empty clean_text.
    """
    pages = without(pages, "host", "n_lines", "n_dropped", "clean_text")
    row, lines, host_pages, on, bad = fresh(pages, "row", "lines", "host_pages", "on", "bad")

    def digest(line: Column) -> list[Column]:
        """128 bits that stand for a line in the shuffles."""
        return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(bad), line).alias("h2")]

    rest = without(pages, html_col)
    # one pass over the html; the row number is fixed by being written
    table = written(pages.select(*cols(rest), host_of(F.col(f"`{url_col}`")).alias("host"),
                                 lines_of(F.col(f"`{html_col}`")).alias(lines), F.monotonically_increasing_id().alias(row)), "page-lines")
    sited = table.where("host IS NOT NULL")
    once = sited.select("host", F.explode(F.array_distinct(lines)).alias("line")).select("host", *digest(F.col("line")))
    seen = once.groupBy("host", "h1", "h2").agg(F.count("*").alias(on)).where(F.col(on) >= min_pages)
    totals = sited.groupBy("host").agg(F.count("*").alias(host_pages))
    boiler = seen.join(totals, "host").where(F.col(on) > max_ratio * F.col(host_pages)).select("host", "h1", "h2")
    # a line on most pages of a site that holds most pages: a skewed join, which is split
    single = sited.select(row, "host", F.posexplode(lines).alias("pos", "line")).select(row, "host", "pos", *digest(F.col("line")))
    drop = single.join(boiler, ["host", "h1", "h2"], "left_semi").groupBy(row).agg(F.collect_set("pos").alias(bad))
    n = F.size(lines)
    # positions go by a hash set, so long pages cost no more a line than short ones
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col(bad))
    text = F.when(F.col(bad).isNull(), F.array_join(lines, "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return table.join(drop, row, "left").select(
        *cols(rest), "host", n.cast("long").alias("n_lines"),
        F.when(F.col(bad).isNull(), F.lit(0)).otherwise(F.size(bad)).cast("long").alias("n_dropped"), text.alias("clean_text"))
