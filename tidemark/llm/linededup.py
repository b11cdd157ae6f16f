"""Line dedup by site-relative frequency.

For every host the pages that contain a line are divided by the host's pages; lines above the
boilerplate ratio are dropped from that host's pages. The lines to drop per host are few, at
most the average lines per page over the ratio, so they travel to the texts and not the reverse.
"""

from pyspark.sql import functions as F

from ..session import stored

RATIO = 0.05          # of a host's pages
LEAST_PAGES = 3       # a line on fewer pages is no boilerplate, however small its host
MOST_LOST = 0.5       # a page that would lose a larger share of its text is left alone
BLANKS = " \t\r\n\f\x0b"


def bare(line):
    """A line without the white space around it."""
    return F.btrim(line, F.lit(BLANKS))


def line_key(line):
    """The hash a line is known by; null for a blank line."""
    return F.when(bare(line) != "", F.xxhash64(bare(line), F.length(bare(line))))


def boilerplate(pages, host_col="source", text_col="text", ratio=RATIO, least=LEAST_PAGES):
    """(host, line, pages, host_pages): lines on more than `ratio` of their host's pages, at least `least`.

    Pages of a host with equal texts count once, both for a line and in the total, so that copies of a page do not
    make its lines boilerplate.
    """
    rows = pages.select(pages[host_col].cast("string").alias("host"), F.coalesce(pages[text_col].cast("string"), F.lit("")).alias("text"))
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: k.isNotNull()))
    slim = rows.select("host", F.xxhash64("text", F.length("text")).alias("page"), keys.alias("keys"))
    slim = stored(slim.groupBy("host", "page").agg(F.first("keys").alias("keys")))    # equal texts have equal keys
    totals = slim.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = slim.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    c, t = counts.alias("c"), totals.alias("t")
    return c.join(t, F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("pages") > F.col("host_pages") * ratio).select("c.*", "host_pages")


def drop_boilerplate(pages, host_col="source", text_col="text", ratio=RATIO, least=LEAST_PAGES, most_lost=MOST_LOST):
    """pages with boilerplate lines taken out of the text, and the columns lines and lines_dropped.

    Boilerplate goes from every page of its host, with one exception: a page that would lose more than `most_lost`
    of its characters, blank lines aside, is a copy of other pages rather than a page with
    boilerplate, and is left as it is. Null hosts form one host. Null texts stay null with no
    lines, blank lines are kept, repeated rows are cleaned alike. Other columns pass through; columns
    named lines or lines_dropped are replaced.
    """
    found = boilerplate(pages, host_col, text_col, ratio, least)
    per_host = stored(found.groupBy("host").agg(F.collect_set("line").alias("__drop")))
    p, d = pages.alias("p"), per_host.alias("d")
    joined = p.join(d, pages[host_col].cast("string").eqNullSafe(F.col("d.host")), "left").select("p.*", "__drop")
    lines = F.split(pages[text_col].cast("string"), "\n")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), F.coalesce(F.array_contains("__drop", line_key(x)), F.lit(False)).alias("drop")))
    weigh = lambda only: F.aggregate(
        F.filter("__lines", lambda x: x["drop"]) if only else F.col("__lines"), F.lit(0), lambda a, x: a + F.length(bare(x["line"])))
    dropped = F.size(F.filter("__lines", lambda x: x["drop"]))
    out = joined.withColumn("__lines", F.when(F.col("__drop").isNotNull(), marked)).withColumn("__n", F.coalesce(dropped, F.lit(0)))
    out = out.withColumn("__n", F.when((F.col("__n") > 0) & (weigh(True) <= weigh(False) * most_lost), F.col("__n")).otherwise(0))
    kept = F.array_join(F.transform(F.filter("__lines", lambda x: ~x["drop"]), lambda x: x["line"]), "\n")
    return out.withColumn("lines", F.coalesce(F.size(lines), F.lit(0))).withColumn("lines_dropped", F.col("__n")).withColumn(
        text_col, F.when(F.col("__n") > 0, kept).otherwise(F.col(text_col))).drop("__lines", "__n", "__drop")
