"""Line deduplication by how much of its own site a line is on.

For every host, the pages that hold a line are counted and divided by the host's pages; lines above the ratio are
boilerplate and go. Only hashes of lines and their counts are exchanged; the pages are dealt once, to meet the short list
of their host's boilerplate. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import join_facts, join_salted, text_of, without

OUT = ("host", "n_lines", "n_dropped", "clean_text")


def host_of(url: str) -> Column:
    """The lower-cased host (and port) of a URL; null where there is none."""
    host = F.lower(F.regexp_extract(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    return F.when(host != "", host)


def html_text(html: str) -> Column:
    """The text of a page, every tag being a line break."""
    return F.regexp_replace(text_of(html), "<[^>]*>", "\n")


def drop_boilerplate(pages: DataFrame, text: Column, ratio: float = 0.2, least_pages: int = 3, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages with host, n_lines, n_dropped and clean_text (the lines that stay, joined by line breaks).

    Lines are what line breaks separate, without spaces at the ends; empty ones are left out. A line goes when the rows of
    its host that hold it are least_pages or more and over `ratio` of the host's rows. Repeated rows count as pages of
    their own; a line repeated in a page counts once, and all its repeats go. Pages without a host (null or other url)
    belong to no site and keep all lines; a null text has none. Input columns named like an output column are replaced.
    """
    n_rows = pages.count()
    rows = without(pages, *OUT).withColumns({"host": host_of(url_col), "__lines": F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")})
    rows = rows.withColumn("__keys", F.transform("__lines", lambda x: F.md5(x)))
    sites = rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("__pages")).where(F.col("__pages") >= least_pages)
    held = rows.where("host IS NOT NULL").select("host", F.explode(F.array_distinct("__keys")).alias("__line"))
    held = held.groupBy("host", "__line").agg(F.count("*").alias("__with")).where(F.col("__with") >= least_pages)
    common = join_facts(held, sites, "host", "__pages", ["__line"], n_rows).where(F.col("__with") > F.col("__pages") * F.lit(ratio))
    # shares of one host's lines add up to its lines a page, so a host has fewer than that / ratio of these
    lists = common.groupBy("host").agg(F.max("__pages").alias("__pages"), F.collect_list("__line").alias("__common"))
    met = join_salted(rows, lists, "host", "__pages", [id_col, "host"], n_rows)
    gone = F.coalesce("__common", F.array().cast("array<string>"))
    # keys are looked up in the host's list once for each line
    stays = F.filter(F.arrays_zip(F.col("__lines").alias("x"), F.col("__keys").alias("k")), lambda z: ~F.array_contains(gone, z["k"]))
    met = met.withColumn("__kept", F.transform(stays, lambda z: z["x"]))
    met = met.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long"), "clean_text": F.array_join("__kept", "\n")})
    return met.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in OUT], *OUT)
