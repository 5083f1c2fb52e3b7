"""Following links through stored pages: from each start to the next page, with a limit and without turning in circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


def links(html: Column) -> Column:
    """The targets of all links of a page, in their order; without entities and white space around them."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))


def template_url(template: str, page: Column) -> Column:
    """A page's address from a template such as ``http://shop/list?page={page}``."""
    before, _, after = template.partition("{page}")
    return F.concat(F.lit(before), page.cast("string"), F.lit(after))


def follow(pages: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """(start, step, url): the pages on the way from each start, the first one at step 1.

    ``pages``: url (unique), next (null: the last one). ``starts``: start, url. A way ends
    at a page that is not stored, that names no next one or that was seen before on this way, or after
    ``limit`` pages. All ways go on together, a step at a time; each step is a join with
    the pages, and what was seen is a stored table.
    """
    front = settled(starts.select("start", "url").join(pages.select("url", "next"), "url"))
    seen, step = front.select("start", F.lit(1).alias("step"), "url"), 1
    while step < limit:
        on = front.filter("next is not null").select("start", F.col("next").alias("url")).join(pages.select("url", "next"), "url")
        front = settled(on.join(seen.select("start", "url"), ["start", "url"], "left_anti"))
        if front.isEmpty():
            break
        step += 1
        seen = settled(seen.unionByName(front.select("start", F.lit(step).alias("step"), "url")))
    return seen
