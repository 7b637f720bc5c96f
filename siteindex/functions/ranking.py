"""Importance of a page, and which pages are optional, contact or identity pages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Weights and thresholds. Fixed values.
WEIGHTS = {"depth": 0.2, "content": 0.1, "link_score": 0.4, "inlinks": 0.3}
OPTIONAL_DEPTH, OPTIONAL_INLINKS, OPTIONAL_LINK_SCORE = 4, 1, 5
#: Words that mark contact and identity pages. Fixed values.
CONTACT_URL = ("contact", "customer-service", "customer-support", "store-locator", "find-a-store", "locations", "help-centre", "help-center", "support")
CONTACT_TITLE = ("contact", "store locator", "customer service")
IDENTITY_URL = ("/about", "/contact", "/case-stud", "/our-work", "/portfolio", "/team", "/testimonial", "/clients", "/pricing", "/services")
IDENTITY_TITLE = ("about", "contact", "case stud", "our work", "pricing")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def effective_depth() -> Column:
    """Crawl depth, or the number of path segments where it is unknown (-1)."""
    return F.when(F.col("crawl_depth") >= 0, F.col("crawl_depth")).otherwise(F.size(urls.segments(F.col("url")))).cast("bigint")


def score_terms() -> dict[str, Column]:
    """Each term of the score over crawl_depth, url, word_count, link_score, unique_inlinks; null where it has no signal."""
    linked = (F.col("link_score") > 0) | (F.col("unique_inlinks") > 0)
    value = {
        "depth": F.greatest(F.lit(0.0), 100.0 - effective_depth() * 20.0),
        "content": F.when(F.col("word_count") > 0, F.least(F.col("word_count") / 10.0, F.lit(100.0))).otherwise(50.0),
        "link_score": F.when(linked, F.col("link_score").cast("double")),
        "inlinks": F.when(linked, F.least(F.col("unique_inlinks") * 10.0, F.lit(100.0))),
    }
    # The sums' decimal values: 0.2 + 0.1 is not 0.3 in doubles, and equal scores must stay equal.
    plain = round(WEIGHTS["depth"] + WEIGHTS["content"], 9)
    full = round(plain + WEIGHTS["link_score"] + WEIGHTS["inlinks"], 9)
    return {k: v * F.when(linked, WEIGHTS[k] / full).otherwise(WEIGHTS[k] / plain) for k, v in value.items()}


def importance() -> Column:
    t = score_terms()
    return t["depth"] + t["content"] + F.coalesce(t["link_score"], F.lit(0.0)) + F.coalesce(t["inlinks"], F.lit(0.0))


def is_optional() -> Column:
    weak = (F.col("unique_inlinks") <= OPTIONAL_INLINKS) | F.col("link_score").between(1, OPTIONAL_LINK_SCORE)
    return (effective_depth() >= OPTIONAL_DEPTH) & weak


def display_title() -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("h1"))


def is_contact() -> Column:
    return any_of(F.lower("url"), CONTACT_URL) | any_of(F.lower(display_title()), CONTACT_TITLE)


def is_identity() -> Column:
    parts = urls.segments(F.col("url"))
    lowered = F.concat(F.lit("/"), F.lower(F.array_join(parts, "/")))
    return (F.size(parts) == 0) | any_of(lowered, IDENTITY_URL) | any_of(F.lower(display_title()), IDENTITY_TITLE)
