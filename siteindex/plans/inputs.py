"""Reference-shaped inputs derived from the driver's tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .registry import table

#: Parts of a URL in SQL, over a column named url.
URL_RE = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def sql_authority(c: str = "url") -> str:
    return f"regexp_extract({c}, '{URL_RE}', 2)"


def sql_path(c: str = "url") -> str:
    return f"regexp_replace(regexp_extract({c}, '{URL_RE}', 3), ';[^/]*$', '')"


def sql_query(c: str = "url") -> str:
    return f"regexp_extract({c}, '{URL_RE}', 4)"


def sql_segments(c: str = "url") -> str:
    return f"list_filter(string_split({sql_path(c)}, '/'), lambda s: s <> '')"


def sql_title_case(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '')"


def sql_unslug(c: str) -> str:
    return sql_title_case(f"translate({c}, '-_', '  ')")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page entries: metadata from the HTML, crawl measures by fixed arithmetic on the page id."""
    pages = table(spark, sf_dir, "pages")
    tag = lambda name: F.regexp_extract("html", f"<{name}>([^<]*)</{name}>", 1)
    i = F.col("page_id")
    return pages.select(
        i.alias("ord"),
        "url",
        F.regexp_extract(urls.site_domain(F.col("url")), r"([a-z-]+\.[a-z]+)$", 1).alias("site"),
        tag("title").alias("title"),
        tag("h1").alias("h1"),
        F.regexp_extract("html", r"<p>([^<]*)", 1).alias("description"),
        F.when(i % 17 == 0, F.lit(0)).otherwise(F.expr("length(html) div 40")).cast("bigint").alias("word_count"),
        F.when(i % 3 == 0, F.lit(-1)).otherwise(i % 7).cast("bigint").alias("crawl_depth"),
        (i * 7 % 13).cast("bigint").alias("unique_inlinks"),
        F.when(i % 4 == 0, F.lit(0)).otherwise(i * 11 % 101).cast("bigint").alias("link_score"),
        ((i * 37 % 1000) / 10).cast("double").alias("closest_similarity"),
        F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("h"), (i % 90).cast("string"))).alias("content_hash"),
        F.when(i % 6 == 0, F.lit("")).otherwise(F.regexp_replace("url", "[?#].*$", "")).alias("canonical"),
    )


INVENTORY_SQL = rf"""
inv as (
  select page_id as ord, url, regexp_extract(lower({sql_authority()}), '([a-z-]+\.[a-z]+)$', 1) as site,
    regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1,
    regexp_extract(html, '<p>([^<]*)', 1) as description,
    cast(case when page_id % 17 = 0 then 0 else length(html) // 40 end as bigint) as word_count,
    cast(case when page_id % 3 = 0 then -1 else page_id % 7 end as bigint) as crawl_depth,
    cast(page_id * 7 % 13 as bigint) as unique_inlinks,
    cast(case when page_id % 4 = 0 then 0 else page_id * 11 % 101 end as bigint) as link_score,
    cast((page_id * 37 % 1000) / 10e0 as double) as closest_similarity,
    case when page_id % 5 = 0 then '' else 'h' || cast(page_id % 90 as varchar) end as content_hash,
    case when page_id % 6 = 0 then '' else regexp_replace(url, '[?#].*$', '') end as canonical
  from pages
), ranked as (
  select *, coalesce(nullif(title, ''), h1) as display_title, len({sql_segments()}) as n_segments,
    case when crawl_depth >= 0 then crawl_depth else len({sql_segments()}) end as depth
  from inv
), scored as (
  select *, greatest(0e0, 100e0 - depth * 20e0) as depth_value,
    case when word_count > 0 then least(word_count / 10e0, 100e0) else 50e0 end as content_value,
    (link_score > 0 or unique_inlinks > 0) as linked,
    depth >= 4 and (unique_inlinks <= 1 or link_score between 1 and 5) as optional
  from ranked
), entries as (
  select * exclude (depth_value, content_value, linked),
    depth_value, content_value, linked,
    case when linked then depth_value * 0.2e0 + content_value * 0.1e0 + link_score * 0.4e0 + least(unique_inlinks * 10e0, 100e0) * 0.3e0
      else depth_value * (0.2e0 / 0.3e0) + content_value * (0.1e0 / 0.3e0) end as score
  from scored
)"""


def select_list(sql: str) -> list[str]:
    """Select items of a one-table query written for both engines."""
    body = sql.strip().removeprefix("select ").rsplit(" from ", 1)[0]
    items, depth, held, quoted = [], 0, "", False
    for c in body:
        if c == "'":
            quoted = not quoted
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            items.append(held)
            held = ""
        else:
            held += c
    return [x.replace('"', "`") for x in [*items, held]]
