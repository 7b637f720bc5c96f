"""Crawl exports and search metrics from CSV, robots.txt and scrape payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import order, text

#: Export headers of each field, in the order they are tried. Fixed values.
ALIASES = {
    "url": ("address", "url"),
    "status_code": ("status code",),
    "content_type": ("content type",),
    "indexability": ("indexability",),
    "title": ("title 1", "title"),
    "description": ("meta description 1", "meta description", "description 1"),
    "h1": ("h1-1", "h1"),
    "word_count": ("word count",),
    "text_ratio": ("text ratio",),
    "crawl_depth": ("crawl depth",),
    "folder_depth": ("folder depth",),
    "inlinks": ("inlinks",),
    "unique_inlinks": ("unique inlinks",),
    "outlinks": ("outlinks",),
    "external_outlinks": ("external outlinks",),
    "link_score": ("link score",),
    "content_hash": ("hash",),
    "canonical": ("canonical link element 1", "canonical link element"),
    "closest_similarity": ("closest similarity match",),
    "response_time": ("response time",),
}
INTEGERS = ("word_count", "folder_depth", "inlinks", "unique_inlinks", "outlinks", "external_outlinks", "link_score", "status_code")
DOUBLES = ("text_ratio", "closest_similarity", "response_time")
#: Words that name a column of a search-metrics export. Fixed values.
METRIC_HEADERS = {
    "url": ("top pages", "page", "url", "landing page", "adresse", "página", "pagina", "seite"),
    "clicks": ("click", "clics", "clicks", "klicks", "cliques"),
    "impressions": ("impression", "impresiones", "impressionen", "impressões"),
    "ctr": ("ctr",),
    "position": ("position", "posición", "posizione", "durchschnittliche position"),
}
#: Headers that show an export of another dimension. Fixed values.
WRONG_DIMENSION = {
    "query": "queries", "search query": "queries", "consulta": "queries", "suchanfrage": "queries",
    "country": "countries", "device": "devices", "date": "dates", "search appearance": "search appearance",
}


def aliased(raw: DataFrame) -> DataFrame:
    """One string column for each field: the first alias with a value, stripped; "" where there is none."""
    headers = {h.lower().strip().lstrip("﻿"): h for h in raw.columns}
    fields = {}
    for name, aliases in ALIASES.items():
        found = [F.nullif(F.col(f"`{headers[a]}`"), F.lit("")) for a in aliases if a in headers]
        fields[name] = F.trim(F.coalesce(*found, F.lit("")))
    return raw.select("ord", *[c.alias(n) for n, c in fields.items()])


def accepted(rows: DataFrame) -> Column:
    """Rows with a URL whose status, type and indexability do not speak against them."""
    return (
        (F.col("url") != "")
        & F.col("status_code").isin("", "200")
        & ((F.col("content_type") == "") | F.lower("content_type").contains("text/html"))
        & ~F.lower("indexability").startswith("non-indexable")
    )


def crawl_entries(raw: DataFrame, max_urls: int = 0, part: str | None = None) -> DataFrame:
    """Typed page entries with ``index``, in file order; ``part`` numbers each site alone."""
    return entries_of(aliased(raw), max_urls, part)


def entries_of(fields: DataFrame, max_urls: int = 0, part: str | None = None) -> DataFrame:
    """:func:`crawl_entries` of rows that have one string column for each field."""
    rows = fields.where(accepted(fields))
    if part:
        numbered = rows.withColumn("index", (F.row_number().over(W.Window.partitionBy(part).orderBy("ord")) - 1).cast("bigint"))
    else:
        numbered = order.numbered(rows, [F.col("ord")], "index")
    if max_urls:
        numbered = numbered.where(F.col("index") < max_urls)
    depth = F.when(F.col("crawl_depth") == "", F.lit(-1)).otherwise(text.safe_int(F.col("crawl_depth"))).cast("bigint")
    typed = {n: text.safe_int(F.col(n)) for n in INTEGERS} | {n: text.safe_float(F.col(n)) for n in DOUBLES} | {"crawl_depth": depth}
    return numbered.withColumns(typed)


def metric_columns(headers: list[str]) -> dict[str, str]:
    """Field to header of a search-metrics export; an error for one that has none or the wrong dimension."""
    level = [h.strip().lower().lstrip("﻿") for h in headers]
    for wrong, kind in WRONG_DIMENSION.items():
        if wrong in level:
            raise ValueError(f"this is an export of {kind}, not of pages (column {wrong!r})")
    found = {}
    for field, words in METRIC_HEADERS.items():
        at = next((i for i, h in enumerate(level) if any(w in h for w in words)), None)
        if at is not None:
            found[field] = headers[at]
    if "url" not in found:
        raise ValueError(f"no URL column among {headers}")
    if "clicks" not in found and "impressions" not in found:
        raise ValueError("neither clicks nor impressions: nothing to rank on")
    return found


def metric_rows(raw: DataFrame, source: str = "upload") -> DataFrame:
    """Metrics of the rows whose URL is absolute; unreadable numbers are null."""
    names = metric_columns([c for c in raw.columns if c != "ord"])
    cell = lambda f: text.locale_number(F.col(f"`{names[f]}`")) if f in names else F.lit(None).cast("double")
    url = F.trim(F.col(f"`{names['url']}`"))
    rows = raw.where(url.rlike("^https?://"))
    return rows.select("ord", url.alias("url"), cell("clicks").cast("bigint").alias("clicks"), cell("impressions").cast("bigint").alias("impressions"), cell("ctr").alias("ctr"), cell("position").alias("position"), F.lit(source).alias("source"))


def robots_lines(files: DataFrame) -> DataFrame:
    """(site, pos, field, value) of every directive of robots.txt texts (site, body)."""
    lines = files.select("site", F.posexplode(F.split("body", "\r?\n")).alias("pos", "raw"))
    bare = lines.select("site", "pos", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")).where(F.col("line").contains(":"))
    value = F.trim(F.substr("line", F.locate(":", F.col("line")) + 1))
    return bare.select("site", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), value.alias("value"))


def robots(files: DataFrame) -> DataFrame:
    """(site, kind, ord, value): sitemaps anywhere, rules of the group for every agent."""
    lines = robots_lines(files)
    so_far = W.Window.partitionBy("site").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(so_far)
    known = lines.withColumn("agent", agent)
    kind = (
        F.when((F.col("field") == "sitemap") & (F.col("value") != ""), "sitemap")
        .when((F.col("field") == "disallow") & (F.col("agent") == "*") & (F.col("value") != ""), "disallow")
        .when((F.col("field") == "crawl-delay") & (F.col("agent") == "*") & text.number(F.col("value")).isNotNull(), "crawl-delay")
    )
    return known.select("site", kind.alias("kind"), F.col("pos").alias("ord"), "value").where("kind is not null")


SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")


def sitemap_candidates(site_url: Column, listed: Column) -> Column:
    """Sitemaps that robots.txt lists, then the conventional places, each once."""
    root = F.regexp_extract(site_url, "^[a-zA-Z]+://[^/?#]*", 0)
    return F.array_distinct(F.concat(listed, F.array(*[F.concat(root, F.lit(p)) for p in SITEMAP_PATHS])))


SITEMAP = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>, _corrupt_record string"
#: The root element, after declarations and comments.
ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![A-Za-z][^>]*>\s*)*<(?:[\w.-]+:)?([\w.-]+)"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(sitemap_url, is_index, ord, loc) of sitemap XML (sitemap_url, body), in order; malformed XML gives no row."""
    tree = F.from_xml(F.btrim("body", F.lit(" \t\r\n﻿")), SITEMAP, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"})
    none = F.array().cast("array<struct<loc:string>>")
    parsed = files.select("sitemap_url", (F.regexp_extract("body", ROOT, 1) == "sitemapindex").alias("is_index"), tree.alias("x")).where("x._corrupt_record is null")
    named = F.filter(F.concat(F.coalesce("x.sitemap", none), F.coalesce("x.url", none)), lambda e: F.trim(e["loc"]) != "")
    rows = parsed.select("sitemap_url", "is_index", F.posexplode(named).alias("ord", "e"))
    return rows.select("sitemap_url", "is_index", F.col("ord").cast("bigint").alias("ord"), F.trim("e.loc").alias("loc"))


def sitemap_walk(links: DataFrame, seeds: DataFrame, max_depth: int = 3, max_sitemaps: int = 50) -> DataFrame:
    """(site, sitemap_url, depth) reached from seeds over nested links (sitemap_url, loc), breadth first.

    Depth is bounded, so the rounds are; each is one join and one anti-join.
    """
    reached = seeds.select("site", "sitemap_url", F.lit(0).alias("depth")).distinct()
    front = reached
    for depth in range(1, max_depth + 1):
        found = front.join(links, "sitemap_url").select("site", F.col("loc").alias("sitemap_url"), F.lit(depth).alias("depth")).distinct()
        front = found.join(reached, ["site", "sitemap_url"], "left_anti")
        reached = reached.unionByName(front)
    order = W.Window.partitionBy("site").orderBy("depth", "sitemap_url")
    return reached.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_sitemaps).drop("n")


SCRAPE = "success boolean, error string, data struct<markdown:string, metadata:struct<sourceURL:string,url:string,title:string,description:string,canonical:string,ogUrl:string,robots:string,statusCode:int>>"


def scrape_page(url: Column, payload: Column) -> Column:
    """A scrape payload as struct (status, url, title, description, h1, word_count, error)."""
    body = F.from_json(payload, SCRAPE)
    meta = body["data"]["metadata"]
    markdown = F.trim(F.coalesce(body["data"]["markdown"], F.lit("")))
    refused = F.coalesce(~body["success"], F.lit(False))
    empty = markdown == ""
    words = F.size(F.filter(F.split(markdown, r"\s+"), lambda w: w != ""))
    error = F.when(refused, F.coalesce(body["error"], F.lit("unsuccessful"))).when(empty, F.lit("empty markdown"))
    status = F.when(refused, 0).when(empty, F.coalesce(meta["statusCode"], F.lit(0))).otherwise(F.coalesce(F.nullif(meta["statusCode"], F.lit(0)), F.lit(200)))
    fine = error.isNull()
    return F.struct(
        status.cast("bigint").alias("status"),
        F.when(fine, F.coalesce(meta["sourceURL"], meta["url"], url)).alias("url"),
        F.when(fine, F.trim(F.coalesce(meta["title"], F.lit("")))).alias("title"),
        F.when(fine, F.trim(F.regexp_extract(markdown, r"(?m)^[ \t]*# (.*)$", 1))).alias("h1"),
        F.when(fine, words.cast("bigint")).alias("word_count"),
        error.alias("error"),
    )


#: Reasons of refused count tasks by status. Fixed values.
TASK_REASONS = {
    40100: "auth_failed", 40101: "auth_failed", 40200: "out_of_credits", 40201: "out_of_credits", 40202: "out_of_credits",
    40207: "ip_not_whitelisted", 40209: "rate_limited", 40501: "api_error",
}
COUNTS = "tasks array<struct<status_code:int, status_message:string, result:array<struct<se_results_count:bigint>>>>"


def results_count(payload: Column) -> Column:
    """A count payload as struct (count, reason, detail)."""
    tasks = F.from_json(payload, COUNTS)["tasks"]
    counts = F.flatten(F.transform(tasks, lambda t: F.coalesce(F.transform(t["result"], lambda r: r["se_results_count"]), F.array().cast("array<bigint>"))))
    count = F.get(F.filter(counts, lambda c: c >= 0), F.lit(0))
    refused = F.get(F.filter(tasks, lambda t: t["status_code"] != 20000), F.lit(0))
    reasons = F.create_map(*[F.lit(x) for pair in TASK_REASONS.items() for x in pair])
    reason = F.when(count.isNotNull(), "ok").when(refused.isNotNull(), F.coalesce(F.try_element_at(reasons, refused["status_code"]), F.lit("api_error"))).otherwise("no_results")
    detail = F.when(count.isNull() & refused.isNotNull(), F.trim(F.concat_ws(" ", refused["status_code"].cast("string"), F.trim(refused["status_message"])))).otherwise("")
    return F.struct(count.alias("count"), reason.alias("reason"), detail.alias("detail"))
