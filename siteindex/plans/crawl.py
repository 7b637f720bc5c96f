"""Queries of sources (S), filters (F), window orders (W) and sections (K) over page entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ranking, text, urls
from ..operators import inventory as inv
from ..operators import sections as sec
from ..sources import crawl, exports
from .inputs import INVENTORY_SQL, inventory, select_list, sql_path
from .registry import query, table
from .scalars import _NUMBER, CONTACT_SQL, SECTION_SQL

_RAW = """
  select page_id as ord, url as "Address", case page_id % 10 when 0 then '301' when 1 then '' else '200' end as "Status Code",
    case page_id % 7 when 0 then 'application/pdf' when 1 then '' else 'text/html; charset=UTF-8' end as "Content Type",
    case page_id % 9 when 0 then 'Non-Indexable, noindex' else 'Indexable' end as "Indexability",
    case page_id % 4 when 0 then '' else ' First ' || page_id end as "Title 1", 'Second ' || page_id as "Title",
    case page_id % 5 when 0 then '' when 1 then '12.7' when 2 then 'x' else cast(page_id as {s}) end as "Word Count",
    case page_id % 3 when 0 then '' else cast(page_id % 6 as {s}) end as "Crawl Depth",
    case page_id % 3 when 0 then '42.10%' else '7' end as "Text Ratio"
  from pages"""
_ACCEPT = """"Status Code" in ('', '200') and ("Content Type" = '' or contains(lower("Content Type"), 'text/html')) and not starts_with(lower("Indexability"), 'non-indexable')"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    case = lambda n, values, other: F.coalesce(*[F.when(i % n == k, F.lit(v)) for k, v in enumerate(values)], other)
    num = i.cast("string")
    return table(spark, sf_dir, "pages").select(
        i.alias("ord"),
        F.col("url").alias("Address"),
        case(10, ["301", ""], F.lit("200")).alias("Status Code"),
        case(7, ["application/pdf", ""], F.lit("text/html; charset=UTF-8")).alias("Content Type"),
        case(9, ["Non-Indexable, noindex"], F.lit("Indexable")).alias("Indexability"),
        case(4, [""], F.concat(F.lit(" First "), num)).alias("Title 1"),
        F.concat(F.lit("Second "), num).alias("Title"),
        case(5, ["", "12.7", "x"], num).alias("Word Count"),
        case(3, [""], (i % 6).cast("string")).alias("Crawl Depth"),
        case(3, ["42.10%"], F.lit("7")).alias("Text Ratio"),
    )


_TYPED = f"""select url, row_number() over (order by ord) - 1 as "index", title, coalesce(cast(trunc({_NUMBER.format('wc')}) as bigint), 0) as word_count,
  case when cd = '' then -1 else coalesce(cast(trunc({_NUMBER.format('cd')}) as bigint), 0) end as crawl_depth, coalesce({_NUMBER.format("rtrim(tr, '%')")}, 0e0) as text_ratio
  from (select ord, "Address" as url, trim(coalesce(nullif("Title 1", ''), nullif("Title", ''), '')) as title, trim("Word Count") as wc, trim("Crawl Depth") as cd, trim("Text Ratio") as tr from raw where {_ACCEPT})"""


@query("s01_crawl_csv", f"with raw as ({_RAW.format(s='varchar')}) {_TYPED}")
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_entries(_raw(spark, sf_dir)).select("url", "index", "title", "word_count", "crawl_depth", "text_ratio")


@query("s02_row_limit", f"with raw as ({_RAW.format(s='varchar')}), typed as ({_TYPED}) select url, \"index\" from typed where \"index\" < 25")
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_entries(_raw(spark, sf_dir), max_urls=25).select("url", "index")


@query("s03_row_ordinal", f"with raw as ({_RAW.format(s='varchar')}), typed as ({_TYPED}) select url, \"index\" from typed")
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_entries(_raw(spark, sf_dir)).select("url", "index")


@query("f01_row_acceptance", f"with raw as ({_RAW.format(s='varchar')}) select \"Address\" as url, {_ACCEPT} as accepted from raw")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawl.aliased(_raw(spark, sf_dir))
    return rows.select("url", crawl.accepted(rows).alias("accepted"))


_METRIC_RAW = """select page_id as ord, case page_id % 8 when 0 then 'q words' else url end as "Top pages", case page_id % 6 when 0 then '1,2' || page_id when 1 then '' when 2 then 'n/a' else cast(page_id as {s}) end as "Clicks",
  cast(page_id * 40 as {s}) as "Impressions", (page_id % 10) || '.5%' as "CTR", '4.2' as "Position" from pages"""
_LOCALE = r"case when regexp_matches({0}, '^[+-]?(\d+\.?\d*|\.\d+)$') then try_cast({0} as double) end"


@query(
    "s04_metrics_import",
    f"""with raw as ({_METRIC_RAW.format(s='varchar')}) select "Top pages" as url, cast(trunc({_LOCALE.format("replace(" + chr(34) + "Clicks" + chr(34) + ", ',', '')")}) as bigint) as clicks,
    cast("Impressions" as bigint) as impressions, cast(rtrim("CTR", '%') as double) / 100 as ctr, cast("Position" as double) as position from raw where "Top pages" like 'http%'""",
)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").selectExpr(*select_list(_METRIC_RAW.format(s="string")))
    return crawl.metric_rows(raw).select("url", "clicks", "impressions", "ctr", "position")


# Pages as the lines of export files in four languages, quoted, some with a line break inside a cell.
_HEADERS = ("Top pages,Notes,Clicks,Impressions,CTR,Position", "Seite,Notiz,Klicks,Impressionen,CTR,Durchschnittliche Position", "P\u00e1gina,Notas,Clics,Impresiones,CTR,Posici\u00f3n", "Query,Clicks")


def _export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(i, F.col("url"), F.floor(i / 50).alias("k"))
    note = F.when(i % 3 == 0, F.lit('"two\nlines, ""quoted"""')).otherwise(F.lit(""))
    url = F.when(i % 8 == 0, F.lit("some words")).otherwise(F.col("url"))
    row = F.concat(F.lit('"'), url, F.lit('",'), note, F.lit(',"1,2'), i.cast("string"), F.lit('",'), (i * 40).cast("string"), F.lit(","), (i % 10).cast("string"), F.lit(".5%,4.2"))
    first = p.select("k").distinct().select("k", F.lit(-1).cast("bigint").alias("page_id"), F.get(F.array(*[F.lit(h) for h in _HEADERS]), (F.col("k") % 4).cast("int")).alias("record"))
    records = p.select("k", "page_id", row.alias("record")).unionByName(first)
    lines = records.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"), F.floor(i / 20).alias("block"), i, F.posexplode(F.split("record", "\n")).alias("n", "value"))
    return lines.select("file", "block", (i * 2 + F.col("n")).alias("at"), "value")


@query(
    "s04_export_files",
    """with f as (select *, page_id // 50 as k, row_number() over (partition by page_id // 50 order by page_id) - 1 as ord from pages where (page_id // 50) % 4 <> 3)
    select 'f' || k as file, ord, url, cast('12' || page_id as bigint) as clicks, page_id * 40 as impressions, (page_id % 10 + 0.5e0) / 100 as ctr, 4.2e0 as position from f where page_id % 8 <> 0""",
)
def s04_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.metric_rows(exports.csv_records(_export_lines(spark, sf_dir))).drop("source")


@query("s05_refused_exports", "select distinct 'f' || (page_id // 50) as file, 'this is an export of queries, not of pages (column ''query'')' as problem from pages where (page_id // 50) % 4 = 3")
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.refused_files(exports.csv_records(_export_lines(spark, sf_dir)))


@query("f05_url_scheme", f"with raw as ({_METRIC_RAW.format(s='varchar')}) select regexp_matches(\"Top pages\", '^https?://') as absolute, count(*) as n from raw group by 1")
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").selectExpr(*select_list(_METRIC_RAW.format(s="string")))
    return raw.groupBy(F.col("Top pages").rlike("^https?://").alias("absolute")).agg(F.count(F.lit(1)).alias("n"))


_LOC = "case event_id % 6 when 0 then '1 234' when 1 then '1,200.5' when 2 then '2.67%' when 3 then '' when 4 then 'n/a' else cast(value as {s}) end"


@query("s06_locale_number", f"with t as (select event_id, regexp_replace({_LOC.format(s='varchar')}, '[\\s  ,]', '', 'g') as raw from events) select event_id, case when suffix(raw, '%') then {_LOCALE.format(chr(114) + 'trim(raw, ' + chr(39) + '%' + chr(39) + ')')} / 100 else {_LOCALE.format('raw')} end as number from t")
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.locale_number(F.expr(_LOC.format(s="string"))).alias("number"))


_ROBOTS = r"select 's' || n_nationkey as site, 'Sitemap: https://' || lower(n_name) || '.example/sitemap.xml' || chr(10) || '# note' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /private/' || n_nationkey || ' # why' || chr(10) || 'Crawl-delay: ' || (n_nationkey % 4) || chr(10) || 'User-agent: badbot' || chr(10) || 'Disallow: /' || chr(10) || 'disallow:' as body from nation"


@query(
    "s07_robots",
    rf"""with files as ({_ROBOTS}), l as (select site, generate_subscripts(string_split(body, chr(10)), 1) - 1 as pos, unnest(string_split(body, chr(10))) as raw from files),
    b as (select site, pos, trim(regexp_replace(raw, '#.*$', '')) as line from l), d as (select site, pos, lower(trim(split_part(line, ':', 1))) as field, trim(substr(line, strpos(line, ':') + 1)) as value from b where contains(line, ':')),
    a as (select *, last_value(case when field = 'user-agent' then value end ignore nulls) over (partition by site order by pos rows unbounded preceding) as agent from d),
    k as (select site, case when field = 'sitemap' and value <> '' then 'sitemap' when field = 'disallow' and agent = '*' and value <> '' then 'disallow' when field = 'crawl-delay' and agent = '*' and try_cast(value as double) is not null then 'crawl-delay' end as kind, cast(pos as integer) as ord, value from a)
    select * from k where kind is not null""",
)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.robots(table(spark, sf_dir, "nation").selectExpr("concat('s', n_nationkey) as site", select_list(_ROBOTS)[1]))


@query("s08_sitemap_xml", "select 'https://s.example/' || (page_id // 200) || '.xml' as sitemap_url, false as is_index, row_number() over (partition by page_id // 200 order by page_id) - 1 as ord, url as loc from pages where (page_id // 200) % 5 <> 4")
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    files = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 200).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("loc")))), lambda e: e["loc"]), "").alias("x"))
    body = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.when(F.col("k") % 5 == 4, "").otherwise("</urlset>"))
    return crawl.sitemap_entries(files.select(F.concat(F.lit("https://s.example/"), F.col("k").cast("string"), F.lit(".xml")).alias("sitemap_url"), body.alias("body")))


_LINKS = "select o_custkey % 200 as a, o_orderkey % 200 as b from orders"


@query(
    "s09_sitemap_walk",
    f"""with recursive links as (select distinct a, b from ({_LINKS})), walk as (select 0 as a, 0 as depth union select l.b, w.depth + 1 from walk w join links l on l.a = w.a where w.depth < 3),
    first as (select a, min(depth) as depth from walk group by a), n as (select a, depth, row_number() over (order by depth, lpad(cast(a as varchar), 3, '0')) as n from first)
    select 'site' as site, lpad(cast(a as varchar), 3, '0') as sitemap_url, depth from n where n <= 50""",
)
def s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.lpad((F.col(c) % 200).cast("string"), 3, "0")
    links = table(spark, sf_dir, "orders").select(name("o_custkey").alias("sitemap_url"), name("o_orderkey").alias("loc")).distinct()
    seeds = spark.range(1).select(F.lit("site").alias("site"), F.lit("000").alias("sitemap_url"))
    return crawl.sitemap_walk(links, seeds)


@query("s10_sitemap_candidates", r"with t as (select page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0) as root from pages) select page_id, unnest(list_distinct([root || '/sitemap.xml', root || '/own.xml', root || '/sitemap.xml', root || '/sitemap_index.xml', root || '/sitemap-index.xml'])) as candidate from t")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*", 0)
    listed = F.array(F.concat(root, F.lit("/sitemap.xml")), F.concat(root, F.lit("/own.xml")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(crawl.sitemap_candidates(F.col("url"), listed)).alias("candidate"))


_TIERS = ("http", "dynamic", "stealth", "api")
_ATTEMPTS = "select event_id % 500 as page, event_id % 4 as tier, case when user_id % 5 = 0 then 403 when user_id % 7 = 0 then 404 else 200 end as status, cast(value * 40 as bigint) as chars from events"


@query(
    "s11_fetch_ladder",
    f"""with a as ({_ATTEMPTS}), t as (select page, tier, max(status) as status, max(chars) as chars from a group by page, tier), ok as (select *, status not in (401, 403, 429, 503) and (status >= 400 or chars >= 200) as done from t)
    select page, min(case when done then tier end) as tier, arg_min(case when done then status end, case when done then tier end) as status from ok group by page""",
)
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").selectExpr(*select_list(_ATTEMPTS))
    tries = a.groupBy("page", "tier").agg(F.max("status").alias("status"), F.max("chars").alias("chars"))
    # A blocked or thin answer sends the page to the next tier; another refusal is final.
    done = ~F.col("status").isin(401, 403, 429, 503) & ((F.col("status") >= 400) | (F.col("chars") >= 200))
    place = F.when(done, F.col("tier"))
    return tries.groupBy("page").agg(F.min(place).alias("tier"), F.min_by(F.when(done, F.col("status")), place).alias("status"))


@query("s12_fetch_stats", f"with a as ({_ATTEMPTS}) select tier, count(*) filter (status = 200) as ok, count(*) filter (status <> 200) as failed from a group by tier")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").selectExpr(*select_list(_ATTEMPTS))
    return a.groupBy("tier").agg(F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") != 200).alias("failed"))


@query(
    "s13_scrape_payload",
    """with t as (select doc_id, case when doc_id % 11 = 0 then null else '# Title ' || doc_id || chr(10) || 'two words' end as md from documents)
    select doc_id, case when doc_id % 7 = 0 then 0 when md is null then 404 else 200 end as status, case when doc_id % 7 <> 0 and md is not null then 'u' || doc_id end as url,
    case when doc_id % 7 <> 0 and md is not null then 'Title ' || doc_id end as h1, case when doc_id % 7 <> 0 and md is not null then 5 end as word_count,
    case when doc_id % 7 = 0 then 'blocked' when md is null then 'empty markdown' end as error from t""",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    num = i.cast("string")
    md = F.when(i % 11 != 0, F.concat(F.lit("# Title "), num, F.lit("\ntwo words")))
    meta = F.struct(F.when(i % 11 == 0, 404).otherwise(200).alias("statusCode"), F.lit(" T ").alias("title"))
    body = F.to_json(F.struct((i % 7 != 0).alias("success"), F.when(i % 7 == 0, "blocked").alias("error"), F.struct(md.alias("markdown"), meta.alias("metadata")).alias("data")))
    page = crawl.scrape_page(F.concat(F.lit("u"), num), body)
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("p")).select("doc_id", *[F.col(f"p.{c}") for c in ("status", "url", "h1", "word_count", "error")])


@query(
    "s14_serp_count",
    """select event_id, case when event_id % 3 = 0 then user_id end as count, case event_id % 3 when 0 then 'ok' when 1 then case when event_id % 2 = 0 then 'out_of_credits' else 'api_error' end else 'no_results' end as reason,
    case when event_id % 3 = 1 then case when event_id % 2 = 0 then '40201 no money' else '49999 no money' end else '' end as detail from events""",
)
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 3 != 1, 20000).when(i % 2 == 0, 40201).otherwise(49999)
    result = F.array(F.struct(F.when(i % 3 == 0, F.col("user_id")).alias("se_results_count")))
    body = F.to_json(F.struct(F.array(F.struct(status.alias("status_code"), F.lit("no money ").alias("status_message"), result.alias("result"))).alias("tasks")))
    found = table(spark, sf_dir, "events").select("event_id", crawl.results_count(body).alias("c"))
    return found.select("event_id", "c.count", "c.reason", "c.detail")


@query("s15_html_metadata", r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as lang, array_length(regexp_extract_all(html, '<p>')) as paragraphs from pages")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", tag("<title>([^<]*)</title>").alias("title"), tag("<h1>([^<]*)</h1>").alias("h1"), tag('<html lang="([^"]*)"').alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("paragraphs"))


_BARE = "html"
for _tag in ("script", "style", "noscript", "template", "svg", "header", "footer", "nav", "aside", "form", "title"):
    _BARE = f"regexp_replace({_BARE}, '<{_tag}\\b[^>]*>.*?</{_tag}>', ' ', 'gsi')"
_UNDONE = (("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&quot;'", "chr(34)"), ("'&#39;'", "chr(39)"), ("'&amp;'", "'&'"))


def _plain_sql(html: str) -> str:
    text = f"regexp_replace({html}, '<[^>]*>', ' ', 'gs')"
    for a, b in _UNDONE:
        text = f"replace({text}, {a}, {b})"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


@query(
    "s15_html_text",
    f"""with t as (select page_id, regexp_replace(html, '<!--.*?-->', ' ', 'gs') || '<meta content="About &amp; ' || page_id || '" name=description><link href="/c' || page_id || '" rel=canonical>' as html from pages), b as (select *, {_plain_sql(_BARE)} as body from t)
    select page_id, {_plain_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} as title, {_plain_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} as h1, 'About & ' || page_id as description, '/c' || page_id as canonical, '' as robots, body, case when body = '' then 0 else len(string_split(body, ' ')) end as word_count from b""",
)
def s15_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.html import extract

    i = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta content="About &amp; '), i, F.lit('" name=description><link href="/c'), i, F.lit('" rel=canonical>'))
    return extract(table(spark, sf_dir, "pages").select("page_id", F.concat("html", head).alias("html")))


_VISIBLE = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
MOUNTS = ('id="root"', 'id="app"', 'id="__next"', "data-reactroot", "ng-app", "__nuxt")


@query("s16_js_shell", f"with t as (select page_id, case when page_id % 6 = 0 then '<html><body><div id=\"root\"></div><script>go()</script></body></html>' else html end as html from pages) select page_id, length({_VISIBLE}) < 200 and ({' or '.join(f'contains(html, {chr(39)}{m}{chr(39)})' for m in MOUNTS)}) as shell from t")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.html import looks_like_shell

    html = F.when(F.col("page_id") % 6 == 0, '<html><body><div id="root"></div><script>go()</script></body></html>').otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", looks_like_shell(html).alias("shell"))


_DUP = f"""{INVENTORY_SQL}, c as (select *, canonical <> '' and canonical <> url and canonical in (select url from inv) as elsewhere from entries),
d as (select *, elsewhere or (content_hash <> '' and row_number() over (partition by content_hash, elsewhere order by ord) > 1) as removed from c)"""


@query("j01_canonical_present", f"with {INVENTORY_SQL} select ord, canonical <> '' and canonical <> url and canonical in (select url from inv) as elsewhere from entries")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inventory(spark, sf_dir)
    present = e.select(F.col("url").alias("canonical")).distinct().withColumn("p", F.lit(True))
    return e.join(present, "canonical", "left").select("ord", ((F.col("canonical") != "") & (F.col("canonical") != F.col("url")) & F.col("p").isNotNull()).alias("elsewhere"))


@query("w01_first_per_hash", f"with {_DUP} select ord, removed from d")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.marked_duplicates(inventory(spark, sf_dir)).select("ord", "removed")


@query("f02_thin_content", f"with {INVENTORY_SQL} select ord, word_count between 1 and 49 as removed from entries")
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).select("ord", inv.is_thin().alias("removed"))


_FLOOR = "(select unique_inlinks from (select unique_inlinks, row_number() over (order by unique_inlinks desc) as rn, count(*) over () as n from {0}) where rn = n // 10 + 1)"


@query("f03_near_duplicates", f"with {INVENTORY_SQL} select ord, closest_similarity >= 90 and not ({_FLOOR.format('entries')} > 0 and unique_inlinks >= {_FLOOR.format('entries')}) as removed from entries")
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.marked_near_duplicates(inventory(spark, sf_dir)).select("ord", "removed")


@query("w16_quantile_floor", f"with {INVENTORY_SQL} select {_FLOOR.format('entries')} as floor")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.protect_floor(inventory(spark, sf_dir)).select(F.col("floor_").alias("floor"))


_CHAIN = f"""{_DUP}, k as (select * from d where not removed), near as (select *, closest_similarity >= 90 and not ({_FLOOR.format('k')} > 0 and unique_inlinks >= {_FLOOR.format('k')}) as gone from k), t as (select * from near where not gone)"""


@query("f04_filter_chain", f"with {_CHAIN} select ord, url from t where not word_count between 1 and 49")
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.filter_chain(inventory(spark, sf_dir), near=True, thin=True)[0].select("ord", "url")


@query("a27_filter_reports", f"with {_CHAIN} select 'duplicates' as stage, count(*) filter (removed) as removed from d union all select 'near duplicates', count(*) filter (gone) from near union all select 'thin content', count(*) filter (word_count between 1 and 49) from t")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.filter_chain(inventory(spark, sf_dir), near=True, thin=True)[1]


@query("w02_importance_order", f"with {INVENTORY_SQL} select ord, cast(row_number() over (partition by site order by score desc, ord) as integer) as place from entries")
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.by_importance(inventory(spark, sf_dir)).select("ord", "place")


_SECTIONED = f"{INVENTORY_SQL}, main as (select *, case when {CONTACT_SQL} then 'Contact' else {SECTION_SQL} end as section from entries where not optional)"


@query("k01_group_by_url", f"with {_SECTIONED} select ord, section from main")
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.group_by_url(inventory(spark, sf_dir)).select("ord", "section")


_SINGLES = f"""{INVENTORY_SQL}, main as (select *, case when unique_inlinks = 0 then 'Contact' when ord % 3 = 0 then 'Many' else 'One ' || ord end as section from entries),
sizes as (select site, section, count(*) as size from main group by all), shape as (select site, count(*) as sections, count(*) filter (size < 2 and section <> 'Contact') as singles from sizes group by site)"""


@query("k02_consolidate_singletons", f"with {_SINGLES} select m.ord, case when h.sections >= 3 and h.singles / h.sections >= 0.6 and s.size < 2 and m.section <> 'Contact' then 'Pages' else m.section end as section from main m join sizes s using (site, section) join shape h using (site)")
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inventory(spark, sf_dir)
    section = F.when(F.col("unique_inlinks") == 0, "Contact").when(F.col("ord") % 3 == 0, "Many").otherwise(F.concat(F.lit("One "), F.col("ord").cast("string")))
    return sec.consolidate(e.withColumn("section", section)).select("ord", "section")


@query("k03_assigned_sections", f"with {INVENTORY_SQL}, a as (select site, ord, case when ord % 3 = 0 then null when ord % 5 = 0 then 'Optional' else 'S' || (ord % 4) end as given from entries), f as (select site, arg_min(given, ord) filter (given is not null and given <> 'Optional') as first from a group by site) select ord, case when first is null then null else coalesce(given, first) end as section from a join f using (site)")
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("ord") % 3 == 0, F.lit(None)).when(F.col("ord") % 5 == 0, "Optional").otherwise(F.concat(F.lit("S"), (F.col("ord") % 4).cast("string")))
    a = inventory(spark, sf_dir).select("site", "ord", given.alias("given"))
    named = F.col("given").isNotNull() & (F.col("given") != "Optional")
    first = a.where(named).groupBy("site").agg(F.min_by("given", "ord").alias("first"))
    return a.join(first, "site", "left").select("ord", F.when(F.col("first").isNotNull(), F.coalesce("given", "first")).alias("section"))


_RANK = """case when section = 'Main' then 0 when list_position(['Getting Started','Core Concepts','Guides','API Reference','Integrations','Resources'], section) > 0 then 1 when section = 'Contact' then 3 else 2 end,
  case when section in ('Main', 'Contact') then 0 else coalesce(list_position(['Getting Started','Core Concepts','Guides','API Reference','Integrations','Resources'], section), 0) end, section"""
_NAMES = "['Guides', 'Main', 'Contact', 'Optional', 'Resources', 'Zebra', 'Apple', 'API Reference']"


@query("w12_section_order", f"with {INVENTORY_SQL}, p as (select site, {_NAMES}[ord % 8 + 1] as section from entries), s as (select site, section, count(*) as pages from p where section <> 'Optional' group by all) select site, section, pages, cast(row_number() over (partition by site order by {_RANK}) - 1 as integer) as position from s")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x.strip(" '[]")) for x in _NAMES.split(",")])
    p = inventory(spark, sf_dir).withColumn("section", F.get(names, (F.col("ord") % 8).cast("int")))
    return sec.ordered_sections(p, "catalog")


@query("w13_manual_order", f"with {INVENTORY_SQL}, p as (select distinct site, {_NAMES}[ord % 8 + 1] as section from entries) select site, section, cast(row_number() over (partition by site order by case section when 'Zebra' then 0 when 'Guides' then 1 else 2 end, section) - 1 as integer) as position from p")
def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x.strip(" '[]")) for x in _NAMES.split(",")])
    p = inventory(spark, sf_dir).select("site", F.get(names, (F.col("ord") % 8).cast("int")).alias("section")).distinct()
    return sec.manual_order(p, ("Zebra", "Guides"))


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = inventory(spark, sf_dir).withColumn("display_title", ranking.display_title()).withColumn("score", F.round(ranking.importance(), 6))
    optional = ranking.is_optional()
    return sec.group_by_url(e), e.where(optional)


_LINE = "'- [' || display_title || '](' || url || '): ' || description"
_INDEX = f"""{_SECTIONED}, blocks as (select site, section, string_agg({_LINE}, chr(10) order by round(score, 6) desc, ord) as lines from main group by site, section),
bodies as (select site, string_agg(chr(10) || '## ' || section || chr(10) || chr(10) || lines, chr(10) order by {_RANK}) as body from blocks group by site),
extra as (select site, string_agg({_LINE}, chr(10) order by round(score, 6) desc, ord) as lines from entries where optional group by site)"""
_HEAD = "'# ' || site || chr(10) || chr(10) || '> Official website content for ' || site || '.' || chr(10) || chr(10) || 'For full page content, see [' || site || '/llms-full.txt](https://' || site || '/llms-full.txt)' || chr(10)"
_FOOT = "chr(10) || chr(10) || '---' || chr(10) || '*Generated 2026-08-20. Recommend reviewing quarterly or after major site changes.*' || chr(10) || chr(10)"
_BODY = f"{_HEAD} || body || case when lines is null then '' else chr(10) || chr(10) || '## Optional' || chr(10) || chr(10) || lines end || {_FOOT}"


@query("k04_render_index", f"with {_INDEX} select site, {_BODY} as body from bodies left join extra using (site)")
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, optional = _rendered(spark, sf_dir)
    return sec.render_index(main, optional, "catalog", "2026-08-20")


def _with_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("markdown"))
    e = inventory(spark, sf_dir).withColumn("display_title", ranking.display_title()).withColumn("score", F.round(ranking.importance(), 6))
    return e.join(md, "ord")


_FULL_CTE = f"""{INVENTORY_SQL}, b as (select site, row_number() over (partition by site order by round(score, 6) desc, ord) as n, chr(10) || '---' || chr(10) || chr(10) || '## ' || display_title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || text || chr(10) as block
  from entries join documents on doc_id = ord where text <> ''),
fold as (select site, cast(0 as bigint) as n, '# ' || site || chr(10) as body, cast(0 as bigint) as omitted from (select distinct site from b)
  union all select f.site, f.n + 1, case when length(f.body) + length(b.block) <= 20000 then f.body || b.block else f.body end, f.omitted + case when length(f.body) + length(b.block) <= 20000 then 0 else 1 end from fold f join b on b.site = f.site and b.n = f.n + 1),
last as (select site, arg_max(body, n) as body, arg_max(omitted, n) as omitted from fold group by site),
full_text as (select site, body || case when omitted > 0 then chr(10) || '---' || chr(10) || chr(10) || '*' || omitted || ' lower-priority page(s) omitted to keep this file under 20,000 characters.*' || chr(10) else '' end as body, omitted from last)"""


@query("k05_render_full", f"with recursive {_FULL_CTE} select site, body, omitted from full_text")
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.greedy_full(_with_markdown(spark, sf_dir), 20_000)


@query("k06_combined", f"with recursive {_FULL_CTE}, {_INDEX.removeprefix(INVENTORY_SQL + ', ')} select site, {_BODY.replace(' || body ||', ' || bodies.body ||')} || chr(10) || chr(10) || full_text.body as body from bodies left join extra using (site) join full_text using (site)")
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, optional = _rendered(spark, sf_dir)
    index = sec.render_index(main, optional, "catalog", "2026-08-20")
    full = sec.greedy_full(_with_markdown(spark, sf_dir), 20_000).select("site", F.col("body").alias("full"))
    return index.join(full, "site").select("site", F.concat("body", F.lit("\n\n"), "full").alias("body"))


@query("k07_rebuild", f"with {_INDEX.replace('where not optional)', 'where not optional and ord % 5 <> 0)')} select site, {_BODY} as body from bodies left join extra using (site)")
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, optional = _rendered(spark, sf_dir)
    gone = inventory(spark, sf_dir).where("ord % 5 = 0").select("ord")
    return sec.render_index(main.join(gone, "ord", "left_anti"), optional, "catalog", "2026-08-20")


@query("k08_result_rows", f"with {_SECTIONED} select site, section, count(*) as pages, cast(min(ord) as bigint) as first_page from main group by all")
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec.group_by_url(inventory(spark, sf_dir)).groupBy("site", "section").agg(F.count(F.lit(1)).alias("pages"), F.min("ord").alias("first_page"))


@query("a15_extension_counts", rf"select lower(regexp_extract({sql_path()}, '\.([^./]*)$', 1)) as extension, count(*) as n from pages where regexp_matches({sql_path()}, '\.[^./]*$') group by 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(urls.extension(F.col("url")).alias("extension")).where("extension is not null").groupBy("extension").agg(F.count(F.lit(1)).alias("n"))


@query("flagship_top_pages", f"with {_DUP}, m as (select *, case when {CONTACT_SQL} then 'Contact' else {SECTION_SQL} end as section from d where not removed and not optional), r as (select site, section, url, round(score, 6) as score, cast(row_number() over (partition by site, section order by score desc, ord) as integer) as place from m) select * from r where place <= 3")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = inv.marked_duplicates(inventory(spark, sf_dir)).where("not removed")
    pages = sec.group_by_url(kept).withColumn("score", ranking.importance())
    best = W.Window.partitionBy("site", "section").orderBy(F.desc("score"), "ord")
    return pages.withColumn("place", F.row_number().over(best)).where("place <= 3").select("site", "section", "url", F.round("score", 6).alias("score"), "place")
